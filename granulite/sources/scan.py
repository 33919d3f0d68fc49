"""The pixel scan: catalog, then files, then chunks, then pixels.

Conditions on catalog columns and what geometry conditions imply for a file are
applied to the catalog, before a file is joined; pixels are made by exploding positions
only, and each column is looked up by position, so layers that no one asks for aren't
read and values of pixels that are dropped aren't decoded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import decode, geoloc, geometry
from ..operators.prune import file_condition
from ..spec import Column as Spec
from ..spec import Role, Table
from .catalog import sample
from .drivers import chunks, file_pixels


@dataclass(frozen=True)
class Geo:
    """A condition on a pixel's place: ``[not] place op box``, where place is a point or footprint column."""

    op: str
    box: Column
    role: Role = Role.POINT
    negated: bool = False


def layer_value(spec: Spec, table: Table, index: Column) -> Column:
    """A dataset column's value at a position of its chunk."""
    layer = F.col(f"`{spec.name}`")
    at = F.lit(0) if spec.constant else decode.replicated(index, table.samples, spec.hfactor, spec.vfactor) if spec.hfactor * spec.vfactor > 1 else index
    if spec.type == "bit":
        plane = F.floor(F.size(layer) / spec.width).cast("int")
        if spec.width > 7:
            return decode.bits_wide(layer, at, spec.width, plane if spec.bitmap_prefix else 1, 1 if spec.bitmap_prefix else spec.width)
        return decode.bits_prefix(layer, at, spec.width, plane) if spec.bitmap_prefix else decode.bits_postfix(layer, at, spec.width)
    v = decode.filled(decode.at(layer, at), spec.fill)
    if spec.type == "float8":
        if spec.valid_range:
            v = decode.in_range(v, *spec.valid_range)
        which = F.lit(decode.prefix_offset(spec.prefix, spec.dims, 1))

        def attribute(name: str | None, own: float | None, none: float) -> Column:
            own = F.lit(none if own is None else own)
            return own if name is None else F.coalesce(F.get(F.col(f"`{name}`"), which).cast("double"), own)

        return decode.scaled(v, attribute(spec.scale_name, spec.scale, 1.0), attribute(spec.offset_name, spec.offset, 0.0), spec.inverse_scale)
    return {"int2": decode.wrapped_short, "int4": lambda x: x.cast("int"), "int8": lambda x: x.cast("long"), "float4": lambda x: x.cast("float")}[spec.type](v)


def _placed(rows: DataFrame, table: Table) -> tuple[DataFrame, tuple[Column, Column], list[tuple[Column, Column]]]:
    """rows with the coordinates of a pixel's centre and corners, and these.

    Chunks' longitudes are shifted before interpolation, so no value lies between two ends of the
    range. Cells and weights are columns of their own, so each is computed once; what no
    one asks for is pruned.
    """
    g, n = table.geolocation, table.samples
    lines = F.floor(F.col("lines") / g.factor).cast("int")
    places = {"m": (F.floor(F.col("index") / n), F.col("index") % n, geoloc.CENTRE)}
    for k, at in enumerate(geoloc.corner_positions(F.col("index"), n)):
        places[str(k)] = (F.floor(at / (n + 1)), at % (n + 1), geoloc.CORNER)
    if g.factor == 1:
        del places["m"]
    cells, values = {}, {}
    for k, (row, col, offset) in places.items():
        cells[f"__i{k}"], cells[f"__a{k}"] = geoloc.cell(row, lines, g.factor, offset)
        cells[f"__j{k}"], cells[f"__b{k}"] = geoloc.cell(col, n // g.factor, g.factor, offset)
        at = [F.col(f"__{x}{k}") for x in "iajb"]
        values[f"__x{k}"] = geoloc.between(F.col("__lon"), n // g.factor, *at)
        values[f"__y{k}"] = geoloc.between(F.col("__lat"), n // g.factor, *at)
    if g.factor == 1:
        values |= {"__xm": decode.at(F.col("__lon"), F.col("index")), "__ym": decode.at(F.col("__lat"), F.col("index"))}
    rows = rows.withColumns(cells).withColumns(values)
    return rows, (F.col("__xm"), F.col("__ym")), [(F.col(f"__x{k}"), F.col(f"__y{k}")) for k in range(4)]


def pixel_scan(catalog: DataFrame, files: DataFrame, table: Table, columns: list[str], where: Column | None = None, geo: tuple[Geo, ...] = (), file_box: Column | None = None, on: str = "file_id", point: tuple[Column, Column] | None = None, corners: list[tuple[Column, Column]] | None = None, present: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns asked for of each pixel that meets all conditions.

    catalog and files are joined on ``on``. where: a condition on catalog columns. geo:
    conditions on places; file_box, the file's box in the catalog, prunes by them. present:
    dataset columns that must not be null; files without their product are left out
    unopened. The catalog may be joined to another table before, whose rows then choose the
    files: carry names its columns, which come first in the result.

    Places come from the table's geolocation. point and corners give a pixel's coordinates
    from its chunk's columns instead, ``index`` (within the chunk), ``line`` and ``sample``
    (within the file).
    """
    catalog = file_rows(catalog, table, where, geo, file_box, present)
    specs = [table.column(c) for c in columns]
    asked = list(dict.fromkeys(c for c in [*columns, *present] if table.column(c).role is Role.DATASET))
    rows = chunks(files.join(catalog, on), table, asked)
    rows = rows.withColumn("index", F.explode(F.sequence(F.lit(0), F.col("lines") * F.col("samples") - 1)))
    ordinal = F.col("chunk_start") + F.col("index")
    rows = rows.withColumn("line", F.floor(ordinal / F.col("samples")).cast("int")).withColumn("sample", (ordinal % F.col("samples")).cast("int"))
    shift = lambda x, y: (geoloc.shifted_longitude(x) if table.shift_longitude else x, y)
    point, corners = point and shift(*point), corners and [shift(*c) for c in corners]
    if table.geolocation is not None:
        rows, *own = _placed(rows, table)
        point, corners = point or own[0], corners or own[1]
    places: dict[Role, Column] = {}
    if point:
        places[Role.POINT] = geometry.point(*point)
    if corners:
        places |= {Role.FOOTPRINT: geometry.ring(*corners), Role.BOX: geometry.corners_box(*corners)}
    for g in geo:
        rows = rows.where(geometry.apply(g.op, geometry.point_box(places[Role.POINT]) if g.role is Role.POINT else places[Role.BOX], g.box, g.negated))
    for c in present:
        rows = rows.where(layer_value(table.column(c), table, F.col("index")).isNotNull())
    out = [F.col(f"`{c}`") for c in carry]
    for s in specs:
        value = {
            Role.INDEX: lambda s: ordinal.cast("int"), Role.LINE: lambda s: F.col("line"), Role.SAMPLE: lambda s: F.col("sample"),
            Role.POINT: lambda s: places[Role.POINT], Role.FOOTPRINT: lambda s: places[Role.FOOTPRINT], Role.BOX: lambda s: places[Role.BOX],
            Role.CATALOG: lambda s: F.col(s.layer), Role.DATASET: lambda s: layer_value(s, table, F.col("index")),
        }[s.role](s)
        out.append(value.alias(s.name))
    return rows.select(*out)


def file_rows(catalog: DataFrame, table: Table, where: Column | None = None, geo: tuple[Geo, ...] = (), file_box: Column | None = None, present: tuple[str, ...] = ()) -> DataFrame:
    """The catalog's rows whose files a scan opens."""
    if where is not None:
        catalog = catalog.where(where)
    if file_box is not None:
        for g in geo:
            catalog = catalog.where(file_condition(g.op, g.negated, file_box, g.box))
    products = {table.column(c).product for c in present} | ({table.geolocation.product} if table.geolocation else set())
    for product in sorted(products - {None}):
        catalog = catalog.where(F.col(product).isNotNull())
    return catalog


def explained(catalog: DataFrame, files: DataFrame, table: Table, columns: list[str], **conditions) -> dict[str, str]:
    """What a scan does: the columns it decodes, its query of the catalog, the conditions on places and its plan. Nothing is run."""
    choose = {k: v for k, v in conditions.items() if k in ("where", "geo", "file_box", "present")}
    plan = lambda df: df._jdf.queryExecution().toString()
    return {
        "active columns": ", ".join(dict.fromkeys([*columns, *conditions.get("present", ())])),
        "catalog query": file_rows(catalog, table, **choose)._jdf.queryExecution().optimizedPlan().toString(),
        "geometry predicates": ", ".join(f"{'not ' if g.negated else ''}{g.role.value} {g.op}" for g in conditions.get("geo", ())),
        "plan": plan(pixel_scan(catalog, files, table, columns, **conditions)),
    }


def sampled(catalog: DataFrame, files: DataFrame, table: Table, columns: list[str], rows: int, seed: int = 0, **conditions) -> DataFrame:
    """``rows`` random pixels of max(5, rows / 100) random files, for statistics."""
    return pixel_scan(sample(catalog, rows, seed), files, table, columns, **conditions).orderBy(F.rand(seed)).limit(rows)


def estimated(catalog: DataFrame, files: DataFrame, table: Table, on: str = "file_id") -> DataFrame:
    """(files, pixels): what a scan of the catalog's files would open and yield, from sizes alone."""
    found = files.join(catalog, on).select(file_pixels(table).alias("n")).where("n > 0")
    return found.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.ceil(F.col("n") / table.samples) * table.samples), F.lit(0)).cast("long").alias("pixels"))


def register(catalog: DataFrame, files: DataFrame, tables: dict[str, Table], **conditions) -> list[str]:
    """Makes each pixel table a temporary view of its own name, with all its columns, for SQL."""
    for name, table in tables.items():
        pixel_scan(catalog, files, table, [c.name for c in table.columns], **conditions).createOrReplaceTempView(name)
    return sorted(tables)
