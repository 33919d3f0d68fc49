"""Drivers: from files of an archive to rows of chunks.

A driver turns a DataFrame of files into one of chunks: ``chunk_start`` (the number of
its first pixel), ``lines``, ``samples``, for each column asked for the part of its layer
that covers the chunk, and the coordinates' parts as ``__lat`` and ``__lon`` (shifted if
the table says so). Every layer is
cut by its own shape. A layer that is missing or whose size isn't the file's gives nulls; a
file without a usable size or without its geolocation is left out. Readers of binary
raster formats need libraries that may be absent, so they're registered when they can be
imported; files whose layers are array columns need none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import decode, geoloc
from ..spec import Column as Spec
from ..spec import Role, Table

DRIVERS: dict[str, Callable[[DataFrame, Table, list[str]], DataFrame]] = {}


def driver(name: str):
    def add(f):
        DRIVERS[name] = f
        return f

    return add


def chunks(files: DataFrame, table: Table, columns: list[str]) -> DataFrame:
    try:
        f = DRIVERS[table.driver]
    except KeyError:
        raise ValueError(f"no driver {table.driver!r}; there are {', '.join(sorted(DRIVERS))}") from None
    return f(files, table, columns)


def _div(x: Column, n: int) -> Column:
    """x / n, rounded up."""
    return x if n == 1 else F.floor((x + (n - 1)) / n).cast("int")


def file_pixels(table: Table) -> Column:
    """Pixels of a file; null for a file that can't be read."""
    g = table.geolocation
    if g is None:
        return F.size(next(c for c in table.columns if c.plain).layer)
    fits = (F.size(g.lat) == F.size(g.lon)) & (F.size(g.lat) % (table.samples // g.factor) == 0)
    if g.product is not None:
        fits &= F.col(g.product).isNotNull()
    return F.when(fits, F.size(g.lat) * (g.factor * g.factor))


def _part(layer: Column, spec: Spec, samples: int, lines: Column, start: Column, rows: Column) -> Column:
    """What a chunk of ``rows`` lines from ``start`` needs of a file's layer; null unless the layer has the file's size."""
    per, planes, postfix = samples // spec.hfactor, math.prod(spec.dims), 1
    first = decode.prefix_offset(spec.prefix, spec.dims, 1)
    if spec.type == "bit" and spec.bitmap_prefix:
        planes, first = planes * spec.width, first * spec.width
    elif spec.type == "bit":
        postfix = spec.width
    plane = _div(lines, spec.vfactor) * per * postfix
    at = F.floor(start / spec.vfactor).cast("int") * per * postfix + 1
    n = _div(rows, spec.vfactor) * per * postfix
    if spec.type == "bit" and spec.bitmap_prefix:
        part = F.concat(*(F.slice(layer, plane * (first + k) + at, n) for k in range(spec.width)))
    else:
        part = F.slice(layer, plane * first + at, n)
    if spec.product is not None:
        layer = F.when(F.col(spec.product).isNotNull(), layer)
    return F.when(F.size(layer) == (F.col("__pixels") if spec.plain else plane * planes), part)


def _cut(files: DataFrame, table: Table, columns: list[str], block: int | None) -> DataFrame:
    own = {c.layer for c in table.columns if c.role is Role.DATASET} | ({table.geolocation.lat, table.geolocation.lon} if table.geolocation else set())
    others = [F.col(f"`{c}`") for c in files.columns if c not in own]
    rows = files.withColumn("__pixels", file_pixels(table)).where("__pixels > 0")
    lines = _div(F.col("__pixels"), table.samples)
    start, n = F.lit(0), lines
    if block is not None:
        rows = rows.withColumn("__chunk", F.explode(F.sequence(F.lit(0), _div(lines, block) - 1)))
        start = F.col("__chunk") * block
        n = F.least(F.lit(block), lines - start)
    parts = [_part(F.col(f"`{s.layer}`"), s, table.samples, lines, start, n).alias(s.name) for s in (table.column(c) for c in columns)]
    if table.geolocation:
        g = table.geolocation
        coarse = Spec("__coordinate", hfactor=g.factor, vfactor=g.factor)
        lat, lon = (_part(F.col(f"`{layer}`"), coarse, table.samples, lines, start, n) for layer in (g.lat, g.lon))
        # shifted once a chunk, not at each of a pixel's lookups
        parts += [lat.alias("__lat"), (F.transform(lon, geoloc.shifted_longitude) if table.shift_longitude else lon).alias("__lon")]
    return rows.select(*others, (start * table.samples).alias("chunk_start"), n.alias("lines"), F.lit(table.samples).alias("samples"), *parts)


@driver("swath")
def swath(files: DataFrame, table: Table, columns: list[str]) -> DataFrame:
    """Chunks of a scan block each: ``table.lines`` lines, the last of a file maybe fewer."""
    return _cut(files, table, columns, table.lines)


@driver("grid")
def grid(files: DataFrame, table: Table, columns: list[str]) -> DataFrame:
    """The whole file is one chunk."""
    return _cut(files, table, columns, None)
