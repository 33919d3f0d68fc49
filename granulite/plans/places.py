"""Geometry operators, pruning, polygons and their text."""

from __future__ import annotations

import dataclasses
from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from ..functions import geometry_text
from ..operators import geometry
from ..operators.prune import file_condition
from ..sources.scan import Geo
from ..spec import Column, Role
from .fixtures import CATALOG, file_box, PIXELS, TABLE, catalog, file_catalog, pixels
from .scans import REGION

#: The argument's box.
BOX = (-40.0, -20.25, 55.5, 30.0)
_A = dict(zip(("axmin", "aymin", "axmax", "aymax"), BOX))
#: The pixel table with footprints' boxes.
BOXED = dataclasses.replace(TABLE, columns=(*TABLE.columns, Column("box", Role.BOX)))
#: Each operator on a footprint's box (l, b, r, t) in SQL, spelled out by cases of what fails.
SQL = {
    "overlaps": "NOT (r < axmin OR l > axmax OR t < aymin OR b > aymax)", "contains": "least(l, axmin) = l AND greatest(r, axmax) = r AND least(b, aymin) = b AND greatest(t, aymax) = t",
    "within": "l BETWEEN axmin AND axmax AND r BETWEEN axmin AND axmax AND b BETWEEN aymin AND aymax AND t BETWEEN aymin AND aymax", "same": "(l, b, r, t) = (axmin, aymin, axmax, aymax)",
    "overleft": "NOT r > axmax", "overright": "NOT l < axmin", "overabove": "NOT b < aymin", "overbelow": "NOT t > aymax", "left": "NOT r >= axmin", "right": "NOT l <= axmax", "above": "NOT b <= aymax", "below": "NOT t >= aymin",
    "comm_left": "NOT axmax > r", "comm_right": "NOT axmin < l", "comm_above": "NOT aymin < b", "comm_below": "NOT aymax > t",
}
FOOT = f"{PIXELS}, f AS (SELECT *, lon - 0.0625 AS l, lat - 0.0625 AS b, lon + 0.0625 AS r, lat + 0.0625 AS t, " + ", ".join(f"{v}::DOUBLE AS {k}" for k, v in _A.items()) + " FROM px)"


def _argument(op: str):
    """The box that an operator is held against: for ``contains`` and ``same`` that of pixel (2, 3) of file 10."""
    return (-87.125, 53.125, -87.0, 53.25) if op in ("contains", "same") else BOX


def _query(op: str):
    def query(spark, sf_dir):
        geo = (Geo(op, geometry.box(*_argument(op)), Role.FOOTPRINT),)
        return pixels(spark, sf_dir, ["file_id", "index"], geo=geo, file_box=file_box())

    a = _argument(op)
    foot = f"{PIXELS}, f AS (SELECT *, lon - 0.0625 AS l, lat - 0.0625 AS b, lon + 0.0625 AS r, lat + 0.0625 AS t, " + ", ".join(f"{v}::DOUBLE AS {k}" for k, v in zip(_A, a)) + " FROM px)"
    return query, f"WITH {foot} SELECT file_id, idx AS index FROM f WHERE {SQL[op]}"


OPERATORS = {f"geom_{op}": _query(op) for op in geometry.OPERATORS}


def geom_not(spark, sf_dir):
    """For each operator the files and pixels for which its negation holds, counted, in one scan of the files where one of them can hold."""
    a = geometry.box(*BOX)
    some = reduce(or_, (file_condition(op, True, file_box(), a) for op in geometry.OPERATORS))
    px = pixels(spark, sf_dir, ["file_id", "box"], table=BOXED, where=some)
    held = px.groupBy("file_id").agg(*(F.count(F.when(geometry.apply(op, F.col("box"), a, True), 1)).alias(op) for op in geometry.OPERATORS))
    n = held.agg(*(f(op).alias(k + op) for op in geometry.OPERATORS for k, f in (("n_", F.sum), ("files_", lambda op: F.count_if(F.col(op) > 0)))))
    rows = (F.struct(F.lit(op).alias("op"), F.coalesce(F.col(f"n_{op}"), F.lit(0)).alias("n"), F.col(f"files_{op}").alias("files")) for op in geometry.OPERATORS)
    return n.select(F.inline(F.array(*rows)))


def geom_conjunction(spark, sf_dir):
    a, b = geometry.box(*BOX), geometry.box(0, -90, 360, 10)
    geo = (Geo("overlaps", a, Role.FOOTPRINT), Geo("overleft", a, Role.POINT), Geo("within", b, Role.FOOTPRINT, True), Geo("right", b, Role.POINT, True))
    return pixels(spark, sf_dir, ["file_id", "index", "v"], geo=geo, file_box=file_box())


def file_pruning(spark, sf_dir):
    """How many files each implied condition leaves, and how many hold a match."""
    c = file_catalog(spark, sf_dir)
    a = geometry.box(*BOX)
    counts = [F.count(F.when(file_condition(op, neg, file_box(), a), 1)).alias(f"{'not_' if neg else ''}{op}") for op in geometry.OPERATORS for neg in (False, True)]
    return c.agg(*counts)


_F = "lon0 AS l, lat0 AS b, lon0 + 1 AS r, lat0 + 1 AS t"


def _implied() -> str:
    """What each condition leaves of the files, from where a pixel can be in a file's box."""
    can = {
        "overlaps": ("r >= axmin AND l <= axmax AND t >= aymin AND b <= aymax", "l < axmin OR r > axmax OR b < aymin OR t > aymax"),
        "contains": ("l <= axmin AND r >= axmax AND b <= aymin AND t >= aymax", "r > axmin OR l < axmax OR t > aymin OR b < aymax"), "within": ("r >= axmin AND l <= axmax AND t >= aymin AND b <= aymax", "l < axmin OR r > axmax OR b < aymin OR t > aymax"),
        "same": ("l <= axmin AND r >= axmax AND b <= aymin AND t >= aymax", "l < axmax OR r > axmin OR b < aymax OR t > aymin"), "overleft": ("l <= axmax", "r > axmax"), "overright": ("r >= axmin", "l < axmin"), "overabove": ("t >= aymin", "b < aymin"), "overbelow": ("b <= aymax", "t > aymax"),
        "left": ("l < axmin", "r >= axmin"), "right": ("r > axmax", "l <= axmax"), "above": ("t > aymax", "b <= aymax"), "below": ("b < aymin", "t >= aymin"),
        "comm_left": ("r >= axmax", "l < axmax"), "comm_right": ("l <= axmin", "r > axmin"), "comm_above": ("b <= aymin", "t > aymin"), "comm_below": ("t >= aymax", "b < aymax"),
    }
    parts = [f"count(*) FILTER (WHERE {e}) AS {'not_' if neg else ''}{op}" for op, pair in can.items() for neg, e in zip((False, True), pair)]
    return f"WITH {PIXELS}, f AS (SELECT {_F}, " + ", ".join(f"{v}::DOUBLE AS {k}" for k, v in _A.items()) + f" FROM g) SELECT {', '.join(parts)} FROM f"


def st_within(spark, sf_dir):
    return catalog(spark, sf_dir).where(geometry.st_within(F.struct(F.col("xmin").alias("x"), F.col("ymin").alias("y")), REGION)).select("id")


def st_contains(spark, sf_dir):
    """Granules whose triangle (lower left, upper left, lower right) contains a point near its middle."""
    c = catalog(spark, sf_dir)
    ring = geometry.ring((F.col("xmin"), F.col("ymin")), (F.col("xmin"), F.col("ymax")), (F.col("xmax"), F.col("ymin")))
    p = F.struct((F.ceil("xmin") + 0.9375).alias("x"), (F.ceil("ymin") + 0.75).alias("y"))
    return c.select("id", ring.alias("ring"), p.alias("p")).where(geometry.st_contains(F.col("ring"), F.col("p"))).select("id")


def st_astext(spark, sf_dir):
    c = catalog(spark, sf_dir)
    ring = geometry.ring((F.col("xmin"), F.col("ymin")), (F.col("xmax"), F.col("ymin")), (F.col("xmax"), F.col("ymax")))
    p = geometry.point(F.col("xmin"), F.col("ymin"))
    return c.select("id", geometry_text.point_as_text(p).alias("point"), geometry_text.ring_as_text(ring).alias("polygon"))


def st_geomfromtext(spark, sf_dir):
    c = catalog(spark, sf_dir)
    wkt = F.concat(F.lit("POLYGON(("), F.concat_ws(",", *(F.concat_ws(" ", x, y) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymin")))), F.lit("))"))
    wkt = F.when(F.col("id") % 10 == 0, "POINT(1 2)").otherwise(wkt)
    return c.select("id", geometry_text.ring_from_text(wkt).alias("r")).select("id", F.size("r").alias("n"), F.get("r", F.lit(2))["x"].alias("x"), F.get("r", F.lit(2))["y"].alias("y")).withColumn("n", F.when(F.col("x").isNotNull(), F.col("n")))


def st_bounds(spark, sf_dir):
    c = catalog(spark, sf_dir)
    ring = geometry.ring((F.col("xmin"), F.col("ymax")), (F.col("xmax"), F.col("ymin")), (F.col("xmin") + 1, F.col("ymin") - 1))
    c = c.select("id", ring.alias("r")).where("r is not null")
    return c.select("id", *(v.alias(k) for k, v in geometry_text.bounds(F.col("r")).items()))


QUERIES = {k: q for k, (q, _) in OPERATORS.items()} | {f.__name__: f for f in (geom_not, geom_conjunction, file_pruning, st_within, st_contains, st_astext, st_geomfromtext, st_bounds)}

_RING = [*REGION, REGION[0]]
_EDGES = ", ".join(f"({x1}, {y1}, {x2}, {y2})" for (x1, y1), (x2, y2) in zip(_RING, _RING[1:]))
_T = "CASE WHEN {0} = floor({0}) THEN ({0})::BIGINT::VARCHAR ELSE ({0})::VARCHAR END"
ORACLES = {k: sql for k, (_, sql) in OPERATORS.items()} | {
    "geom_not": f"WITH {FOOT} " + " UNION ALL ".join(f"SELECT '{op}' AS op, count(*) AS n, count(DISTINCT file_id) AS files FROM f WHERE NOT ({e})" for op, e in SQL.items()),
    "geom_conjunction": f"WITH {FOOT} SELECT file_id, idx AS index, v FROM f WHERE {SQL['overlaps']} AND lon <= axmax AND NOT (l >= 0 AND r <= 360 AND b >= -90 AND t <= 10) AND NOT lon > 360",
    "file_pruning": _implied(),
    "st_within": f"WITH {CATALOG}, e(x1, y1, x2, y2) AS (VALUES {_EDGES}) SELECT id FROM c WHERE (SELECT count(*) FROM e WHERE (y1 > ymin) <> (y2 > ymin) AND xmin < (x2 - x1) * (ymin - y1) / (y2 - y1) + x1) % 2 = 1",
    "st_contains": f"WITH {CATALOG} SELECT id FROM c WHERE (ceil(xmin) + 0.9375 - xmin) + (ceil(ymin) + 0.75 - ymin) < 2.5",
    "st_astext": f"WITH {CATALOG} SELECT id, 'POINT(' || {_T.format('xmin')} || ' ' || {_T.format('ymin')} || ')' AS point, 'POLYGON((' || "
    + " || ',' || ".join(f"{_T.format(x)} || ' ' || {_T.format(y)}" for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymin")))
    + " || '))' AS polygon FROM c",
    "st_geomfromtext": f"WITH {CATALOG} SELECT id, CASE WHEN id % 10 <> 0 THEN 4 END AS n, CASE WHEN id % 10 <> 0 THEN xmax END AS x, CASE WHEN id % 10 <> 0 THEN ymax END AS y FROM c",
    "st_bounds": f"WITH {CATALOG} SELECT id, xmin, ymin - 1 AS ymin, xmax, ymax FROM c",
}
