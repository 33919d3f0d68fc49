"""Polygon x grid joins, dense counts and regridding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, geometry, gridjoin
from .fixtures import CATALOG, PIXELS, catalog, pixels, read


def _boxes(spark, sf_dir):
    """Granules' boxes as rings, on coordinates moved by a sixteenth."""
    c = catalog(spark, sf_dir)
    x0, y0, x1, y1 = (F.col(k) + 0.0625 for k in ("xmin", "ymin", "xmax", "ymax"))
    return c.select("id", F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))).alias("ring"))


def grid_join(spark, sf_dir):
    out = gridjoin.grid_join(_boxes(spark, sf_dir), "ring", 0.5, -2.0, 0.25, 1.0, keep=["id"])
    return out.withColumn("ratio", F.round("ratio", 9))


def grid_join_area(spark, sf_dir):
    out = gridjoin.grid_join_area(_boxes(spark, sf_dir), "ring", 40, 20, -100.0, 50.0, 100.0, -50.0, keep=["id"])
    return out.withColumn("ratio", F.round("ratio", 9))


def regrid_mean(spark, sf_dir):
    """Pixels' values on a grid of half degrees, weighted by what footprints cover."""
    px = pixels(spark, sf_dir, ["footprint", "raw"])
    out = gridjoin.grid_join(px, "footprint", 0.3125, 0.3125, keep=["raw"])
    return out.groupBy("i", "j").agg(F.round(aggregates.weighted_mean("raw", "ratio"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


BOUNDS = {"a": (2, 7), "b": (0, 4)}


def _indexes(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem")
    return i.select((F.col("l_partkey") % 9).cast("int").alias("a"), F.when(F.col("l_suppkey") % 7 != 3, (F.col("l_suppkey") % 6).cast("int")).alias("b"))


def table_count(spark, sf_dir):
    return aggregates.table_count(_indexes(spark, sf_dir), BOUNDS)


def table_count_dense(spark, sf_dir):
    return aggregates.table_count_dense(_indexes(spark, sf_dir).where("a <> 4 or b is null"), BOUNDS)


QUERIES = {f.__name__: f for f in (grid_join, grid_join_area, regrid_mean, table_count, table_count_dense)}


def _overlap(lo: str, hi: str, cell_lo: str, cell_hi: str) -> str:
    return f"(least({hi}, {cell_hi}) - greatest({lo}, {cell_lo}))"


_B = f"WITH {CATALOG}, b AS (SELECT id, xmin + 0.0625 AS l, ymin + 0.0625 AS d, xmax + 0.0625 AS r, ymax + 0.0625 AS t FROM c)"
_I = "i AS (SELECT (l_partkey % 9)::INT AS a, CASE WHEN l_suppkey % 7 <> 3 THEN (l_suppkey % 6)::INT END AS b FROM lineitem)"
ORACLES = {
    "grid_join": f"""{_B}, u AS (SELECT id, (l - 0.25) / 0.5 AS u0, (r - 0.25) / 0.5 AS u1, (1 - t) / 2 AS v0, (1 - d) / 2 AS v1 FROM b),
x AS (SELECT *, unnest(range(floor(u0)::BIGINT, ceil(u1)::BIGINT)) AS i FROM u), y AS (SELECT *, unnest(range(floor(v0)::BIGINT, ceil(v1)::BIGINT)) AS j FROM x)
SELECT id, i, j, round({_overlap('u0', 'u1', 'i', 'i + 1')} * {_overlap('v0', 'v1', 'j', 'j + 1')}, 9) AS ratio FROM y""",
    "grid_join_area": f"""{_B}, u AS (SELECT id, (l + 100) / 5 AS u0, (r + 100) / 5 AS u1, (50 - t) / 5 AS v0, (50 - d) / 5 AS v1 FROM b),
z AS (SELECT id, i, j, {_overlap('u0', 'u1', 'i', 'i + 1')} AS w, {_overlap('v0', 'v1', 'j', 'j + 1')} AS h FROM u, (SELECT unnest(range(40))::INT AS i), (SELECT unnest(range(20))::INT AS j))
SELECT id, i, j, round(w * h, 9) AS ratio FROM z WHERE w > 0 AND h > 0""",
    "regrid_mean": f"""WITH {PIXELS}, u AS (SELECT raw, (lon - 0.0625) / 0.3125 AS u0, (lon + 0.0625) / 0.3125 AS u1, (lat - 0.0625) / 0.3125 AS v0, (lat + 0.0625) / 0.3125 AS v1 FROM px),
x AS (SELECT *, unnest(range(floor(u0)::BIGINT, ceil(u1)::BIGINT)) AS i FROM u), y AS (SELECT *, unnest(range(floor(v0)::BIGINT, ceil(v1)::BIGINT)) AS j FROM x),
w AS (SELECT i, j, raw, {_overlap('u0', 'u1', 'i', 'i + 1')} * {_overlap('v0', 'v1', 'j', 'j + 1')} AS w FROM y)
SELECT i, j, round(sum(raw * w) / sum(w), 6) AS mean, count(*) AS n FROM w WHERE w > 1e-12 GROUP BY 1, 2""",
    "table_count": f"WITH {_I} SELECT a, b, count(*) AS n FROM i WHERE a BETWEEN 2 AND 6 AND b BETWEEN 0 AND 3 GROUP BY 1, 2",
    "table_count_dense": f"WITH {_I} SELECT x::INT AS a, y::INT AS b, (SELECT count(*) FROM i WHERE a = x AND b = y AND a <> 4) AS n FROM (SELECT unnest(range(2, 7)) AS x), (SELECT unnest(range(0, 4)) AS y)",
}
