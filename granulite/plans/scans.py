"""Scans, sources and the catalog's sinks."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ..operators import decode, geometry
from ..sources import catalog as cat
from ..sources.drivers import chunks
from ..sources.scan import Geo, estimated, register, sampled
from .fixtures import CATALOG, file_box, FILES, PIXELS, RICH_1X, RICH_2X, TABLE, catalog, file_catalog, files, pixels, rich, rich_catalog, rich_files

#: A region as a ring.
REGION = [(-60.0, -40.0), (20.0, -50.0), (60.0, 30.0), (-20.0, 45.0)]
GRID = dataclasses.replace(TABLE, driver="grid", lines=8)


def pixel_scan(spark, sf_dir):
    inside = pixels(spark, sf_dir, ["file_id", "line_id", "sample_id", "point", "v"], geo=(Geo("within", geometry.box_of(REGION)),), file_box=file_box())
    return inside.where(geometry.in_polygon(F.col("point"), geometry.ring_of(REGION))).select("file_id", "line_id", "sample_id", "v")


def _edges() -> str:
    ring = [*REGION, REGION[0]]
    return ", ".join(f"({x1}, {y1}, {x2}, {y2})" for (x1, y1), (x2, y2) in zip(ring, ring[1:]))


def swath_chunks(spark, sf_dir):
    return chunks(files(spark, sf_dir), TABLE, ["raw"]).select("file_id", "chunk_start", "lines", "samples", F.size("raw").alias("n"), F.get("raw", F.lit(0)).alias("first_raw"))


def grid_scan(spark, sf_dir):
    return pixels(spark, sf_dir, ["file_id", "index", "raw"], table=GRID)


def catalog_scan(spark, sf_dir):
    return cat.scan(catalog(spark, sf_dir), ["id", "starttime", "tile", "id"], F.col("is_terra"), "id", True, 25)


def catalog_count(spark, sf_dir):
    return catalog(spark, sf_dir).agg(F.count(F.lit(1)).alias("files"))


def dataset_name(spark, sf_dir):
    c = catalog(spark, sf_dir).where("mod09 is not null")
    return c.select("id", decode.dataset_name('HDF4:"%f":grid%%1', F.col("mod09")).alias("dataset"))


def prefix_slice(spark, sf_dir):
    """Plane 1 of 3, with its own scale and offset from the file's attributes; a file without scales isn't scaled."""
    return rich(spark, sf_dir, ["file_id", "index", "band"]).withColumnRenamed("band", "value")


def missing_product(spark, sf_dir):
    """A granule without geolocation is left out, a missing product of another is null."""
    return rich(spark, sf_dir, ["file_id", "index", "a"], RICH_2X).withColumnRenamed("a", "value")


def path_not_null(spark, sf_dir):
    """``a is not null``: files without its product aren't opened, and each pixel is looked at."""
    return rich(spark, sf_dir, ["file_id", "index", "a"], present=("a",))


def sql_view(spark, sf_dir):
    """A pixel table as a view, asked in SQL."""
    register(rich_catalog(spark, sf_dir), rich_files(spark, sf_dir), {"rich_pixels": RICH_1X})
    return spark.sql("SELECT label, count(*) AS n, sum(raw) AS s, count(point) AS placed FROM rich_pixels WHERE misfit IS NOT NULL GROUP BY label")


def size_estimate(spark, sf_dir):
    return estimated(rich_catalog(spark, sf_dir).where("path_geo is not null"), rich_files(spark, sf_dir), RICH_2X)


def sample_rows(spark, sf_dir):
    """A hundred random pixels of random files: the limit is what sampling is."""
    return sampled(file_catalog(spark, sf_dir), files(spark, sf_dir), TABLE, ["file_id", "index", "v"], 100, seed=7)


def _announced(spark, sf_dir):
    c = catalog(spark, sf_dir)
    product = F.element_at(F.array(*(F.lit(x) for x in ("03", "09", "14"))), (F.col("id") % 3 + 1).cast("int"))
    path = F.concat(F.lit("/in/"), F.when(F.col("is_terra"), "MOD").otherwise("MYD"), product, F.lit(".A"), (F.col("id") % 50).cast("string"), F.lit(".hdf"))
    path = F.when(F.col("id") % 11 == 0, F.concat(F.lit("/in/README"), F.col("id").cast("string"))).otherwise(path)
    start = F.date_trunc("month", "starttime")
    coarse = {k: (F.floor(F.col(k) / 90) * 90.0 + (90 if k.endswith("max") else 0)).alias(k) for k in ("xmin", "ymin", "xmax")}
    return c.select(start.alias("starttime"), (start + F.expr("interval 5 minutes")).alias("stoptime"), *coarse.values(), path.alias("path"), F.when(F.col("id") % 13 == 0, 90.0).otherwise(F.round(F.col("ymax") / 90) * 45.0).alias("ymax"), (F.floor(F.col("id") / 2) % 2 == 1).alias("odd"))


ANNOUNCED = f"""WITH {CATALOG}, f AS (SELECT date_trunc('month', starttime)::TIMESTAMP AS starttime,
  CASE WHEN id % 11 = 0 THEN '/in/README' || id ELSE '/in/' || CASE WHEN is_terra THEN 'MOD' ELSE 'MYD' END || ['03', '09', '14'][id % 3 + 1] || '.A' || (id % 50) || '.hdf' END AS path,
  CASE WHEN id % 13 = 0 THEN 90.0 ELSE round(ymax / 90) * 45 END AS ymax, floor(xmin / 90) * 90 AS xmin, floor(ymin / 90) * 90 AS ymin, floor(xmax / 90) * 90 + 90 AS xmax, id // 2 % 2 = 1 AS odd FROM c),
  p AS (SELECT starttime, starttime + INTERVAL 5 MINUTE AS stoptime, xmin, ymin, xmax, ymax, odd, 'mod' || split_part(substr(path, 8), '.', 1) AS product, path FROM f WHERE path NOT LIKE '%README%' AND ymax < 90)"""


def catalog_ingest(spark, sf_dir):
    return cat.ingest(_announced(spark, sf_dir))


def catalog_pivot(spark, sf_dir):
    return cat.upsert(cat.ingest(_announced(spark, sf_dir)), ["starttime"], ["mod03", "mod09", "mod14"])


#: Start, stop and footprint tell granules apart.
GRANULE = ("starttime", "stoptime", "xmin", "ymin", "xmax", "ymax")


def catalog_upsert(spark, sf_dir):
    """Granules of odd ids come into a catalog of the even ones, which has no column for one of their products."""
    files_ = _announced(spark, sf_dir)
    old = cat.upsert(cat.ingest(files_.where("not odd"), key=GRANULE), list(GRANULE), ["mod03", "mod09"]).withColumn("origin", F.lit("old"))
    return cat.merged(old, cat.ingest(files_.where("odd"), key=GRANULE), list(GRANULE), ["mod03", "mod09", "mod14"])


def bbox_footprint(spark, sf_dir):
    b = cat.bbox_footprint(F.col("xmin"), F.col("xmax"), F.col("ymin"), F.col("ymax"))
    return catalog(spark, sf_dir).select("id", b.alias("b")).select("id", "b.xmin", "b.ymin", "b.xmax", "b.ymax")


def catalog_union_all(spark, sf_dir):
    c = catalog(spark, sf_dir)
    aqua, terra = c.where("not is_terra").select("id", "tile", F.lit("aqua").alias("platform")), c.where("is_terra").select("id", "tile", F.lit("terra").alias("platform"))
    return cat.union_all(aqua, terra)


def column_pruning(spark, sf_dir):
    return catalog(spark, sf_dir).select("id", "tile")


QUERIES = {f.__name__: f for f in (pixel_scan, swath_chunks, grid_scan, catalog_scan, catalog_count, dataset_name, prefix_slice, missing_product, sample_rows, path_not_null, sql_view, size_estimate, catalog_ingest, catalog_pivot, catalog_upsert, bbox_footprint, catalog_union_all, column_pruning)}
_G = ", ".join(GRANULE)
ORACLES = {
    "pixel_scan": f"""WITH {PIXELS}, e(x1, y1, x2, y2) AS (VALUES {_edges()}),
x AS (SELECT p.*, (SELECT count(*) FROM e WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) AS n FROM px p)
SELECT file_id, line_id, sample_id, v FROM x WHERE n % 2 = 1""",
    "swath_chunks": f"""WITH {FILES} SELECT file_id, s::INT AS chunk_start, 4 AS lines, 8 AS samples, 32 AS n, floor(embedding[s + 1]::DOUBLE * 1000)::INT AS first_raw FROM g, (VALUES (0), (32)) t(s)""",
    "grid_scan": f"WITH {PIXELS} SELECT file_id, idx AS index, raw FROM px",
    "catalog_scan": f"WITH {CATALOG} SELECT id, starttime, tile FROM c WHERE is_terra ORDER BY id DESC LIMIT 25",
    "catalog_count": "SELECT count(*) AS files FROM orders",
    "dataset_name": f"""WITH {CATALOG} SELECT id, 'HDF4:"' || mod09 || '":grid%1' AS dataset FROM c WHERE mod09 IS NOT NULL""",
    "prefix_slice": f"WITH {PIXELS} SELECT file_id, idx AS index, CASE WHEN file_id % 4 = 0 THEN raw + 998.0::DOUBLE ELSE 0.25::DOUBLE * (raw + 998) END AS value FROM px",
    "missing_product": f"WITH {PIXELS} SELECT file_id, idx AS index, CASE WHEN file_id % 7 <> 0 AND raw <> 100 THEN raw END AS value FROM px WHERE file_id % 5 <> 0",
    "path_not_null": f"WITH {PIXELS} SELECT file_id, idx AS index, raw AS a FROM px WHERE file_id % 7 <> 0 AND raw <> 100",
    "sql_view": f"WITH {PIXELS} SELECT label, count(*) AS n, sum(raw)::BIGINT AS s, count(*) AS placed FROM px WHERE file_id % 3 <> 0 GROUP BY 1",
    "size_estimate": "SELECT count(*) AS files, 64 * count(*) AS pixels FROM embeddings WHERE vec_id % 5 <> 0",
    "catalog_ingest": f"{ANNOUNCED} SELECT starttime, product, max(path) AS path FROM p GROUP BY 1, 2",
    "catalog_pivot": f"{ANNOUNCED} SELECT starttime, " + ", ".join(f"max(path) FILTER (WHERE product = '{x}') AS {x}" for x in ("mod03", "mod09", "mod14")) + " FROM p GROUP BY 1",
    "catalog_upsert": f"{ANNOUNCED}, e AS (SELECT {_G}, max(path) FILTER (WHERE product = 'mod03') AS a, max(path) FILTER (WHERE product = 'mod09') AS b, 'old' AS origin FROM p WHERE NOT odd GROUP BY {_G}), "
    + f"n AS (SELECT {_G}, " + ", ".join(f"max(path) FILTER (WHERE product = '{x}') AS {x}" for x in ("mod03", "mod09", "mod14")) + f" FROM p WHERE odd GROUP BY {_G}) SELECT {_G}, coalesce(mod03, a) AS mod03, coalesce(mod09, b) AS mod09, mod14, origin FROM e FULL JOIN n USING ({_G})",
    "bbox_footprint": f"WITH {CATALOG} SELECT id, CASE WHEN xmin >= 0 THEN xmin WHEN xmax >= 0 THEN 0 ELSE xmin + 360 END AS xmin, ymin, CASE WHEN xmin < 0 AND xmax >= 0 THEN 360 WHEN xmax < 0 THEN xmax + 360 ELSE xmax END AS xmax, ymax FROM c",
    "catalog_union_all": f"WITH {CATALOG} SELECT id, tile, 'aqua' AS platform FROM c WHERE NOT is_terra UNION ALL SELECT id, tile, 'terra' FROM c WHERE is_terra",
    "column_pruning": f"WITH {CATALOG} SELECT id, tile FROM c",
}
