"""The archive that queries run over, made from the star schema's tables.

``orders`` is a catalog of granules, ``embeddings`` an archive of files of 8 x 8 pixels,
``lineitem`` pixels with attributes. Coordinates are multiples of 1/8, so results are
exact. Each DataFrame has the same definition as DuckDB SQL.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry
from ..spec import Column, Geolocation, Role, Table

LINES = SAMPLES = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")

    def path(product: str, every: int):
        return F.when(key % every != 0, F.concat(F.lit(product + "/"), key.cast("string"), F.lit(".hdf"))).alias(product)

    xmin, ymin = (F.col("o_custkey") * 37 % 1440) / 4.0 - 180, (F.col("o_custkey") * 53 % 640) / 4.0 - 80
    return o.select(
        key.alias("id"), F.col("o_orderdate").alias("starttime"), (F.col("o_orderdate") + F.expr("interval 5 minutes")).alias("stoptime"), (key % 2 == 0).alias("is_terra"),
        path("mod03", 7), path("mod09", 5), F.concat(F.lit("h"), F.lpad((F.col("o_custkey") % 36).cast("string"), 2, "0")).alias("tile"),
        xmin.alias("xmin"), ymin.alias("ymin"), (xmin + 2.5).alias("xmax"), (ymin + 2.5).alias("ymax"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"),
    )


CATALOG = """c AS (SELECT o_orderkey AS id, o_orderdate AS starttime, o_orderdate + INTERVAL 5 MINUTE AS stoptime, o_orderkey % 2 = 0 AS is_terra,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'mod03/' || o_orderkey || '.hdf' END AS mod03, CASE WHEN o_orderkey % 5 <> 0 THEN 'mod09/' || o_orderkey || '.hdf' END AS mod09,
  'h' || lpad((o_custkey % 36)::VARCHAR, 2, '0') AS tile, (o_custkey * 37 % 1440) / 4.0 - 180 AS xmin, (o_custkey * 53 % 640) / 4.0 - 80 AS ymin,
  (o_custkey * 37 % 1440) / 4.0 - 180 + 2.5 AS xmax, (o_custkey * 53 % 640) / 4.0 - 80 + 2.5 AS ymax, o_totalprice AS price, o_orderpriority AS priority FROM orders)"""


def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of the archive of small files."""
    key = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(key.alias("file_id"), "label", ((key * 37 % 1440) / 4.0 - 180).alias("lon0"), ((key * 53 % 640) / 4.0 - 80).alias("lat0"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its layers: v, and raw, which is v as integers of a thousandth."""
    v = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), v.alias("v"), F.transform(v, lambda x: F.floor(x * 1000).cast("int")).alias("raw"))


FILES = """g AS (SELECT vec_id AS file_id, label, embedding, (vec_id * 37 % 1440) / 4.0 - 180 AS lon0, (vec_id * 53 % 640) / 4.0 - 80 AS lat0 FROM embeddings)"""
PIXELS = (
    FILES
    + """, px AS (SELECT file_id, label, lon0, lat0, i::INT AS idx, (i // 8)::INT AS line_id, (i % 8)::INT AS sample_id, embedding[i + 1]::DOUBLE AS v,
  floor(embedding[i + 1]::DOUBLE * 1000)::INT AS raw, lon0 + (i % 8 + 0.5) / 8 AS lon, lat0 + 1 - (i // 8 + 0.5) / 8 AS lat FROM g, (SELECT unnest(range(64)) AS i) u)"""
)


def file_box():
    """A file's box, in the catalog."""
    return geometry.box(F.col("lon0"), F.col("lat0"), F.col("lon0") + 1, F.col("lat0") + 1)


def centre() -> tuple:
    return F.col("lon0") + (F.col("sample") + 0.5) / 8, F.col("lat0") + 1 - (F.col("line") + 0.5) / 8


def corners() -> list:
    x, y = F.col("lon0") + F.col("sample") / 8, F.col("lat0") + 1 - F.col("line") / 8
    return [(x, y), (x + 0.125, y), (x + 0.125, y - 0.125), (x, y - 0.125)]


TABLE = Table(
    "pixels",
    (
        Column("file_id", Role.CATALOG), Column("label", Role.CATALOG), Column("lon0", Role.CATALOG), Column("lat0", Role.CATALOG),
        Column("index", Role.INDEX), Column("line_id", Role.LINE), Column("sample_id", Role.SAMPLE), Column("point", Role.POINT), Column("footprint", Role.FOOTPRINT),
        Column("v", type="float8"), Column("raw", type="int4"),
        Column("filled", type="int4", dataset="raw", fill=100), Column("ranged", dataset="raw", valid_range=(-150, 150)), Column("scaled", dataset="raw", scale=0.5, offset=4.0),
        Column("inverse", dataset="raw", scale=4.0, offset=1.0, inverse_scale=True), Column("first", type="int4", dataset="raw", constant=True), Column("short", type="int2", dataset="raw"),
    ),
)


def pixels(spark: SparkSession, sf_dir: str, columns: list[str], **options) -> DataFrame:
    from ..sources.scan import pixel_scan

    table = options.pop("table", TABLE)
    return pixel_scan(file_catalog(spark, sf_dir), files(spark, sf_dir), table, columns, point=centre(), corners=corners(), **options)


def rich_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' catalog with paths of two products, some of them missing."""
    def path(name: str, every: int):
        return F.when(F.col("file_id") % every != 0, F.concat(F.lit(name + "/"), F.col("file_id").cast("string"))).alias(name)

    return file_catalog(spark, sf_dir).select("file_id", "label", path("path_a", 7), path("path_geo", 5))


def rich_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 8 x 8 pixels with layers of all shapes, made from ``raw``.

    coarse: 4 x 4 values. post: 2 bytes for each pixel. planes: 2 planes of bytes. bands:
    3 planes, with attributes, the scales missing in every fourth file. misfit: too short
    in every third. lat2 and lon2, lat1 and lon1: coordinates of 2 x 2 pixels and of each.
    """
    f = files(spark, sf_dir).select("file_id", "raw")
    f = f.withColumns({"lon0": (F.col("file_id") * 37 % 1440) / 4.0 - 180, "lat0": (F.col("file_id") * 53 % 640) / 4.0 - 80})
    byte = lambda x, k: F.pmod(x * k, F.lit(256))
    raw, near = F.col("raw"), lambda a, origin: F.transform(a, lambda x: F.col(origin) + x / 1000.0)
    return f.select(
        "file_id", "raw", F.slice(raw, 1, 16).alias("coarse"), F.flatten(F.transform(raw, lambda x: F.array(byte(x, 1), byte(x, 7)))).alias("post"),
        F.concat(F.transform(raw, lambda x: byte(x, 3)), F.transform(raw, lambda x: byte(x, 5))).alias("planes"),
        F.concat(raw, F.transform(raw, lambda x: x + 1000), F.transform(raw, lambda x: x * 2)).alias("bands"),
        F.when(F.col("file_id") % 4 != 0, F.array(*map(F.lit, (0.5, 0.25, 2.0)))).alias("band_scales"), F.array(*map(F.lit, (1.0, 2.0, 3.0))).alias("band_offsets"),
        F.when(F.col("file_id") % 3 == 0, F.slice(raw, 1, 60)).otherwise(raw).alias("misfit"),
        near(F.slice(raw, 1, 16), "lon0").alias("lon2"), near(F.slice(raw, 17, 16), "lat0").alias("lat2"), near(raw, "lon0").alias("lon1"), near(F.reverse(raw), "lat0").alias("lat1"),
    )


RICH = Table(
    "rich",
    (
        Column("file_id", Role.CATALOG), Column("label", Role.CATALOG), Column("index", Role.INDEX), Column("point", Role.POINT), Column("footprint", Role.FOOTPRINT),
        Column("raw", type="int4"), Column("value", type="int4", dataset="coarse", hfactor=2, vfactor=2), Column("post", type="bit", bits=16), Column("planes", type="bit", bits=16, bitmap_prefix=True),
        Column("band", dataset="bands", prefix=(1,), dims=(3,), scale_name="band_scales", offset_name="band_offsets"), Column("misfit", type="int4"), Column("a", type="int4", dataset="raw", fill=100, product="path_a"),
    ),
    shift_longitude=True,
)
RICH_2X = dataclasses.replace(RICH, geolocation=Geolocation("lat2", "lon2", 2, "path_geo"))
RICH_1X = dataclasses.replace(RICH, geolocation=Geolocation("lat1", "lon1"))


def rich(spark: SparkSession, sf_dir: str, columns: list[str], table: Table = RICH, **options) -> DataFrame:
    from ..sources.scan import pixel_scan

    return pixel_scan(rich_catalog(spark, sf_dir), rich_files(spark, sf_dir), table, columns, **options)
