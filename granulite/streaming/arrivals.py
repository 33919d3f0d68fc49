"""Files that arrive in a folder, as rows of the catalog.

An archive that still receives files is read as a stream of announcements. Late
files are accepted for as long as the watermark allows, and a file that is announced
twice is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.catalog import product_of


def arriving(spark: SparkSession, folder: str, schema: StructType, late: str = "1 day") -> DataFrame:
    """(starttime, product, path) of announced files; schema has path and starttime."""
    files = spark.readStream.schema(schema).parquet(folder)
    named = files.withColumn("product", product_of(F.col("path"))).where(F.col("product").isNotNull())
    return named.withWatermark("starttime", late).dropDuplicatesWithinWatermark(["path"]).select("starttime", "product", "path")


def per_hour(arrived: DataFrame) -> DataFrame:
    """How many files of each product each hour has."""
    return arrived.groupBy(F.window("starttime", "1 hour").alias("hour"), "product").agg(F.count(F.lit(1)).alias("files"))
