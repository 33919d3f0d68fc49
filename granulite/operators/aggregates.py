"""Dense counts over a cube of index columns, and area-weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_count(df: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows by cell; bounds: lower and upper (exclusive) of each index column. Rows with a null or out of bounds don't count."""
    inside = F.lit(True)
    for c, (lo, hi) in bounds.items():
        inside = inside & (F.col(c) >= lo) & (F.col(c) < hi)
    return df.where(inside).groupBy(*bounds).agg(F.count(F.lit(1)).alias("n"))


def table_count_dense(df: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """table_count with every cell of the cube, 0 where no row is.

    The cube's size is that of its bounds, not of the data.
    """
    cube = df.sparkSession.range(1).select()
    for c, (lo, hi) in bounds.items():
        cube = cube.select("*", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias(c)) if hi > lo else cube.select("*", F.lit(lo).alias(c)).where("false")
    counts = table_count(df.select(*(F.col(c).cast("int").alias(c) for c in bounds)), bounds)
    return cube.join(counts, list(bounds), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def count_cube(df: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """table_count_dense as one row: nested arrays of counts, in the order of the dimensions."""
    dense, dims = table_count_dense(df, bounds), list(bounds)
    value: Column = F.col("n")
    for i in range(len(dims) - 1, -1, -1):
        rest = dims[:i]
        dense = dense.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct(F.col(dims[i]).alias("k"), value.alias("v")))).alias("a"))
        dense = dense.withColumn("n", F.transform("a", lambda s: s["v"])).drop("a")
        value = F.col("n")
    return dense.select(F.col("n").alias("counts"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
