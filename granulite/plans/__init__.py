"""Queries by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decoding, grids, places, relational, scans

MODULES = (scans, decoding, places, relational, grids)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pixels within a polygon, in order: the catalog is pruned, then pixels are tested."""
    return scans.pixel_scan(spark, sf_dir).orderBy("file_id", "line_id", "sample_id").limit(10)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
