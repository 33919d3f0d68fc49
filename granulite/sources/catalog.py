"""The catalog: one row for each granule in time and space, with a path for each product."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: product, two digits of collection and file name of a path: M?D<product>.<...>.hdf
PRODUCT = r"M[OY]D([^./]*)\.[^/]*\.hdf$"


def scan(catalog: DataFrame, columns: list[str], where: Column | None = None, order_by: str | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """The catalog's rows as a scan asks for them; columns named twice are read once."""
    if not columns:
        raise ValueError("a catalog scan reads at least one column")
    out = catalog if where is None else catalog.where(where)
    if order_by is not None:
        by = F.col(order_by)
        out = out.orderBy(by.desc() if descending else by)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*dict.fromkeys(columns))


def sample(catalog: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """max(5, rows / 100) random files, for statistics on pixels."""
    return catalog.orderBy(F.rand(seed)).limit(max(5, rows // 100))


def bbox_footprint(west: Column, east: Column, south: Column, north: Column) -> Column:
    """A granule's box from its bounds, with longitudes from 0: bounds in the negative range move by 360.

    A granule over the prime meridian, from a negative west to an east of 0 or more, has
    places at both ends of that range: its box goes all the way round.
    """
    round_ = (west < 0) & (east >= 0)
    low, high = (F.when(x < 0, x + 360.0).otherwise(x) for x in (west, east))
    return F.struct(F.when(round_, 0.0).otherwise(low).alias("xmin"), south.alias("ymin"), F.when(round_, 360.0).otherwise(high).alias("xmax"), north.alias("ymax"))


def product_of(path: Column) -> Column:
    """The product that a file's name says, in lower case; null for other files."""
    found = F.regexp_extract(path, PRODUCT, 1)
    return F.when(found != "", F.concat(F.lit("mod"), F.lower(found)))


def ingest(files: DataFrame, polar: float = 90.0, key: tuple[str, ...] = ("starttime",)) -> DataFrame:
    """(key, product, path) of each granule's products; of several files of one the last by name.

    files: path, ymax and the columns of key. Files of no product and granules that reach the
    pole are left out.
    """
    named = files.withColumn("product", product_of(F.col("path"))).where(F.col("product").isNotNull() & (F.col("ymax") < polar))
    return named.groupBy(*key, "product").agg(F.max("path").alias("path"))


def upsert(files: DataFrame, key: list[str], products: list[str]) -> DataFrame:
    """A row for each granule with a path column for each product: inserts and updates at once."""
    return files.groupBy(*key).pivot("product", products).agg(F.max("path"))


def merged(existing: DataFrame, files: DataFrame, key: list[str], products: list[str]) -> DataFrame:
    """The catalog after new files: their paths replace those of granules that are there, other granules come in.

    key: what tells granules apart (start, stop and footprint; nulls are equal). A product
    that the catalog has no column for gets one, and its other columns stay.
    """
    new = upsert(files, key, products)
    had = [p for p in products if p in existing.columns]
    old = existing.withColumn("__old", F.lit(True))
    both = old.alias("o").join(new.alias("n"), reduce(and_, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key)), "full_outer")
    keys = [F.when(F.col("o.__old"), F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in key]
    paths = [(F.coalesce(f"n.{p}", f"o.{p}") if p in had else F.col(f"n.{p}")).alias(p) for p in products]
    rest = [F.col(f"o.{c}") for c in existing.columns if c not in key and c not in products]
    return both.select(*keys, *rest, *paths)


def union_all(*catalogs: DataFrame) -> DataFrame:
    out = catalogs[0]
    for c in catalogs[1:]:
        out = out.unionByName(c)
    return out


def write(catalog: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes a catalog anew; one that is merged into what it was read from goes to another path."""
    w = catalog.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
