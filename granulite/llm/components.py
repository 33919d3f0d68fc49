"""Connected components of a graph given by its edges, on DataFrames.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014): every step is one aggregation and one join, edges
never grow in number by more than a constant, and the number of steps is
logarithmic in practice. Nothing of the graph reaches the driver but a count and a
checksum for each step, observed while the step's edges are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .lineage import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, cut from their lineage, with their number and a checksum."""
    seen = Observation()
    e = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
    return e, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node with an edge to another, and the least node of its component.

    edges: columns a and b, long, not null. Repeated edges and loops change nothing;
    no edges give an empty table.
    """
    e, state = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while state[0]:
        both = _both(e)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before = state
        e, state = _written(small.where("a <> b").distinct())
        if state == before:
            break
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
