"""Joins of ranges and of boxes that overlap, by cells of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import OPERATORS


def _cells(b: Column, cell: float) -> Column:
    """The grid cells that a box touches."""
    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(b[lo] / cell), F.floor(b[hi] / cell))

    return F.flatten(F.transform(span("xmin", "xmax"), lambda i: F.transform(span("ymin", "ymax"), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def box_join(left: DataFrame, a: str, right: DataFrame, b: str, cell: float) -> DataFrame:
    """Pairs of rows whose boxes overlap, each once.

    Both sides are dealt to the cells they touch and joined on the cell: an equi-join,
    which neither broadcasts a side nor compares all pairs. Of the cells that both boxes
    touch only the one of the overlap's lower left corner keeps the pair. cell: about
    the size of a box. A null box joins nothing.
    """
    x = left.where(F.col(a).isNotNull()).withColumn("__c", F.explode(_cells(F.col(a), cell)))
    y = right.where(F.col(b).isNotNull()).withColumn("__c", F.explode(_cells(F.col(b), cell)))
    both = x.join(y, "__c").where(OPERATORS["overlaps"](F.col(a), F.col(b)))
    corner_i = F.floor(F.greatest(F.col(a)["xmin"], F.col(b)["xmin"]) / cell)
    corner_j = F.floor(F.greatest(F.col(a)["ymin"], F.col(b)["ymin"]) / cell)
    return both.where((F.col("__c")["i"] == corner_i) & (F.col("__c")["j"] == corner_j)).drop("__c")


def range_join(left: DataFrame, low: str, high: str, right: DataFrame, value: str, cell: int) -> DataFrame:
    """Pairs of rows of left and right with low <= value < high, each once.

    Ranges are dealt to the cells of ``cell`` integers that they touch, values to theirs,
    and both are joined on the cell: an equi-join. cell: about the length of a range. Null
    bounds and values and empty ranges join nothing.
    """
    x = left.where(F.col(low) < F.col(high)).withColumn("__c", F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(high) - 1) / cell))))
    y = right.withColumn("__c", F.floor(F.col(value) / cell))
    return x.join(y, "__c").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__c")
