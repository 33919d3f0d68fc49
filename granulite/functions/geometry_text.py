"""Geometries as text: WKT out and in, and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A ring's type.
PLACES = "array<struct<x: double, y: double>>"


def _number(v: Column) -> Column:
    """A coordinate without a fraction of zeros."""
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def point_as_text(p: Column) -> Column:
    return F.concat(F.lit("POINT("), _number(p["x"]), F.lit(" "), _number(p["y"]), F.lit(")"))


def ring_as_text(r: Column) -> Column:
    places = F.transform(r, lambda p: F.concat(_number(p["x"]), F.lit(" "), _number(p["y"])))
    return F.concat(F.lit("POLYGON(("), F.array_join(places, ","), F.lit("))"))


def ring_from_text(wkt: Column, strict: bool = False) -> Column:
    """The ring of a POLYGON of one contour; null for anything else.

    strict: anything but null, an empty polygon and one contour is an error, as for grid
    joins, which would silently cover a polygon's holes.
    """
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    body = F.regexp_extract(wkt, r"^\s*POLYGON\s*\(\(([^()]*)\)\)\s*$", 1)
    places = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda t: F.struct(F.split(t, r"\s+")[0].cast("double").alias("x"), F.split(t, r"\s+")[1].cast("double").alias("y")))
    found = F.when(body.rlike(rf"^\s*{number}\s+{number}(\s*,\s*{number}\s+{number})+\s*$"), places)
    if not strict:
        return found
    empty = wkt.isNull() | wkt.rlike(r"^\s*POLYGON\s+EMPTY\s*$")
    wrong = F.raise_error(F.concat(F.lit("not a polygon of one contour: "), F.substring(wkt, 1, 80)))
    return F.when(found.isNotNull() | empty, found).otherwise(wrong.cast(PLACES))


def bounds(r: Column) -> dict[str, Column]:
    x, y = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return {"xmin": F.array_min(x), "ymin": F.array_min(y), "xmax": F.array_max(x), "ymax": F.array_max(y)}
