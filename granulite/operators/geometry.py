"""Boxes, rings and the sixteen bounding-box operators, as native expressions.

A box is a struct (xmin, ymin, xmax, ymax) of doubles, a point a struct (x, y), a ring
an array of points. Comparisons of nulls are null, so a filter drops pixels without a
place.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(xmin, ymin, xmax, ymax) -> Column:
    values = [x if isinstance(x, Column) else F.lit(float(x)) for x in (xmin, ymin, xmax, ymax)]
    return F.struct(*(v.cast("double").alias(n) for v, n in zip(values, ("xmin", "ymin", "xmax", "ymax"))))


def _known(x: Column, y: Column, lon=(-180.0, 360.0), lat=(-90.0, 90.0)) -> Column:
    return x.between(*lon) & y.between(*lat)


def point(x: Column, y: Column, lon=(-180.0, 360.0), lat=(-90.0, 90.0)) -> Column:
    """A point, or null where a coordinate is out of range."""
    return F.when(_known(x, y, lon, lat), F.struct(x.alias("x"), y.alias("y")))


def point_box(p: Column) -> Column:
    return F.when(p.isNotNull(), box(p["x"], p["y"], p["x"], p["y"]))


def ring(*corners: tuple[Column, Column]) -> Column:
    """A closed ring from its corners; null where a corner is out of range."""
    places = [point(x, y) for x, y in corners]
    whole = places[0].isNotNull()
    for p in places[1:]:
        whole = whole & p.isNotNull()
    return F.when(whole, F.array(*places, places[0]))


def corners_box(*corners: tuple[Column, Column]) -> Column:
    """The box of the ring of these corners, from their coordinates alone: no array is made."""
    xs, ys = zip(*corners)
    whole = reduce(operator.and_, (_known(x, y) for x, y in corners))
    return F.when(whole, box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)))


def ring_box(r: Column) -> Column:
    """The box of a ring."""
    return F.when(r.isNotNull(), box(F.array_min(r["x"]), F.array_min(r["y"]), F.array_max(r["x"]), F.array_max(r["y"])))


#: Each operator of a pixel's box and an argument's, as the comparisons it's made of: a bound of the pixel's, a sign, a bound of the argument's.
COMPARISONS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "overlaps": (("xmin", "<=", "xmax"), ("xmax", ">=", "xmin"), ("ymin", "<=", "ymax"), ("ymax", ">=", "ymin")),
    "contains": (("xmin", "<=", "xmin"), ("xmax", ">=", "xmax"), ("ymin", "<=", "ymin"), ("ymax", ">=", "ymax")),
    "within": (("xmin", ">=", "xmin"), ("xmax", "<=", "xmax"), ("ymin", ">=", "ymin"), ("ymax", "<=", "ymax")),
    "same": tuple((k, sign, k) for k in ("xmin", "xmax", "ymin", "ymax") for sign in ("<=", ">=")),
    "overleft": (("xmax", "<=", "xmax"),), "overright": (("xmin", ">=", "xmin"),), "overabove": (("ymin", ">=", "ymin"),), "overbelow": (("ymax", "<=", "ymax"),),
    "left": (("xmax", "<", "xmin"),), "right": (("xmin", ">", "xmax"),), "above": (("ymin", ">", "ymax"),), "below": (("ymax", "<", "ymin"),),
    "comm_left": (("xmax", ">=", "xmax"),), "comm_right": (("xmin", "<=", "xmin"),), "comm_above": (("ymin", "<=", "ymin"),), "comm_below": (("ymax", ">=", "ymax"),),
}

SIGNS: dict[str, Callable[[Column, Column], Column]] = {"<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}
OPPOSITE = {"<=": ">", ">=": "<", "<": ">=", ">": "<="}


def _operator(comparisons: tuple[tuple[str, str, str], ...]) -> Callable[[Column, Column], Column]:
    return lambda p, a: reduce(operator.and_, (SIGNS[sign](p[x], a[y]) for x, sign, y in comparisons))


#: By name: the operator of a pixel's box p and an argument's box a.
OPERATORS = {name: _operator(c) for name, c in COMPARISONS.items()}

#: The operator that holds with its sides exchanged.
SWAPPED = {
    "overlaps": "overlaps", "contains": "within", "within": "contains", "same": "same", "left": "right", "right": "left", "above": "below", "below": "above",
    "overleft": "comm_left", "overright": "comm_right", "overabove": "comm_above", "overbelow": "comm_below",
    "comm_left": "overleft", "comm_right": "overright", "comm_above": "overabove", "comm_below": "overbelow",
}


def apply(op: str, p: Column, a: Column, negated: bool = False) -> Column:
    e = OPERATORS[op](p, a)
    return ~e if negated else e


def _crossings(p: Column, r: Column) -> Column:
    """How many edges of a ring lie right of a point."""

    def crossed(a: Column, b: Column) -> Column:
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    edges = F.slice(F.sequence(F.lit(0), F.size(r)), 2, F.greatest(F.size(r) - 1, F.lit(0)))
    return F.aggregate(edges, F.lit(0), lambda n, i: n + F.when(crossed(F.get(r, i - 1), F.get(r, i)), 1).otherwise(0))


def in_polygon(p: Column, r: Column) -> Column:
    """Whether a point lies inside a ring (even-odd rule; the ring's edges are closed by its first point).

    Point and ring are bound to a variable first, so each is computed once: what a lambda
    names is computed anew wherever it stands, for each edge.
    """
    bound = F.transform(F.array(F.struct(p.alias("p"), r.alias("r"))), lambda s: _crossings(s["p"], s["r"]))
    return F.get(bound, F.lit(0)) % 2 == 1


def ring_of(points: list[tuple[float, float]]) -> Column:
    """A literal closed ring."""
    if points[0] != points[-1]:
        points = [*points, points[0]]
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def box_of(points: list[tuple[float, float]]) -> Column:
    xs, ys = zip(*points)
    return box(min(xs), min(ys), max(xs), max(ys))


def st_within(p: Column, points: list[tuple[float, float]]) -> Column:
    """Exact containment of a point: the cheap box test first, then the ring."""
    a = box_of(points)
    return OPERATORS["within"](point_box(p), a) & in_polygon(p, ring_of(points))


def st_contains(r: Column, p: Column) -> Column:
    """Whether a ring contains a point."""
    return OPERATORS["contains"](ring_box(r), point_box(p)) & in_polygon(p, r)
