"""File-level conditions that pixel-level ones imply.

A pixel lies in its file's footprint: on either axis F.min <= P.min <= P.max <= F.max for
the file's box F and the pixel's P. So whichever bound of P is at most (or below) a value,
F.min is too; whichever is at least (or above) it, F.max is too. An operator is a
conjunction of comparisons, so it implies the conjunction of what each of them does; its
negation is a disjunction of opposite comparisons, and implies the disjunction. These
conditions filter the catalog before any array is read.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column

from .geometry import COMPARISONS, OPPOSITE, SIGNS


def _implied(bound: str, sign: str, value: Column, file_box: Column) -> Column:
    """What ``P.bound sign value`` implies for the file."""
    return SIGNS[sign](file_box[bound[0] + ("min" if sign in ("<", "<=") else "max")], value)


def file_condition(op: str, negated: bool, file_box: Column, a: Column) -> Column:
    """What ``[not] pixel op a`` implies for the file."""
    if negated:
        return reduce(operator.or_, (_implied(x, OPPOSITE[sign], a[y], file_box) for x, sign, y in COMPARISONS[op]))
    return reduce(operator.and_, (_implied(x, sign, a[y], file_box) for x, sign, y in COMPARISONS[op]))
