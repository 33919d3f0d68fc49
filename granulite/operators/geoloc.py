"""Places of pixels: interpolation of coarse geolocation, affine grids, projections.

Interpolation has a closed form: the output at row r and column c, offset o (0 for
corners, 0.5 for centres) and factor k is the bilinear extension of the four source
values around ((r + o) / k - 0.5, (c + o) / k - 0.5), the nearest four at the edges. It's
four array lookups for each output, in a chunk's own arrays, so edges of a scan block
extrapolate from that block alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNER, CENTRE = 0.0, 0.5
#: Radius of the sphere of the sinusoidal projection, in metres.
SPHERE = 6371007.181


def cell(at: Column, n: int | Column, factor: int, offset: float) -> tuple[Column, Column]:
    """Along an axis of n source values: the first of the two around an output, and how far beyond it the output is."""
    f = (at + F.lit(offset)) / F.lit(float(factor)) - F.lit(0.5)
    i = F.least(F.greatest(F.floor(f), F.lit(0)), (F.lit(n) if isinstance(n, int) else n) - 2).cast("int")
    return i, f - i


def between(source: Column, samples: int, i: Column, a: Column, j: Column, b: Column) -> Column:
    """The value beyond row i by a and column j by b; null in a block of one line."""

    def s(di: int, dj: int) -> Column:
        return F.get(source, (i + di) * samples + j + dj)

    return (1 - a) * (1 - b) * s(0, 0) + (1 - a) * b * s(0, 1) + a * b * s(1, 1) + a * (1 - b) * s(1, 0)


def interpolate(source: Column, lines: int, samples: int, row: Column, col: Column, factor: int, offset: float) -> Column:
    """The source (lines x samples values of a block) at an output's row and column."""
    if samples < 2 or lines < 2:
        raise ValueError("a block of at least 2 x 2 values is needed")
    return between(source, samples, *cell(row, lines, factor, offset), *cell(col, samples, factor, offset))


def shifted_longitude(lon: Column) -> Column:
    """Longitudes in [0, 360)."""
    return F.when(lon < 0, lon + 360.0).otherwise(lon)


def affine(t: tuple[float, ...], line: Column, sample: Column, hfactor: int = 1, vfactor: int = 1) -> tuple[Column, Column]:
    """Projected place of a (fractional) pixel position; t: x0, x by sample, x by line, y0, y by sample, y by line."""
    x = F.lit(t[0]) + F.lit(t[1] / hfactor) * sample + F.lit(t[2] / vfactor) * line
    y = F.lit(t[3]) + F.lit(t[4] / hfactor) * sample + F.lit(t[5] / vfactor) * line
    return x, y


def sinusoidal_inverse(x: Column, y: Column, radius: float = SPHERE) -> tuple[Column, Column]:
    """Longitude and latitude, in degrees, of a place in the sinusoidal projection."""
    lat = y / F.lit(radius)
    return x / (F.lit(radius) * F.cos(lat)) * F.lit(180 / math.pi), lat * F.lit(180 / math.pi)


def corner_positions(index: Column, samples: int) -> list[Column]:
    """Positions of a pixel's corners in the chunk's grid of (lines + 1) x (samples + 1) corners, clockwise from the upper left."""
    first = (index + F.floor(index / samples)).cast("int")
    return [first, first + 1, first + samples + 2, first + samples + 1]
