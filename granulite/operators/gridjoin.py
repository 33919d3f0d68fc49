"""Polygon x grid joins: which cells a polygon covers, and how much of each.

In units of the grid a cell is a unit square. Only a ring's *edges* are cut at the lines
of the grid. A piece of an edge within a cell adds to the cell the signed area between
itself and the cell's right side, and its height to all cells further right in its row.
Pieces are summed by cell, and a running sum along each row gives the part of every cell
that the ring encloses; cells between two pieces are covered alike and are filled in. So
the work before the last step follows a ring's circumference, not its area, and rings
needn't be convex.

A ring is one value of a row, so nothing is exchanged: batches of rings are cut where they
are read, on arrays. Beside a batch of Arrow's, what a task holds is bounded by ``PIECES``
and ``CELLS``, whatever the number of rings and the area of one; only the points of one
ring and the pieces in one of its rows are held together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

#: Parts of a cell below which an overlap is rounding.
LEAST = 1e-12
_FAR = 1e300
#: Pieces of edges that are cut at once, and cells and bytes that are sent at once.
PIECES, CELLS, BYTES = 1 << 18, 1 << 17, 1 << 25
#: Rows of up to so many pieces are summed side by side, longer ones one by one.
_SHORT = 32


def _first(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first cell that the range between two values meets."""
    return np.floor(np.minimum(x, y)).astype(np.int64)


def _last(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The last cell that it meets with more than its end."""
    return np.maximum(np.ceil(np.maximum(x, y)).astype(np.int64) - 1, _first(x, y))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range its number, once for each of its integers, and the integers; empty ranges have none."""
    n = np.maximum(high - low + 1, 0)
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + low[k]


def _edges(rings: pa.ListArray, frame: tuple[float, float, float, float]) -> tuple[np.ndarray, ...]:
    """Number of the ring and ends of each edge, in units of the grid; level edges enclose nothing."""
    ox, oy, sx, sy = frame
    offsets = rings.offsets.to_numpy().astype(np.int64)
    points, offsets = rings.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
    size = np.where(rings.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    ring, at = _spread(offsets[:-1], np.where(size > 3, offsets[:-1] + size - 2, offsets[:-1] - 1))
    known = points.is_valid().to_numpy(zero_copy_only=False)
    x, y = (np.where(known, points.field(k).cast(pa.float64()).to_numpy(zero_copy_only=False), np.nan) for k in "xy")
    u, v = (x - ox) / sx, (y - oy) / sy
    pu, pv, qu, qv = u[at], v[at], u[at + 1], v[at + 1]
    fit = np.isfinite(pu) & np.isfinite(pv) & np.isfinite(qu) & np.isfinite(qv) & (pv != qv)
    return tuple(a[fit] for a in (ring, pu, pv, qu, qv))


def _bands(edges: tuple[np.ndarray, ...], span: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]]:
    """Edges and the rows of each to be cut at once: rows are halved until there are about PIECES pieces or one row."""
    if not len(low):
        return
    bottom, top = low.min(), high.max()
    rows = high - low + 1
    if bottom == top or (rows + span).sum() <= PIECES:
        yield edges, low, high
        return
    middle = (bottom + top) // 2
    for a, b in ((low, np.minimum(high, middle)), (np.maximum(low, middle + 1), high)):
        in_ = a <= b
        yield from _bands(tuple(e[in_] for e in edges), (span * (b - a + 1) / rows)[in_], a[in_], b[in_])


def _pieces(edges: tuple[np.ndarray, ...], low: np.ndarray, high: np.ndarray, width: int | None) -> tuple[np.ndarray, ...]:
    """Sums by cell: ring, row j, column i, height, and area to the cell's right side; in order."""
    k, j = _spread(low, high)
    ring, pu, pv, qu, qv = (e[k] for e in edges)
    va, vb = (np.clip(v, j, j + 1) for v in (pv, qv))
    ua, ub = (pu + (v - pv) * (qu - pu) / (qv - pv) for v in (va, vb))
    # what is left of the grid is one piece, in column -1
    low, high = _first(ua, ub), _last(ua, ub)
    if width is not None:
        low, high = np.maximum(low, -1), np.maximum(np.minimum(high, width - 1), -1)
    k, i = _spread(low, high)
    ring, j, ua, ub, va, vb = (a[k] for a in (ring, j, ua, ub, va, vb))
    left = i.astype(float) if width is None else np.where(i >= 0, i, -_FAR)
    ea, eb = (np.clip(u, left, i + 1) for u in (ua, ub))
    level = ua == ub
    c = np.where(level, vb - va, (eb - ea) * (vb - va) / np.where(level, 1.0, ub - ua))
    a = c * (i + 1 - (ea + eb) / 2)
    order = np.lexsort((i, j, ring))
    ring, j, i, c, a = (x[order] for x in (ring, j, i, c, a))
    new = np.flatnonzero(np.r_[True, (ring[1:] != ring[:-1]) | (j[1:] != j[:-1]) | (i[1:] != i[:-1])][: len(i)])
    return (ring[new], j[new], i[new], *(np.add.reduceat(x, new) if len(new) else x for x in (c, a)))


def _before(c: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sum of what comes before, along rows that begin at ``start``; no row's rounding is carried to another."""
    n = np.diff(np.r_[start, len(c)])
    out = np.zeros(len(c))
    for r in range(1, min(_SHORT, n.max(initial=0))):
        at = start[(n > r) & (n <= _SHORT)] + r
        out[at] = out[at - 1] + c[at - 1]
    for s, m in zip(start[n > _SHORT], n[n > _SHORT]):
        out[s + 1 : s + m] = np.cumsum(c[s : s + m - 1])
    return out


def _slices(rings: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of rings of about PIECES points each."""
    if len(rings):
        first = np.flatnonzero(np.diff(rings.offsets.to_numpy()[:-1] // PIECES, prepend=-1))
        yield from zip(first.tolist(), [*first[1:].tolist(), len(rings)])


def _cut(rings: pa.ListArray, most: int, frame: tuple[float, float, float, float], width: int | None, height: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(ring, i, j, ratio) of the cells that rings overlap, at most ``most`` at once."""
    for a, b in _slices(rings):
        for ring, *cells in _cut_slice(rings.slice(a, b - a), most, frame, width, height):
            yield ring + a, *cells


def _cut_slice(rings: pa.ListArray, most: int, frame: tuple[float, float, float, float], width: int | None, height: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    edges = _edges(rings, frame)
    _, pu, pv, qu, qv = edges
    low, high = _first(pv, qv), _last(pv, qv)
    if height is not None:
        low, high = np.maximum(low, 0), np.minimum(high, height - 1)
    # the columns that an edge crosses
    span = np.abs(qu - pu) if width is None else np.abs(np.clip(qu, -1, width) - np.clip(pu, -1, width))
    met = low <= high
    edges, span, low, high = tuple(e[met] for e in edges), span[met], low[met], high[met]
    for part, a, b in _bands(edges, span, low, high):
        ring, j, i, c, area = _pieces(part, a, b, width)
        if not len(i):
            continue
        new = np.r_[True, (ring[1:] != ring[:-1]) | (j[1:] != j[:-1])]
        before = _before(c, np.flatnonzero(new))
        after = np.abs(before + c)
        end = i.copy() if width is None else np.full(len(i), width - 1)
        end[:-1] = np.where(new[1:], end[:-1], i[1:] - 1)
        first = i if width is None else np.maximum(i, 0)
        n = np.maximum(np.where(after > LEAST, end, i) - first + 1, 0)
        stop = np.cumsum(n)
        for at in range(0, int(stop[-1]), most):
            # cells from ``at`` on, of pieces x to y
            to = min(at + most, int(stop[-1]))
            x, y = np.searchsorted(stop, at, "right"), np.searchsorted(stop, to, "left") + 1
            begin = np.maximum(stop[x:y] - n[x:y], at)
            k, cell = _spread(begin, np.minimum(stop[x:y], to) - 1)
            k += x
            cell += first[k] - (stop[k] - n[k])
            ratio = np.where(cell == i[k], np.abs(before + area)[k], after[k])
            kept = ratio > LEAST
            yield ring[k[kept]], cell[kept], j[k[kept]], ratio[kept]


def _cells(df: DataFrame, ring: str, frame: tuple[float, float, float, float], keep: list[str], width: int | None, height: int | None, kind: str) -> DataFrame:
    frame = tuple(map(float, frame))
    names = {c: f"__k{n}" for n, c in enumerate(dict.fromkeys(keep))}
    df = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(ring).alias("__r"))
    whole, number = {"int": (IntegerType(), pa.int32()), "long": (LongType(), pa.int64())}[kind]
    fields = [*(df.schema[n] for n in names.values()), StructField("__i", whole), StructField("__j", whole), StructField("__ratio", DoubleType())]
    own, out = len(names), [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.columns[:own]
            row = 24 + sum(c.nbytes for c in kept) // max(1, batch.num_rows)
            for k, i, j, ratio in _cut(batch.column(own), max(1, min(CELLS, BYTES // row)), frame, width, height):
                k = pa.array(k)
                yield pa.RecordBatch.from_arrays([*(c.take(k) for c in kept), pa.array(i).cast(number), pa.array(j).cast(number), pa.array(ratio)], out)

    df = df.mapInArrow(run, StructType(fields))
    return df.select(*(F.col(names[c]).alias(c) for c in keep), F.col("__i").alias("i"), F.col("__j").alias("j"), F.col("__ratio").alias("ratio"))


def grid_join(df: DataFrame, ring: str, sx: float, sy: float, ox: float = 0.0, oy: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """Each row of df once for every cell (i, j) of an infinite grid that its ring overlaps; ratio is the part of the cell.

    ring: a column of closed rings of one contour. Null and empty rings, and those
    without an area, give no rows.
    """
    return _cells(df, ring, (ox, oy, sx, sy), df.columns if keep is None else keep, None, None, "long")


def grid_join_area(df: DataFrame, ring: str, width: int, height: int, xmin: float, ymin: float, xmax: float, ymax: float, keep: list[str] | None = None) -> DataFrame:
    """Like grid_join on a grid of width x height cells between corners; an axis that runs down counts down. What lies outside is cut away."""
    frame = (xmin, ymin, (xmax - xmin) / width, (ymax - ymin) / height)
    return _cells(df, ring, frame, df.columns if keep is None else keep, width, height, "int")
