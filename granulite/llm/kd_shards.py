"""Sharding by a k-d tree over metadata.

A cell of the tree that is to become n shards is cut along the dimension in which it's
widest, relative to the whole table, at the value below which ``floor(n / 2) / n`` of
its bytes lie; cells are cut until each is one shard. A cut value that many rows share
(a source with a third of all rows) is itself cut, by a hash, so sizes stay near equal.
Rows of equal texts are one item, which no cut divides. Where an item at a cut is too
large to leave the sides near equal it goes to one side, and smaller ones make it up.

Weighted medians are distributed: all cells of a level are searched at once, by sums
of bytes over at most 65,536 ranges a pass, each pass within the range that holds the
median. Only those sums reach the driver, whatever the table's size. The tree itself
is a CASE expression. All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

SHARDS = 24
#: Ranges of a pass, over all cells; rows of a task that numbers a part of a shard.
RANGES, SLOT_ROWS = 1 << 16, 100_000
#: Copies of a text stay together while their bytes are at most this many shards.
TOGETHER = 1
#: Part of a shard that a cut may be off its place; items of more than half of it are few, and are weighed one by one.
TOLERANCE = 0.02
#: Large items on either side of a cut that may be exchanged, and exchanges.
NEAR, EXCHANGES = 64, 4
TIES = 1 << 40


@dataclass
class Cell:
    shards: int
    first: int  # number of its first shard
    dim: int | None = None
    value: int = 0  # rows below it go left
    tie: int = 0  # rows at the value go left if their hash is below this
    left: "Cell | None" = None
    right: "Cell | None" = None
    swapped: tuple[int, ...] = ()  # items on the other side than their place, by tie

    def number(self) -> Column:
        """The first shard of the cell that a row lies in."""
        if self.left is None:
            return F.lit(self.first)
        d = F.col(f"d{self.dim}")
        below = (d < self.value) | ((d == self.value) & (F.col("tie") < self.tie))
        if self.swapped:
            below = below != F.col("tie").isin(list(self.swapped))
        return F.when(below, self.left.number()).otherwise(self.right.number())


def _search(rows: DataFrame, key: dict[int, Column], span: dict[int, tuple[int, int]], want: dict[int, float]) -> dict[int, tuple[int, float, float]]:
    """For each cell: the value v of its key at which the bytes below reach ``want``, the bytes below v, and those at v if it was searched for.

    span: least and largest value of each cell's key. The bytes below v are at most
    want, those up to and with v more (or v is the largest).
    """
    below, here = {c: 0.0 for c in span}, {c: 0.0 for c in span}
    ranges = max(2, RANGES // len(span))
    while open_ := {c: s for c, s in span.items() if s[0] < s[1]}:
        parts = None
        for c, (lo, hi) in open_.items():
            step = -(-(hi - lo + 1) // ranges)
            x = F.floor((key[c] - F.lit(lo)) / F.lit(step)) if step > 1 else key[c] - F.lit(lo)
            inside = (F.col("cell") == c) & key[c].between(lo, hi)
            at = F.struct(F.lit(c).alias("cell"), x.cast("long").alias("range"))
            parts = F.when(inside, at) if parts is None else parts.when(inside, at)
        sums: dict[int, dict[int, int]] = {}
        for r in rows.select(parts.alias("p"), "size").where("p is not null").groupBy("p.cell", "p.range").agg(F.sum("size").alias("b")).collect():
            sums.setdefault(r[0], {})[r[1]] = r[2]
        for c, (lo, hi) in open_.items():
            step = -(-(hi - lo + 1) // ranges)
            found, total = None, below[c]
            for i in sorted(sums.get(c, {})):
                found, before = i, total
                total += sums[c][i]
                if total > want[c]:
                    break
            if found is None:
                span[c] = (hi, hi)
                continue
            below[c], here[c] = before, total - before
            span[c] = (lo + found * step, min(hi, lo + (found + 1) * step - 1))
    return {c: (s[0], below[c], here[c]) for c, s in span.items()}


def _cuts(rows: DataFrame, key: dict[int, Column], span: dict[int, tuple[int, int]], want: dict[int, float]) -> dict[int, tuple[int, int, float, float]]:
    """For each cell: value and tie of the item at which the bytes below reach ``want``, the bytes below it and its own."""
    found = _search(rows, key, dict(span), want)
    at = {c: F.when(key[c] == f[0], F.col("tie")) for c, f in found.items()}
    ties = _search(rows, at, {c: (0, TIES - 1) for c in found}, {c: want[c] - f[1] for c, f in found.items()})
    return {c: (f[0], ties[c][0], f[1] + ties[c][1], ties[c][2]) for c, f in found.items()}


def _divide(items: list[tuple[tuple[int, int], int]], at: tuple[int, int], want: float, small: float) -> tuple[set[int], float]:
    """Large items (place, size) of a cell that go left, by tie, and the bytes that are then left for small ones.

    at: the place of the item that the cut meets; small: bytes of all small items. Of
    those that follow, the next ones go left that small items can't make up.
    """
    best = None
    for first in (False, True):  # the item at the cut: right, left
        left = {p[1] for p, _ in items if p < at or (first and p == at)}
        need = want - sum(n for p, n in items if p[1] in left)
        for p, n in [x for x in items if x[0] > at] if need > small else [x for x in reversed(items) if x[0] < at] if need < 0 else []:
            if need > small and n <= need:
                left.add(p[1])
                need -= n
            elif need < 0 and n <= -need:
                left.discard(p[1])
                need += n
        off = max(need - small, -need, 0)
        if best is None or off < best[0]:
            best = (off, left, need)
    off, left, need = best
    middle = sum(p < at for p, _ in items)
    near = items[max(0, middle - NEAR) : middle + NEAR]
    for _ in range(EXCHANGES if off else 0):  # of an item on the left for one on the right, or either alone
        a = [(0, None)] + [(n, p[1]) for p, n in near if p[1] in left]
        b = [(0, None)] + [(n, p[1]) for p, n in near if p[1] not in left]
        now, x, y = min(((max(need + x[0] - y[0] - small, y[0] - x[0] - need, 0), x, y) for x in a for y in b), key=lambda t: t[0])
        if now >= off:
            break
        off, need, left = now, need + x[0] - y[0], (left - {x[1]}) | ({y[1]} - {None})
    return left, min(max(need, 0), small)


def kd_tree(rows: DataFrame, dims: int, shards: int) -> Cell:
    """rows: columns d0, d1, ... and tie (long, not null), size (positive) and heft, the bytes of all rows of its item, which share d0, d1, ... and tie."""
    root = Cell(shards, 0)
    stats = [f(F.col(f"d{i}")) for i in range(dims) for f in (F.min, F.max)]
    whole = rows.agg(F.count(F.lit(1)), *stats, F.sum("size").alias("bytes")).first()
    if not whole[0]:
        return root
    allowed = whole["bytes"] / shards * TOLERANCE
    is_large = F.col("heft") > allowed / 2
    # at most 2 * shards / TOLERANCE items
    large = rows.where(is_large).groupBy("tie", *(f"d{i}" for i in range(dims))).agg(F.sum("size").alias("size")).collect()
    large = {0: large}
    extent = [max(1, whole[2 + 2 * i] - whole[1 + 2 * i]) for i in range(dims)]
    level = [root]
    while level := [c for c in level if c.shards > 1]:
        cells = {c.first: c for c in level}
        here = rows.withColumn("cell", root.number()).where(F.col("cell").isin(list(cells)))
        own = {r[0]: r for r in here.groupBy("cell").agg(F.sum("size"), *stats).collect()}
        want, span, key = {}, {}, {}
        for first, c in cells.items():
            if first not in own:
                continue
            r = own[first]
            width = [(r[3 + 2 * i] - r[2 + 2 * i]) / extent[i] for i in range(dims)]
            c.dim = width.index(max(width))
            want[first] = r[1] * (c.shards // 2) / c.shards
            span[first], key[first] = (r[2 + 2 * c.dim], r[3 + 2 * c.dim]), F.col(f"d{c.dim}")
        found = _cuts(here, key, span, want)
        again, small_want = {}, {}
        for first, (value, tie, below, size) in found.items():
            c = cells[first]
            c.value, c.tie = value, tie
            if below + size - want[first] < want[first] - below:
                c.tie += 1  # the item at the cut goes left
            if min(abs(below + size - want[first]), abs(want[first] - below)) > allowed:
                items = sorted(((r[f"d{c.dim}"], r["tie"]), r["size"]) for r in large[first])
                again[first], small_want[first] = _divide(items, (value, tie), want[first], own[first][1] - sum(n for _, n in items))
        if again:  # large items have their sides; the cut of the others follows
            small = here.where(~is_large & F.col("cell").isin(list(again)))
            for first, (value, tie, below, size) in _cuts(small, key, {c: span[c] for c in again}, small_want).items():
                c = cells[first]
                c.value, c.tie = value, tie + (small_want[first] - below > below + size - small_want[first])
                c.swapped = tuple(r["tie"] for r in large[first] if (r["tie"] in again[first]) != ((r[f"d{c.dim}"], r["tie"]) < (c.value, c.tie)))
        level = []
        for first, c in cells.items():
            if first not in found:
                c.dim = 0
            n = c.shards // 2
            c.left, c.right = Cell(n, first), Cell(c.shards - n, first + n)
            level += [c.left, c.right]
            items = large.pop(first, [])
            goes = [((r[f"d{c.dim}"], r["tie"]) < (c.value, c.tie)) != (r["tie"] in c.swapped) for r in items]
            large[first], large[first + n] = [r for r, x in zip(items, goes) if x], [r for r, x in zip(items, goes) if not x]
    return root


def _code(c: str) -> Column:
    """A name as a number; equal names are equal."""
    return F.crc32(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).cast("long")


def kd_shards(docs: DataFrame, id_: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("source", "lang"), numbers: tuple[str, ...] = (), shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs.

    size: UTF-8 bytes of the text (null: none) plus 8. law is ``bytes``: shards get near
    equal sums of size, as far as whole groups of equal texts let them. Dimensions of the tree: the columns in names by a hash, those in
    numbers as they are (long), the size and the id. slot counts the rows of a shard
    from 0 without gaps; grown_shard is null, as the law isn't ``key``.

    * Rows of equal texts share their place in the tree, that of the least of each
      dimension among them, so they share a shard; but not if their bytes together are
      more than a shard's, when each row is placed by itself.
    * Null texts are equal texts of no bytes; a null id or number counts as 0 and a null
      name as ''. Repeated rows get slots of their own.
    * Fewer rows than shards leave shards empty; an empty table gives an empty table.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    own = [F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)) for c in (id_, *numbers)]
    codes = [_code(c) for c in names]
    rows = docs.withColumn("text", F.col(text).cast("string")).select(
        F.col(id_).cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("g"), *(c.alias(f"o{i}") for i, c in enumerate([*codes, *own])),
    )
    rows = cut(rows)
    k = len(codes) + len(own)
    total = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    most = (total[0] or 0) / shards * TOGETHER
    group = ["g", "text_crc32", "size"]
    same = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *(F.min(f"o{i}").alias(f"m{i}") for i in range(k))).where((F.col("n") > 1) & (F.col("n") * F.col("size") <= most))
    placed = rows.join(same, group, "left").select(
        "doc_id", "size", "text_crc32", *(F.coalesce(f"m{i}", f"o{i}").alias(f"d{i}") for i in range(k)), F.col("size").alias(f"d{k}"),
        F.pmod(F.when(F.col("m0").isNull(), F.xxhash64("g", "doc_id", *(f"o{i}" for i in range(k)))).otherwise(F.xxhash64("g")), F.lit(TIES)).alias("tie"),
        (F.coalesce("n", F.lit(1)) * F.col("size")).alias("heft"),
    )
    placed = cut(placed)
    tree = kd_tree(placed, k + 1, shards)
    out = placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), tree.number().alias("shard"))
    # slots: parts of a shard are numbered by themselves, after the rows of the parts before
    parts = max(1, total[1] // shards // SLOT_ROWS * 2)
    out = out.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    before = out.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    in_part = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    out = out.withColumn("r", in_part).join(before, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("r") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
