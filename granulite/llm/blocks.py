"""Counting hashed keys of whole texts without a row for each key.

Three operators of this package ask, for every word run of every text, how often
or where else that run occurs. A row for each run would cost tens of bytes of
shuffle for each word of the corpus. Instead the texts are dealt into *blocks* of
about ``block_bytes`` by a hash of their id; a block sends its distinct keys,
sorted and delta-coded, to *parts* of the key space; a part meets the keys of all
blocks and sends each block an answer for each of its keys, in the same order; and
the block, which finds its keys again from its texts, reads the answers by position.

* A key goes from a block to its part once, however often the block holds it, so a
  key that a third of all texts hold weighs as little as any other.
* Blocks and parts grow with the square root of the input up to what a task can hold;
  beyond that their number grows. A block sends a row to each part while parts are at
  most ``HOP``. Beyond, exchanges take two hops: a block sends a row to each *group* of
  parts, and a relay, which meets a group's rows from a *batch* of blocks, sends one row
  to each part for the whole batch; answers go back the same way. So a block sends at
  most ``HOP`` rows, or about as many as the square root of the number of parts.
* All of it is shuffle output of one plan: a lost executor costs a recomputation
  of its share. Blocks depend on ids alone and answers on sorted keys alone, so a
  recomputed share is equal to the lost one whatever order rows arrive in.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import trim

#: Bytes of text in a block of a small input and at most; input from which blocks grow; blocks' worth of text whose keys a part meets.
BLOCK_BYTES, MOST_BYTES, GROW_FROM, PART_BLOCKS = 4 << 20, 16 << 20, 8 << 30, 3
#: Rows that a block sends at most in one hop; partitions of an exchange at most.
HOP, TASKS = 4096, 32768
#: Memory from which a worker gives back between blocks what it doesn't use.
WORKER_BYTES = 160 << 20
#: Bits of a key: enough to count by; enough to filter by (a key takes about four bytes).
COUNT_BITS, FILTER_BITS = 58, 46
_U = np.uint64

SENT = "__part int, __block long, payload binary"


@dataclass
class Sizes:
    """What the input measures, and how it's dealt.

    bytes: of texts, with a little for each row. bits: of the keys of each space of keys;
    every space has ``parts`` parts. Parts of a group and blocks of a batch are 0 for one hop.
    """

    rows: int
    bytes: int
    blocks: int
    parts: int
    tasks: int
    bits: tuple[int, ...] = (COUNT_BITS,)
    group: int = 0
    batch: int = 0

    @property
    def all_parts(self) -> int:
        return self.parts * len(self.bits)

    @property
    def groups(self) -> int:
        return -(-self.all_parts // self.group) if self.group else self.all_parts


def plan(rows: int, n_bytes: int, block_bytes: int = BLOCK_BYTES, *bits: int) -> Sizes:
    """How an input is dealt whose blocks are of ``block_bytes`` while it's small. bits: of the keys of each space."""
    bits = bits or (COUNT_BITS,)
    size = max(block_bytes, min(MOST_BYTES, int(block_bytes * math.sqrt(n_bytes / GROW_FROM))))
    blocks, parts = max(1, -(-n_bytes // size)), max(1, -(-n_bytes // (PART_BLOCKS * size)))
    group = batch = 0
    if parts * len(bits) > HOP:
        group = math.isqrt(parts * len(bits) - 1) + 1
        batch = min(blocks, group)
    return Sizes(rows, n_bytes, blocks, parts, min(TASKS, -(-blocks // 3)), bits, group, batch)


def measure(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES, *bits: int) -> Sizes:
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16).cast("long")).alias("b")).first()
    return plan(row["n"], row["b"] or 0, block_bytes, *bits)


def deal(docs: DataFrame, id_: str, text: str, sizes: Sizes) -> DataFrame:
    """docs with ``__block``, the rows of a block in one partition: by id and text, so rows that share an id spread.

    What follows reads all of its columns each time: the plan then holds the same
    exchange of texts several times, and Spark runs it once.
    """
    block = F.pmod(F.xxhash64(F.col(id_).cast("string"), F.col(text)), F.lit(sizes.blocks))
    return docs.withColumn("__block", block).repartition(sizes.tasks, "__block")


def _planes(a: np.ndarray, width: int) -> bytes:
    """The low bytes of each value, low ones first."""
    return np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    a = np.zeros((n, 8), np.uint8)
    a[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return a.view("<u8").reshape(-1)


def _width(a: np.ndarray) -> int:
    return max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1


#: In place of a width: most values are one, and a bit tells which aren't; low bytes and the rest stand apart.
_MOSTLY, _APART = 255, 254


def _coded(a: np.ndarray) -> bytes:
    """An array: as wide as its largest value, or by what is rare in it."""
    n, width = len(a), _width(a)
    if not n:
        return b"\x01"
    usual = np.partition(a, n // 2)[n // 2]  # a value of more than half of them is their median
    other = a != usual
    rest = int(other.sum())
    if 2 * rest < n and n > 64:
        return bytes([_MOSTLY]) + int(usual).to_bytes(8, "little") + rest.to_bytes(8, "little") + np.packbits(other).tobytes() + _coded(a[other])
    if width > 1 and n > 64 and 4 * int((a > 255).sum()) < n:
        return bytes([_APART]) + _coded(a & _U(255)) + _coded(a >> _U(8))
    return bytes([width]) + _planes(a, width)


def _decoded(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """An array of n values, and where it ends."""
    width, at = data[at], at + 1
    if width == _MOSTLY:
        a = np.full(n, int.from_bytes(data[at : at + 8], "little"), _U)
        rest, size = int.from_bytes(data[at + 8 : at + 16], "little"), (n + 7) // 8
        other = np.unpackbits(np.frombuffer(data, np.uint8, size, at + 16), count=n) > 0
        a[other], at = _decoded(data, at + 16 + size, rest)
        return a, at
    if width == _APART:
        low, at = _decoded(data, at, n)
        high, at = _decoded(data, at, n)
        return low | (high << _U(8)), at
    return _from_planes(data, at, n, width), at + n * width


def pack(*arrays: np.ndarray) -> bytes:
    """Equally long arrays of unsigned integers as bytes."""
    return len(arrays[0]).to_bytes(8, "little") + b"".join(_coded(np.ascontiguousarray(a, "<u8")) for a in arrays)


def unpack(data: bytes, at: int = 0) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[at : at + 8], "little"), at + 8, []
    while at < len(data):
        a, at = _decoded(data, at, n)
        out.append(a)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: their low bits, in half bytes, and one bit for each key and each step of what is above them (Elias and Fano)."""
    x = keys - keys[0]
    n, top = len(x), int(x[-1])
    halves = min(range(15), key=lambda w: n * 4 * w + (top >> 4 * w))
    high = (x >> _U(4 * halves)).astype(np.int64) + np.arange(n)
    steps = np.zeros(int(high[-1]) + 1, np.uint8)
    steps[high] = 1
    low = _planes(x, halves // 2)
    if halves % 2:
        half = ((x >> _U(4 * (halves - 1))) & _U(15)).astype(np.uint8)
        half = np.append(half, np.zeros(n % 2, np.uint8))
        low += (half[0::2] | half[1::2] << 4).tobytes()
    return n.to_bytes(4, "little") + bytes([halves]) + len(steps).to_bytes(4, "little") + int(keys[0]).to_bytes(8, "little") + np.packbits(steps).tobytes() + low


def unpack_keys(data: bytes) -> tuple[np.ndarray, int]:
    """The keys, and where they end."""
    n, halves, size, first = int.from_bytes(data[:4], "little"), data[4], int.from_bytes(data[5:9], "little"), int.from_bytes(data[9:17], "little")
    end = 17 + (size + 7) // 8
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, end - 17, 17), count=size)) - np.arange(n)
    x = (high.astype(_U) << _U(4 * halves)) + _from_planes(data, end, n, halves // 2) + _U(first)
    end += n * (halves // 2)
    if halves % 2:
        pair = np.frombuffer(data, np.uint8, (n + 1) // 2, end)
        half = np.stack([pair & 15, pair >> 4], 1).ravel()[:n]
        x += half.astype(_U) << _U(4 * (halves - 1))
        end += len(pair)
    return x, end


def frame(items: list[tuple[int, bytes]]) -> bytes:
    """Numbered pieces as one."""
    return b"".join(x for number, data in items for x in (number.to_bytes(8, "little"), len(data).to_bytes(8, "little"), data))


def unframe(data: bytes) -> list[tuple[int, bytes]]:
    at, out = 0, []
    while at < len(data):
        end = at + 16 + int.from_bytes(data[at + 8 : at + 16], "little")
        out.append((int.from_bytes(data[at : at + 8], "little"), data[at + 16 : end]))
        at = end
    return out


def part_of(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """floor(key * parts / 2^bits), by halves so that nothing overflows."""
    k, low = keys.astype(_U), _U(bits // 2)
    p = _U(parts)
    return (((k >> low) * p + (((k & ((_U(1) << low) - _U(1))) * p) >> low)) >> _U(bits - bits // 2)).astype(np.int64)


def short(h: np.ndarray, bits: int = COUNT_BITS) -> np.ndarray:
    """64-bit hashes as keys of so many bits."""
    return h >> _U(64 - bits)


def _trimmed(table: pa.Table) -> pa.Table:
    trim(WORKER_BYTES)
    return table


def _rows(to: list[int], from_: list[int], payload: list[bytes]) -> pa.Table:
    return pa.table({"__part": pa.array(to, pa.int32()), "__block": pa.array(from_, pa.int64()), "payload": pa.array(payload, pa.binary())})


def _bytes(table: pa.Table) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in table.column("payload")]


#: Keys of a space, ascending, and arrays of values alongside.
Keys = tuple[np.ndarray, list[np.ndarray]]


def _send(block: int, spaces: list[Keys], sizes: Sizes) -> pa.Table:
    """A block's keys as rows to parts or to groups of them."""
    to, pieces = [], []
    for space, ((keys, values), bits) in enumerate(zip(spaces, sizes.bits, strict=True)):
        part = part_of(keys, sizes.parts, bits) + space * sizes.parts
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
        to += part[at].tolist()
        ends = np.append(at[1:], len(keys)).tolist()
        pieces += [pack_keys(keys[i:j]) + (pack(*(v[i:j] for v in values)) if values else b"") for i, j in zip(at.tolist(), ends)]
    if sizes.group:
        by: dict[int, list] = {}
        for p, data in zip(to, pieces):
            by.setdefault(p // sizes.group, []).append((p, data))
        to, pieces = list(by), [frame(x) for x in by.values()]
    return _rows(to, [block] * len(to), pieces)


def _relay(sent: DataFrame, sizes: Sizes, back: bool) -> DataFrame:
    """From rows of blocks to groups, to rows of batches to parts; or back. What a block sends itself passes."""
    groups_, parts, group, batch = sizes.groups, sizes.all_parts, sizes.group, sizes.batch

    def run(table: pa.Table) -> pa.Table:
        first = table.column("__part")[0].as_py()
        if first >= (parts if back else groups_):
            return table.select(["__part", "__block", "payload"]) if back else _rows([first - groups_ + parts], table.column("__block").to_pylist(), _bytes(table))
        own = table.column("__batch" if not back else "__group")[0].as_py()
        by: dict[int, list] = {}
        for number, data in zip(table.column("__part" if back else "__block").to_pylist(), _bytes(table)):
            for other, piece in unframe(data):
                by.setdefault(other, []).append((number, piece))
        to, payload = list(by), [frame(sorted(x)) for x in by.values()]
        return _rows([own] * len(to), to, payload) if back else _rows(to, [own] * len(to), payload)

    if back:  # a part's answers to a batch
        rows = sent.withColumn("__group", F.when(F.col("__part") < parts, F.floor(F.col("__part") / group)).otherwise(F.col("__part")).cast("int"))
        keys = ["__group", "__block"]
    else:
        rows = sent.withColumn("__batch", F.floor(F.col("__block") / batch))
        keys = ["__part", "__batch"]
    return rows.repartition(min(TASKS, max(sizes.tasks, parts)), *keys).groupBy(*keys).applyInArrow(run, SENT)


def send(dealt: DataFrame, keys: Callable[[pa.Table], list[Keys]], sizes: Sizes) -> DataFrame:
    """keys: from the rows of a block to its distinct keys of each space."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("__block")[0].as_py()
        return _trimmed(_send(block, keys(table), sizes))

    return dealt.groupBy("__block").applyInArrow(run, SENT)


def answer(sent: DataFrame, reply: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], list[np.ndarray]], sizes: Sizes) -> DataFrame:
    """reply: from all keys of a part, the number of the block (from 0) of each, and their values, to arrays alongside.

    The keys are ordered by block before reply sees them, so it may depend on their order.
    """
    parts, two = sizes.all_parts, sizes.group > 0

    def run(table: pa.Table) -> pa.Table:
        part = table.column("__part")[0].as_py()
        if part >= parts:
            return table  # what a block sends itself
        pieces = []  # block, batch, bytes
        for from_, data in zip(table.column("__block").to_pylist(), _bytes(table)):
            pieces += [(block, from_, x) for block, x in unframe(data)] if two else [(from_, from_, data)]
        pieces.sort(key=lambda x: x[0])
        keys, values = [], []
        for _, _, data in pieces:
            k, end = unpack_keys(data)
            keys.append(k)
            values.append(unpack(data, end) if end < len(data) else [])
        lengths = [len(k) for k in keys]
        blocks = np.repeat(np.arange(len(keys)), lengths)
        out = reply(np.concatenate(keys), blocks, [np.concatenate(v) for v in zip(*values)])
        ends = np.cumsum(lengths)[:-1]
        packed = [pack(*a) for a in zip(*(np.split(x, ends) for x in out))]
        if two:
            by: dict[int, list] = {}
            for (block, from_, _), data in zip(pieces, packed):
                by.setdefault(from_, []).append((block, data))
            to, payload = list(by), [frame(x) for x in by.values()]
        else:
            to, payload = [b for b, _, _ in pieces], packed
        return _trimmed(_rows([part] * len(to), to, payload))

    if two:
        sent = _relay(sent, sizes, False)
    return sent.repartition(min(TASKS, parts), "__part").groupBy("__part").applyInArrow(run, SENT)


def returned(answered: DataFrame, sizes: Sizes) -> DataFrame:
    """Answers as rows to blocks."""
    return _relay(answered, sizes, True) if sizes.group else answered


def send_again(dealt: DataFrame, answered: DataFrame, keys: Callable[[pa.Table, list[np.ndarray]], tuple[list[Keys], bytes]], sizes: Sizes, then: Sizes) -> DataFrame:
    """Like send, for keys that depend on answers, and dealt as then says; the bytes are what the block wants to see again."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.column("__block")[0].as_py()
        found, own = keys(left, answers(right, sizes))
        return _trimmed(pa.concat_tables([_send(block, found, then), _rows([then.groups + block], [block], [own])]))

    return dealt.groupBy("__block").cogroup(returned(answered, sizes).repartition(sizes.tasks, "__block").groupBy("__block")).applyInArrow(run, SENT)


def note(table: pa.Table) -> tuple[pa.Table, bytes]:
    """A block's answers without its note, and the note."""
    table = table.sort_by("__part")
    return table.slice(0, table.num_rows - 1), table.column("payload")[table.num_rows - 1].as_py()


def answers(table: pa.Table, sizes: Sizes) -> list[np.ndarray]:
    """A block's answers in the order of its keys, space by space."""
    if not table.num_rows:
        return []
    data = _bytes(table.sort_by("__part"))
    if sizes.group:
        data = [x for _, x in sorted(p for d in data for p in unframe(d))]
    return [np.concatenate(x) for x in zip(*map(unpack, data))]


def finish(dealt: DataFrame, answered: DataFrame, f: Callable[..., pa.Table], schema: str, sizes: Sizes, noted: bool = False) -> DataFrame:
    """f: from the rows of a block, its answers and with noted its note, to rows of schema."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not noted:
            return _trimmed(f(left, answers(right, sizes)))
        right, own = note(right)
        return _trimmed(f(left, answers(right, sizes), own))

    return dealt.groupBy("__block").cogroup(returned(answered, sizes).repartition(sizes.tasks, "__block").groupBy("__block")).applyInArrow(run, schema)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal keys together (stable), where each group begins in it, and the size of each."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    return order, at, np.diff(np.append(at, len(keys)))


def spread(order: np.ndarray, sizes: np.ndarray, of_group: np.ndarray) -> np.ndarray:
    """A value of each group, at the places of its members."""
    out = np.empty(len(order), of_group.dtype)
    out[order] = np.repeat(of_group, sizes)
    return out


def tally(keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending, how often each stands and how often with its flag set.

    Sorts values alone, which is several times as fast as sorting with an order.
    """
    x = np.sort((keys << _U(1)) | flags.astype(_U))
    k = x >> _U(1)
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    with_flag = np.add.reduceat((x & _U(1)).astype(np.int64), at) if len(at) else np.empty(0, np.int64)
    return k[at], np.diff(np.append(at, len(k))), with_flag
