"""Removing repeated passages with fixed-block anchors.

A passage of ``window`` words that stands in two places holds, in either place, a
whole *reference block*: every text is laid out in blocks of ``window / 2`` words
that don't overlap. So (1) the blocks are the index, and every rolling run of as
many words probes it: a run that meets a block elsewhere is an anchor. (2) A
window can only be a repeat if all reference blocks of its own text inside it are
anchors; the windows around anchors are compared whole, which extends each anchor
to the maximal exact repeat that holds it. (3) A word goes if a repeated window
covers it whose words also start earlier.

Both comparisons go through :mod:`.blocks`. Each distinct run of a block of texts
is sent once and each repeat is held against the earliest place only, never against
all others, so copies of a passage cost in proportion to their number. Runs are
compared by hashes: an anchor by 46 bits (a false one costs time only), a window by
46 + 50 bits (equality of runs is equality of these hashes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, FILTER_BITS, answer, deal, finish, groups, measure, send, send_again, short, spread, tally
from .words import Words, windows, words

_U = np.uint64
NULL_ID = -(1 << 63)
SECOND_BITS = 50


def _ordered(table: pa.Table) -> pa.Table:
    """Rows in an order that doesn't depend on how they arrived."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _inside(w: Words, n: int, step: int = 1) -> np.ndarray:
    """First words, as numbers within the segment, of the runs of n words that lie in one text; with step, each step-th of a text."""
    i = np.flatnonzero(w.doc[: max(0, len(w.doc) - n + 1)] == w.doc[n - 1 :])
    if step > 1:
        ends = np.cumsum(w.counts())
        i = i[(i - (ends - w.counts())[w.doc[i] - w.first]) % step == 0]
    return i


def _anchor_keys(table: pa.Table, size: int):
    ks, aligned = [np.empty(0, _U)], [np.empty(0, bool)]
    for w in words(table.column("text")):
        i = _inside(w, size)
        flag = np.zeros(len(w.doc), bool)
        flag[_inside(w, size, size)] = True
        ks.append(short(windows(w.hash, size)[i], FILTER_BITS))
        aligned.append(flag[i])
    return np.concatenate(ks), np.concatenate(aligned)


def _zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(_U)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> _U(1)).view(np.int64) ^ -((x & _U(1)).view(np.int64))


def _candidates(table: pa.Table, hits: np.ndarray, window: int):
    """The windows whose reference blocks are all anchors: text, start, first and second hash. hits: of the blocks, in order."""
    size, seen, out = window // 2, 0, []
    for w in words(table.column("text")):
        n = w.counts()
        head = (np.cumsum(n) - n)[w.doc - w.first]  # number of the first word of each word's text
        blocks = _inside(w, size, size)
        hit = hits[seen : seen + len(blocks)]
        seen += len(blocks)
        # misses so far, by the block's first word: a window from i holds the blocks that start in i .. i + window - size
        miss = np.zeros(len(w.doc) + 1, np.int64)
        miss[blocks[~hit] + 1] = 1
        miss = np.cumsum(miss)
        i = _inside(w, window)
        i = i[miss[i + window - size + 1] == miss[i]]
        h = w.hash
        out.append((w.doc[i], (i - head[i]), windows(h, window)[i], windows(h, window, 1)[i] >> _U(64 - SECOND_BITS)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U), np.empty(0, _U)
    doc, start, a, b = (np.concatenate(x) for x in zip(*out))
    return doc, start, short(a, FILTER_BITS), b


def _by_window(k: np.ndarray, second: np.ndarray, doc_id: np.ndarray, start: np.ndarray):
    """An order by window and then place, and where each window begins in it."""
    order = np.lexsort((start, doc_id, second, k))
    k, second = k[order], second[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    return order, at, np.diff(np.append(at, len(k)))


def _kept(w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text of the segment, joined by one space."""
    start, end, doc = w.start[keep], w.end[keep], w.doc[keep] - w.first
    size = end - start + 1
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    size[last] -= 1
    to = np.cumsum(size) - size
    data = np.append(w.data, np.uint8(32))
    pick = np.arange(int(size.sum())) + np.repeat(start - to, size)
    pick[(to + size - 1)[~last]] = len(w.data)  # the space
    per = np.bincount(doc, weights=size, minlength=w.n_docs).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per)])
    return pa.LargeStringArray.from_buffers(w.n_docs, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[pick].tobytes()))


def substring_dedup(docs: DataFrame, id_: str = "doc_id", text: str = "text", window: int = 20, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed_spans) and the columns named in carry, for each row of docs.

    Words are compared unchanged. A word goes if a run of ``window`` (an even number)
    words of its text covers it that also starts earlier: in a row of smaller id, or
    in the same row before. Runs are judged on the input, not on what is left.
    removed_spans holds (first word, word after the last) of what went, kept_text the
    other words joined by one space.

    * A null or wordless text has no words: 0, 0, an empty text and no spans.
    * Rows that share an id count as one document: of equal runs at one place neither
      is earlier, so equal rows keep the same words. A null id is before all others.
    * An empty table gives an empty table. Columns of docs not named in carry are not
      read; carried columns come last, and one named like a result is left out.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")
    size = window // 2
    result = ["doc_id", "n_words", "n_removed", "kept_text", "removed_spans"]
    carry = tuple(c for c in carry if c not in result)
    sizes = measure(docs, text, block_bytes, FILTER_BITS)
    kept = [f"__carry{i}" for i in range(len(carry))]
    named = docs.select(F.coalesce(F.col(id_).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept)))
    dealt = deal(named, "doc_id", "text", sizes)

    def keys(table: pa.Table):
        k, aligned = _anchor_keys(table, size)
        k, count, n_aligned = tally(k, aligned)
        return [(k, [(n_aligned > 0).astype(_U) + _U(2) * (count > 1).astype(_U)])]

    def reply(k, _, values):
        order, at, count = groups(k)
        flag = values[0][order]
        hit = (np.bitwise_or.reduceat(flag, at) & _U(1) > 0) & ((count > 1) | (flag[at] > 1))
        return [spread(order, count, hit).astype(_U)]

    def again(table: pa.Table, got: list[np.ndarray]):
        table = _ordered(table)
        k, aligned = _anchor_keys(table, size)
        order, at, count = groups(k)
        hits = spread(order, count, got[0])[aligned] > 0 if got else np.empty(0, bool)
        doc, start, k, second = _candidates(table, hits, window)
        ids = table.column("doc_id").to_numpy()[doc]
        order, at, _ = _by_window(k, second, ids, start)
        first = order[at]
        return [(k[first], [second[first], _zigzag(ids[first]), start[first].astype(_U)])], np.packbits(hits).tobytes()

    def earliest(k, _, values):
        second, ids, start = values
        ids = _unzigzag(ids)
        order, at, count = _by_window(k, second, ids, start)
        first = order[at]
        same = (ids == spread(order, count, ids[first])) & (start == spread(order, count, start[first]))
        return [same.astype(_U)]

    def end(table: pa.Table, got: list[np.ndarray], own: bytes) -> pa.Table:
        table = _ordered(table)
        n_rows = table.num_rows
        hits = np.unpackbits(np.frombuffer(own, np.uint8)) > 0
        doc, start, k, second = _candidates(table, hits, window)
        ids = table.column("doc_id").to_numpy()[doc]
        order, at, count = _by_window(k, second, ids, start)
        first = order[at]
        gone = np.zeros(0, bool)
        if len(doc):
            here = (ids == spread(order, count, ids[first])) & (start == spread(order, count, start[first]))
            gone = ~(here & (spread(order, count, got[0]) > 0))
        doc, start = doc[gone], start[gone]
        texts, n_words, n_removed, spans, at_span = [], [], [], [], [0]
        for w in words(table.column("text")):
            n = w.counts()
            head = np.cumsum(n) - n
            i, j = np.searchsorted(doc, [w.first, w.first + w.n_docs])
            word = head[doc[i:j] - w.first] + start[i:j]
            change = np.zeros(len(w.doc) + 1, np.int64)
            np.add.at(change, word, 1)
            np.add.at(change, word + window, -1)
            removed = np.cumsum(change[:-1]) > 0
            texts.append(_kept(w, ~removed))
            n_words.append(n)
            n_removed.append(np.bincount(w.doc[removed] - w.first, minlength=w.n_docs))
            edge = np.flatnonzero(removed)
            begins = edge[np.concatenate([[True], (edge[1:] != edge[:-1] + 1) | (w.doc[edge[1:]] != w.doc[edge[:-1]])])] if len(edge) else edge
            ends = edge[np.concatenate([(edge[1:] != edge[:-1] + 1) | (w.doc[edge[1:]] != w.doc[edge[:-1]]), [True]])] if len(edge) else edge
            owner = w.doc[begins] - w.first
            spans.append(np.stack([begins - head[owner], ends - head[owner] + 1], 1))
            at_span.append(np.bincount(owner, minlength=w.n_docs))
        flat = np.concatenate(spans) if spans else np.empty((0, 2), np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(at_span[1:]))]) if len(at_span) > 1 else np.zeros(1)
        pair = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int32()), pa.array(flat[:, 1], pa.int32())], ["first", "end"])
        out = {"doc_id": table.column("doc_id"), "n_words": pa.array(np.concatenate(n_words), pa.int64()), "n_removed": pa.array(np.concatenate(n_removed), pa.int64()), "kept_text": pa.concat_arrays(texts).cast(pa.string()), "removed_spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pair)}
        assert len(out["n_words"]) == n_rows
        return pa.table(out | {c: table.column(c) for c in kept})

    answered = answer(send(dealt, keys, sizes), reply, sizes)
    answered = answer(send_again(dealt, answered, again, sizes, sizes), earliest, sizes)
    types = dict(named.dtypes)
    schema = "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<struct<first: int, end: int>>" + "".join(f", {k} {types[k]}" for k in kept)
    out = finish(dealt, answered, end, schema, sizes, noted=True)
    own_id = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id")
    return out.select(own_id, *result[1:], *(F.col(k).alias(c) for c, k in zip(carry, kept)))
