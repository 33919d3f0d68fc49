"""Language identification by prediction by partial matching (PPM).

One variable-order tree of byte contexts is grown for each language. The code length
of a byte is its PPM one: if the longest known context has seen it c times among n,
its probability is c / (n + q), where q, the number of different bytes seen there,
is the count of the escape (method C); else the escape is paid and the next shorter
context is asked, with the bytes already ruled out excluded, down to a uniform
choice among all 256 bytes. Statistics are frozen after training, so a text's code
length doesn't depend on what was scored before it, and every context's
probabilities sum to 1. The language with the least code length wins.

Frozen statistics make the code length of a byte a function of its context's node, so
training ends in two tables a language: the node of the longest known context by the
bytes before, and the bits of each byte at each node. Scoring a text is one pass of
array lookups over its bytes for each language.

Each language's tree is grown by a task of its own and written to the shared folder;
workers read it there. Neither texts nor tables pass through the driver.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .lineage import checkpoint_dir, cut
from .memory import trim
from .words import buffers, segments

#: Training rows for each language, at most; bytes of a training row's text at most, longer ones being taken as far as that; contexts' length.
ROWS, ROW_BYTES, ORDER = 400, 16384, 3
#: A language with fewer sampled rows within the limit takes longer ones as well.
FEW = 20
#: Languages x ranges of the sample up to which it's broadcast.
BROADCAST_ROWS = 100_000
SEPARATOR = 0xFF


def training_rows(docs: DataFrame, rows: int = ROWS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(lang, text): of each language the rows of least hash in each of ``rows`` ranges of hashes.

    A bounded sample of labelled rows, whole texts, that needs no sort of a language's
    rows: one aggregation with a bounded state for each language and range, and one
    look at the texts. A language with fewer than FEW of them (all languages are asked
    for, also those without one) takes the beginnings of at most FEW longer rows too, of
    row_bytes characters each.
    """
    few, long_ = min(FEW, rows), F.octet_length("text") > row_bytes
    h = F.xxhash64("text")
    labelled = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", "text", long_.alias("long"), h.alias("h"))
    labelled = labelled.withColumn("range", F.pmod(F.xxhash64("h"), F.when(F.col("long"), few).otherwise(rows)))
    key = ["lang", "long", "range"]
    least = cut(labelled.groupBy(*key).agg(F.min("h").alias("h")))
    enough = least.where("not long").groupBy("lang").count().where(F.col("count") >= few).select("lang")
    wanted = cut(least.where("not long").unionByName(least.where("long").join(enough, "lang", "left_anti").select(*least.columns)))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = labelled.join(wanted, [*key, "h"]).select(*key, F.when(F.col("long"), F.substring("text", 1, row_bytes)).otherwise(F.col("text")).alias("text"))
    one = Window.partitionBy(*key).orderBy("text")
    return found.dropDuplicates([*key, "text"]).withColumn("r", F.row_number().over(one)).where("r = 1").select("lang", "text")


class Tree:
    """A language's context tree as tables.

    symbol: a number for each byte, 0 for bytes that no training text holds; k: how many
    there are. node: by the symbols of the ``order`` bytes before, the longest known
    context, where k stands for what is before the text; node 0 is the empty context.
    bits: code length of a byte by node and symbol. A byte of SEPARATOR, which no UTF-8
    text holds, stands for what is before a text.
    """

    def __init__(self, texts: list[bytes], order: int = ORDER):
        seen = np.zeros(256, bool)
        for x in texts:
            seen[np.frombuffer(x, np.uint8)] = True
        if seen[SEPARATOR]:
            raise ValueError("not UTF-8")
        self.order = order
        self.symbol = np.where(seen, np.cumsum(seen), 0).astype(np.int32)
        self.k = k = int(seen.sum()) + 1
        base = k + 1
        width = np.ones(k)  # bytes that a symbol stands for
        width[0] = 256 - (k - 1)
        coded = [self.symbol[np.frombuffer(x, np.uint8)].astype(np.int64) for x in texts]
        self.node = np.zeros(base**order, np.int32)
        known, p, total = np.zeros(1, np.int64), np.full((1, k), 1 / 256), 0  # of the contexts that are one byte shorter
        bits = []
        for n in range(order + 1):
            # n-grams of n + 1 bytes as a context and the byte that follows, numbers in base k + 1 with the newest byte last
            grams = [np.zeros(max(0, len(s) - n), np.int64) for s in coded]
            for g, s in zip(grams, coded):
                for i in range(n + 1):
                    g *= base
                    g += s[i : i + len(g)]
            g, count = np.unique(np.concatenate([*grams, np.empty(0, np.int64)]), return_counts=True)
            contexts, row = np.unique(g // base, return_inverse=True)
            if not n and not len(contexts):
                contexts = np.zeros(1, np.int64)
            counts = np.zeros((len(contexts), k))
            counts[row, g % base] = count
            here = counts > 0
            shorter = p[np.searchsorted(known, contexts % base ** (n - 1))] if n else np.repeat(p, len(contexts), 0)
            left = (shorter * width * ~here).sum(1)
            # nothing to escape to: all of it goes to what was seen
            escape = np.where(left > 0, here.sum(1), 0)
            of = np.maximum(counts.sum(1) + escape, 1)
            spare = np.where(left > 0, escape / of / np.where(left > 0, left, 1), 0)
            spare[~here.any(1)] = 1.0
            p = np.where(here, counts / of[:, None], shorter * spare[:, None])
            known = contexts
            bits.append(-np.log2(np.maximum(p, 1e-300)).astype(np.float32))
            if n:
                self.node.reshape(-1, base**n)[:, contexts] = (total + np.arange(len(contexts))).astype(np.int32)
            total += len(contexts)
        # beyond the last node is what a separator after a text would get
        self.bits = np.append(np.concatenate(bits).reshape(-1), np.zeros(1, np.float32))
        self.symbol[SEPARATOR] = k

    def lengths(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length in bits of each of the texts in data, none empty, with ``order`` separators before each."""
        s, n = self.symbol[data], self.order
        at = s[: len(s) - n].copy() if n else np.zeros(len(s), np.int32)
        for i in range(1, n):
            at *= self.k + 1
            at += s[i : len(s) - n + i]
        at = self.node[at]
        at *= self.k
        at += s[n:]
        # 64-bit sums over slices of a bounded length
        cost = np.append(self.bits[at], np.float32(0)).astype(np.float64)
        return np.add.reduceat(cost, np.stack([begins - n, ends - n], 1).ravel())[::2]

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, order=self.order, k=self.k, symbol=self.symbol, node=self.node, bits=self.bits)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Tree:
        tree, of = cls.__new__(cls), np.load(io.BytesIO(data))
        tree.order, tree.k, tree.symbol, tree.node, tree.bits = int(of["order"]), int(of["k"]), of["symbol"], of["node"], of["bits"]
        return tree


class Model:
    """Context trees of some languages. langs: the languages, ascending."""

    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        self.trees = [trees[k] for k in self.langs]

    @classmethod
    def of(cls, texts: dict[str, list[bytes]], order: int = ORDER) -> Model:
        return cls({k: Tree(t, order) for k, t in texts.items()})

    def lengths(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Code length in bits of each text by language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for i, j in segments(offsets, 1 << 19):
            at = offsets[i : j + 1] - offsets[i]
            full = np.flatnonzero(np.diff(at) > 0)
            if not len(full):
                continue
            order = self.trees[0].order
            shift = order * (1 + np.arange(len(full)))
            spaced = np.insert(data[offsets[i] : offsets[j]], np.repeat(at[:-1][full], order), SEPARATOR)
            for n, tree in enumerate(self.trees):
                out[i + full, n] = tree.lengths(spaced, at[:-1][full] + shift, at[1:][full] + shift)
        return out


def predict(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best language, the first of equal ones, and its share of the probability of all."""
    best = lengths.argmin(1)
    gap = lengths - lengths.min(1, keepdims=True)
    return best, 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)


def train(docs: DataFrame, order: int = ORDER, rows: int = ROWS, row_bytes: int = ROW_BYTES) -> tuple[str, tuple[str, ...]]:
    """A folder with a tree for each language, and the languages. docs: columns lang and text.

    A language is one task, whose sample is bounded by rows and row_bytes, and so is its
    tree. The driver gets the languages' names. A task that runs twice writes the same again.
    """
    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/ppm-{uuid.uuid4().hex}"

    def grow(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        # as many characters may have more bytes
        texts = [x.as_py().encode()[:row_bytes].decode(errors="ignore").encode() for x in table.column("text")]
        files.write(folder, _file(lang), Tree(texts, order).saved())
        return pa.table({"lang": pa.array([lang], pa.string())})

    found = training_rows(docs, rows, row_bytes).groupBy("lang").applyInArrow(grow, "lang string").collect()
    return folder, tuple(sorted(r["lang"] for r in found))


def _file(lang: str) -> str:
    return hashlib.md5(lang.encode()).hexdigest() + ".npz"


@lru_cache(1)
def load(folder: str, langs: tuple[str, ...]) -> Model:
    return Model({k: Tree.loaded(files.read(folder, _file(k))) for k in langs})


def language_id(docs: DataFrame, id_: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, fold: int = 2, carry: tuple[str, ...] = (), order: int = ORDER, rows: int = ROWS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) and the columns named in carry, for each row of docs.

    Languages are learned from the text and non-null lang of rows whose crc32 of the id
    as text modulo ``folds`` isn't ``fold``. score is the share of the winner in the
    probabilities that all languages give the text, bits_per_byte its code length.

    * A null text, or one without a letter, is ``und`` with score 0 and no bits_per_byte; so is every text if nothing was learned.
    * Equal code lengths: the language first in alphabetical order wins. A null id counts as ''.
    * Repeated rows get equal results. An empty table gives an empty table. Carried
      columns come last, and one named like a result is left out.
    """
    result = ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"]
    carry = tuple(c for c in carry if c not in result)
    kept = [f"__carry{i}" for i in range(len(carry))]
    held = F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit(""))) % folds == fold
    folder, langs = train(docs.where(~held).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")), order, rows, row_bytes)
    named = docs.select(
        F.col(id_).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).cast("string").alias("__text"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"), *(F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept)),
    )

    def run(batches):
        m = load(folder, langs)
        for batch in batches:
            offsets, data = buffers(batch.column("__text"))
            letter = np.asarray(batch.column("__letter").to_pylist(), bool)
            n = len(letter)
            if m.langs and n:
                bits = m.lengths(offsets, data)
                best, score = predict(bits)
                per = bits.min(1) / np.maximum(np.diff(offsets), 1)
            else:
                letter, best, score, per = np.zeros(n, bool), np.zeros(n, int), np.zeros(n), np.zeros(n)
            names = np.array([*m.langs, "und"], object)[np.where(letter, best, len(m.langs))]
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(names.tolist(), pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(per, mask=~letter)]
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(k) for k in kept)], names=[*result, *kept])
        trim()

    types = dict(named.dtypes)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double" + "".join(f", {k} {types[k]}" for k in kept)
    return named.mapInArrow(run, schema).select(*result, *(F.col(k).alias(c) for c, k in zip(carry, kept)))
