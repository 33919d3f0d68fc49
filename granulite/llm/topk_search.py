"""Exact top-k inner products by no-random-access aggregation (NRA).

Each dimension of a block of vectors is a list of (value, vector), sorted. A query q
reads the lists from their tops where q_j > 0 and from their bottoms where q_j < 0, so
that contributions q_j x_j fall as it reads; where q_j = 0 it reads nothing. Reading
goes on in rounds, each as deep again into what is left of every list. Of a vector that
was met in some lists the sum of what was read is known, and each list that it wasn't
met in yet gives it at most the contribution last read there and at least that of the
list's far end. That makes a lower and an upper bound for every vector, met or not.

Vectors whose upper bound is below the k-th largest lower bound cannot qualify, and
what is read of them later is passed over. A query ends when the bounds of all vectors
that are left have met: their scores are final then. Lists are only read in order; no
vector is looked up.

Queries of a block read equally deep, so which lists have shown which vectors is the same
for all that read from the same end. While most vectors are left, what a round reads
(a matrix of the entries read, by vector) and what is unread (the incidence of lists that
haven't shown a vector) are therefore held against all queries of a block at once, as
products; later only the entries of vectors that are left are added.

Queries and candidates are both cut into blocks, and every pair of blocks is one row
of work with at most k results for each query, so neither side is ever in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of queries; part of what is left of the lists that a round reads.
CANDIDATES, QUERIES, PART = 8192, 256, 0.5
#: Part of a block's vectors below which those that are left are followed one by one.
FEW = 1 / 16
#: Tasks that pairs of blocks are dealt to at least, if there are as many; blocks of queries that share a copy of a block of candidates at most; tasks at most.
SPREAD, SHARE, TASKS = 256, 16, 20_000
#: Lengths of vectors up to which their counts are broadcast.
LENGTHS = 10_000


class Lists:
    """The lists of a block of vectors: of each dimension the values and the vectors' numbers, ascending by value."""

    def __init__(self, x: np.ndarray):
        self.n, self.d = x.shape
        self.vectors = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.take_along_axis(x.T, self.vectors, 1))


def nra(q: np.ndarray, lists: Lists, k: int, own: np.ndarray | None = None, part: float = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of at least the k best vectors of each query, ties at the last place included, and entries read for each query.

    q: a matrix of integers as float64. own: pairs (query, vector) as a boolean matrix
    that take no part.
    """
    n, d = lists.n, lists.d
    read = np.zeros(len(q), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not n or not len(q):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), read
    weight = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], 1)  # of each list read from its top and from its bottom
    alive = np.ones((len(q), n), bool) if own is None else ~own
    known = np.zeros((len(q), n))  # sum of what was read
    hidden = np.ones((n, 2 * d))  # lists that haven't shown a vector yet
    far = np.concatenate([lists.values[:, 0], lists.values[:, -1]])
    open_, r = np.arange(len(q)), 0
    while True:
        # the last values read; before reading, the first
        last = np.concatenate([lists.values[:, n - max(r, 1)], lists.values[:, max(r, 1) - 1]])
        many = alive[open_].sum() > FEW * len(open_) * n
        ends = np.zeros(len(open_), bool)
        if many:
            left = known[open_]
            w = weight[open_]
            upper = left + (w * last) @ hidden.T if r else np.broadcast_to((w @ last)[:, None], left.shape)
            lower = left + (w * far) @ hidden.T if r else np.broadcast_to((w @ far)[:, None], left.shape)
            live = alive[open_]
            lower = np.where(live, lower, -np.inf)
            if n > k:
                live &= upper >= np.partition(lower, n - k, axis=1)[:, n - k, None]
            alive[open_] = live
            ends = ~(live & (upper > lower)).any(1)
            i, j = np.nonzero(live & ends[:, None])
            out.append((open_[i], j, lower[i, j]))
        else:
            for at, i in enumerate(open_):
                j = np.flatnonzero(alive[i])
                unread = hidden[j]
                upper, lower = known[i, j] + unread @ (weight[i] * last), known[i, j] + unread @ (weight[i] * far)
                if len(j) > k:
                    stays = upper >= np.partition(lower, len(j) - k)[len(j) - k]
                    alive[i, j[~stays]] = False
                    j, upper, lower = j[stays], upper[stays], lower[stays]
                ends[at] = not (upper > lower).any()
                if ends[at]:
                    out.append((np.full(len(j), i), j, lower))
        open_ = open_[~ends]
        if not len(open_):
            break
        # read on
        to = min(n, r + max(1, int((n - r) * part)))
        top, bottom = slice(n - to, n - r), slice(r, to)
        read[open_] += (to - r) * np.count_nonzero(q[open_], axis=1)
        if many:  # what a round reads, by vector, for all queries at once
            shown = np.zeros((n, 2 * d))
            for j in range(d):
                shown[lists.vectors[j, top], j] = lists.values[j, top]
                shown[lists.vectors[j, bottom], d + j] = lists.values[j, bottom]
            known[open_] += weight[open_] @ shown.T
        else:
            place = np.full(n, -1)
            for i in open_:
                j = np.flatnonzero(alive[i])
                place[j] = np.arange(len(j))
                plus, minus = np.flatnonzero(q[i] > 0), np.flatnonzero(q[i] < 0)
                met = place[np.concatenate([lists.vectors[plus, top].ravel(), lists.vectors[minus, bottom].ravel()])]
                at = np.flatnonzero(met >= 0)
                gives = np.concatenate([(lists.values[plus, top] * q[i, plus, None]).ravel(), (lists.values[minus, bottom] * q[i, minus, None]).ravel()])
                known[i, j] += np.bincount(met[at], gives[at], len(j))
                place[j] = -1
        for j in range(d):
            hidden[lists.vectors[j, top], j] = 0
            hidden[lists.vectors[j, bottom], d + j] = 0
        r = to
    i, j, score = (np.concatenate(x) for x in zip(*out))
    return i, j, score, read


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query: by score, ties by smaller id."""
    order = np.lexsort((ids, -score, i))
    first = np.searchsorted(i[order], i[order], "left")
    return order[np.arange(len(order)) - first < k]


def _distinct(ids: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Positions of the different rows (id and vector), by id."""
    whole = np.concatenate([ids[:, None].view(np.uint8), np.ascontiguousarray(m, np.float64).view(np.uint8).reshape(len(ids), -1)], 1)
    at = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_index=True)[1]
    return at[np.argsort(ids[at], kind="stable")]


def topk_search(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, every: int = 50, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer inner product for each query.

    A component x counts as floor(scale * x). Queries are the rows whose id is divisible
    by ``every``, candidates all rows but those of the query's id. Equal scores are
    ranked by smaller id; fewer than k candidates are all returned.

    * Rows with a null id, a null vector or a null or non-finite component take no part.
    * Equal rows (id and vector) count once. Rows that share an id are one document
      with several vectors: its score is the best of them.
    * Vectors are only compared with those of equal length; the empty ones score 0.
    * Without rows or queries the result is empty; further columns are not read.
    """
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(v * scale).cast("double"))
    fine = F.col("x").isNotNull() & F.col("vec_id").isNotNull() & F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias(vector))
    rows = rows.withColumn("x", F.col(vector)).where(fine).select("vec_id", x.alias("x")).withColumn("dim", F.size("x"))
    n = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).where("q > 0")
    blocks = n.select("dim", F.ceil(F.col("n") / candidates).alias("cb"), F.ceil(F.col("q") / queries).alias("qb"))
    # blocks of queries that share a copy of a block of candidates: one while pairs are few
    share = F.least(F.greatest(F.floor(F.col("cb") * F.col("qb") / SPREAD), F.lit(1)), F.lit(SHARE))
    blocks = blocks.withColumn("share", share).withColumn("groups", F.ceil(F.col("qb") / F.col("share")))
    size = blocks.agg(F.count(F.lit(1)).alias("lengths"), F.sum(F.col("cb") * F.col("groups")).alias("tasks")).first()
    tasks = min(max(1, size["tasks"] or 1), TASKS)
    rows = rows.join(F.broadcast(blocks) if size["lengths"] <= LENGTHS else blocks, "dim")
    h = F.xxhash64("vec_id", "x")
    own = rows.withColumn("block", F.pmod(h, "cb"))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(h, "qb"))
    pack = "dim int, block long, cb long, share long, groups long, ids binary, matrix binary"

    def packed(df: DataFrame) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            ids, d = table.column("vec_id").to_numpy(), table.column("dim")[0].as_py()
            m = np.asarray(pa.concat_arrays(table.column("x").chunks).flatten() if d else np.empty(0), np.float64).reshape(len(ids), d)
            at = _distinct(ids, m)
            m = m[at]
            small = np.int16 if not m.size or np.abs(m).max() < 2**15 else np.float64
            kind = b"s" if small is np.int16 else b"d"
            first = {c: table.column(c)[:1] for c in ("block", "cb", "share", "groups")}
            return pa.table({"dim": pa.array([d], pa.int32()), **first, "ids": pa.array([ids[at].tobytes()], pa.binary()), "matrix": pa.array([kind + m.astype(small).tobytes()], pa.binary())})

        return df.select("dim", "block", "cb", "share", "groups", "vec_id", "x").groupBy("dim", "block").applyInArrow(run, pack)

    # a stated set of queries against all rows, in blocks: a row for each pair of blocks, a task for each group of them
    keys = ["dim", "block", "group"]
    ask = packed(asked).select("dim", F.floor(F.col("block") / F.col("share")).alias("group"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cb") - 1)).alias("block"))
    have = packed(own).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select(*keys, "ids", "matrix")
    work = have.repartition(tasks, *keys).join(ask.repartition(tasks, *keys).hint("merge"), keys).select("dim", "ids", "matrix", "q_ids", "q")

    def matrix(data: bytes, d: int, n: int) -> np.ndarray:
        return np.frombuffer(data, np.int16 if data[:1] == b"s" else np.float64, offset=1).astype(np.float64).reshape(n, d)

    def run(batches):
        seen = lists = None
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                if (row["ids"], row["matrix"]) != seen:
                    seen, lists = (row["ids"], row["matrix"]), Lists(matrix(row["matrix"], row["dim"], len(ids)))
                i, j, s, _ = nra(matrix(row["q"], row["dim"], len(q_ids)), lists, k, q_ids[:, None] == ids[None, :])
                to = np.searchsorted(known := np.sort(q_ids), q_ids)  # rows of one id are one query
                i, v = to[i], ids[j]
                order = np.lexsort((-s, v, i))  # the best vector of each pair of ids
                order = order[np.concatenate([[True], (i[order][1:] != i[order][:-1]) | (v[order][1:] != v[order][:-1])])] if len(order) else order
                best = order[_best(i[order], v[order], s[order], k)]
                yield pa.RecordBatch.from_arrays([pa.array(known[i[best]], pa.int64()), pa.array(v[best], pa.int64()), pa.array(s[best].astype(np.int64))], names=["query_id", "vec_id", "score"])

    found = work.mapInArrow(run, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # two steps, so no task ranks all blocks' results of a query when blocks are many
    some = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(some)).where(F.col("r") <= k)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
