"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches a threshold t. Let the shingles of all documents have one total order, from
the rarest to the most frequent. If x and y link, they share at least
``ceil(t |x|)`` shingles, so of the first ``|x| - ceil(t |x|) + l`` shingles of x
and the like of y at least l are shared, for any l. A document takes the l that
makes its estimated cost least: a longer prefix meets more documents but asks them
for more matches before they are verified. A pair needs the lesser of both l. With
both sizes known a pair needs ``O = ceil(t (|x| + |y|) / (1 + t))`` shared shingles,
so only matches among its first ``|x| - O + l`` and ``|y| - O + l`` count.

How the work stays bounded:

* The order needs the document frequency of every shingle. It comes from
  :mod:`.blocks`. A shingle of one document alone can't be shared: only shared
  shingles leave a block, and only of documents with enough of them to link at all.
* Documents with equal sets are one *class*; classes are joined, not copies.
* A group of g near copies has g^2 links but needs g - 1 to be a component. First
  each class is verified against the few *hubs* that its prefixes meet most often
  (the least class of a prefix's list); what that connects is not joined again.
  Then all pairs of classes that are still apart and meet in a prefix are counted,
  held against the needed matches and verified: that step is complete, so no link
  between classes of different components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, FILTER_BITS, Sizes, answer, deal, finish, groups, measure, send, short, spread, tally
from .components import components
from .lineage import cut
from .words import mix, windows, words

_U = np.uint64
#: Work of verifying a pair, in steps through a prefix's list; longest l tried; hubs that each class is verified against.
VERIFY_COST, LONGEST, HUBS = 16, 8, 2
#: Classes of a prefix's list that a task pairs with the whole list at once.
LIST = 256


def shingles(texts: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct shingle of each text, by text."""
    docs, hs = [np.empty(0, np.int64)], [np.empty(0, _U)]
    for w in words(texts, lower=True):
        per_text = w.counts()
        h = windows(w.hash, n)
        d = w.doc[: len(h)]
        whole = d == w.doc[n - 1 :]
        d, h = [d[whole]], [h[whole]]
        ends = np.cumsum(per_text)
        for k in range(1, n):  # fewer words than a shingle: the whole sequence is one
            few = np.flatnonzero(per_text == k)
            if len(few):
                d.append(few + w.first)
                h.append(mix(windows(w.hash, k)[ends[few] - k] + _U(k)))
        d, h = np.concatenate(d), np.concatenate(h)
        order = np.argsort(h ^ mix(d.astype(_U)), kind="stable")  # equal pairs stand together
        d, h = d[order], h[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        d, h = d[new], h[new]
        order = np.argsort(d, kind="stable")
        docs.append(d[order])
        hs.append(h[order])
    return np.concatenate(docs), np.concatenate(hs)


def _grade(df: np.ndarray) -> np.ndarray:
    """Document frequency as a number of a byte: 0 for 1, and an eighth of an octave a step."""
    return np.minimum(np.round(8 * np.log2(df.astype(float))), 255).astype(_U)


def _records(ids: pa.ChunkedArray, n_texts: int, doc: np.ndarray, h: np.ndarray, grade: np.ndarray, percent: int) -> pa.Table:
    """A row for each text; tokens, lead and need are filled where it has enough shared shingles to link."""
    n = np.bincount(doc, minlength=n_texts)
    ends = np.cumsum(n)
    sums = []
    for salt in (1, 2):
        c = np.concatenate([[_U(0)], np.cumsum(mix(h + _U(salt)))]).astype(_U)
        sums.append((c[ends] - c[ends - n]).view(np.int64))
    known = grade > 0
    heft = np.bincount(doc, weights=grade, minlength=n_texts) // np.maximum(n, 1)
    shared = np.bincount(doc[known], minlength=n_texts)
    least = -(-percent * n // 100)
    able = (shared >= least) & (n > 0)
    keep = known & able[doc]
    doc, h, grade = doc[keep], h[keep], grade[keep]
    order = np.lexsort((h, grade, doc))
    doc, h, grade = doc[order], h[order], grade[order]
    count = np.where(able, shared, 0)
    at = np.cumsum(count) - count
    # cost of the first k tokens of a text, as a text of its size would meet them: how many documents their lists hold
    like = n - -(-2 * percent * n // (100 + percent)) - (n - shared)
    cost = np.concatenate([[0.0], np.cumsum(2.0 ** (grade.astype(float) / 8) - 1)])
    lead, need, best = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64), np.full(n_texts, np.inf)
    for l in range(1, LONGEST + 1):
        k = shared - least + l
        ok = able & (l <= least)
        i = np.where(ok, at, 0)
        total = (cost[i + np.where(ok, np.clip(like + l, 0, k), 0)] - cost[i]) * (1 + VERIFY_COST / l)
        better = ok & (total < best)
        lead[better], need[better], best[better] = k[better], l, total[better]
    return pa.table({
        "doc_id": ids, "n_shingles": pa.array(n, pa.int64()), "h1": pa.array(sums[0], pa.int64()), "h2": pa.array(sums[1], pa.int64()),
        "tokens": pa.ListArray.from_arrays(pa.array(np.append(at, at[-1] + count[-1] if n_texts else 0), pa.int32()), pa.array(h.view(np.int64), pa.int64())),
        "lead": pa.array(lead, pa.int32()), "need": pa.array(need, pa.int32()), "alone": pa.array(n - shared, pa.int32()), "heft": pa.array(heft, pa.int32()),
    })


def records(docs: DataFrame, id_: str, text: str, n: int, percent: int, block_bytes: int) -> DataFrame:
    """A row for each document: set size, hash of the set, and shared shingles from rare to frequent where it may link."""
    sizes: Sizes = measure(docs, text, block_bytes, FILTER_BITS)
    dealt = deal(docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id", "text", sizes)

    def keys(table: pa.Table):
        _, h = shingles(table.column("text"), n)
        k, count, _ = tally(short(h, FILTER_BITS), np.zeros(len(h), bool))
        return [(k, [count.astype(_U)])]

    def reply(k, _, values):
        order, at, count = groups(k)
        df = np.add.reduceat(values[0][order], at) if len(k) else np.empty(0, _U)
        return [spread(order, count, _grade(df))]

    def end(table: pa.Table, got: list[np.ndarray]) -> pa.Table:
        doc, h = shingles(table.column("text"), n)
        order, at, count = groups(short(h, FILTER_BITS))
        grade = spread(order, count, got[0]) if got else np.empty(0, _U)
        return _records(table.column("doc_id"), table.num_rows, doc, h, grade, percent)

    answered = answer(send(dealt, keys, sizes), reply, sizes)
    return finish(dealt, answered, end, "doc_id long, n_shingles long, h1 long, h2 long, tokens array<long>, lead int, need int, alone int, heft int", sizes)


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    x, y = (classes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("tokens").alias(f"t_{k}")) for k in "ab")
    both = pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("t_a", "t_b")))
    return both.where(F.col("i") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("i"))).select("a", "b")


def _fits(percent: int):
    """Sizes that allow the similarity, and a match that is early enough in both orders."""
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent) - 1e-9)
    spare = F.least("need_a", "need_b") - 1 - overlap
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return sizes & (F.col("pos_a") <= F.col("n_a") + spare) & (F.col("pos_b") <= F.col("n_b") + spare)


def _side(lists: DataFrame, s: str, *more: str) -> DataFrame:
    return lists.select("token", F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("need").alias(f"need_{s}"), F.col("pos").alias(f"pos_{s}"), *more)


def ngram_jaccard_join(docs: DataFrame, id_: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of each row of docs.

    Text is lower-cased (A to Z) and cut into words. A document's set holds its
    distinct shingles of n words; with fewer words the whole sequence is one. Rows
    link when ``100 |x & y| >= percent |x | y|``. component_id is the least id that
    links reach, itself included; class_id the least id with an equal set.

    * A null or wordless text has an empty set, links with nothing and is its own
      component and class.
    * Every row counts by itself: repeated rows have equal sets, so one component;
      rows that share an id but not a text link only as their texts do.
    * A null id takes part; where it's alone in a component, component_id is null.
    * An empty table gives an empty table; further columns of docs are not read.
    """
    rows = cut(records(docs, id_, text, n, percent, block_bytes))
    key = ["n_shingles", "h1", "h2"]
    full = rows.where("n_shingles > 0")
    classes = full.where("lead > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id"), *(F.first(c).alias(c) for c in ("tokens", "lead", "need", "alone", "heft")))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    lists = classes.select("node", "n_shingles", "need", "alone", "heft", F.posexplode(F.slice("tokens", 1, F.col("lead"))).alias("pos", "token"))
    lists = lists.withColumn("pos", F.col("pos") + F.col("alone"))  # shingles of no other document come first
    first = ((255 - F.col("heft")).cast("long") * (1 << 54) + F.col("node"))
    hubs = lists.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(first).alias("hub")).where("c > 1").select("token", (F.col("hub") % (1 << 54)).alias("hub"))
    lists = cut(lists.join(hubs, "token").select("token", "node", "n_shingles", "need", "pos", "hub"))

    hub = _side(lists.where("node = hub"), "b")
    met = _side(lists.where("node <> hub"), "a").join(hub, "token").where(_fits(percent)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    met = met.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))).where(F.col("r") <= HUBS)
    links = cut(_verified(met, classes, percent))
    label = cut(components(links))
    lists = lists.drop("hub").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))

    # of each list: its largest component so far, and the classes outside it
    most = lists.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token")
    most = most.agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("n")).where("k > 1")
    most = most.select("token", F.col("m.label").alias("main"), F.ceil(F.col("n") / LIST).alias("slices"))
    apart = cut(lists.join(most, "token"))
    # a long list is split: each slice of it meets the list in a task of its own
    x = _side(apart.where("label <> main"), "a", F.col("label").alias("label_a"), F.pmod(F.xxhash64("node"), F.col("slices")).alias("slice"))
    y = _side(apart, "b", F.col("label").alias("label_b"), "main", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    pairs = x.join(y, ["token", "slice"]).where("label_a <> label_b and (label_b = main or a < b)").where(_fits(percent))
    # a pair may stand once either way round, by which component is the main one of a list
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("need_a", "need_b").alias("need"))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need")).where("c >= need")
    links = links.unionByName(_verified(pairs, classes, percent))

    # the least id of a component, over its classes
    label = components(links).join(classes.select("node", "class_id"), "node")
    least = label.groupBy("label").agg(F.min("class_id").alias("component_id"))
    linked = label.join(least, "label").select("node", "component_id")
    found = classes.join(linked, "node").select(*key, "component_id")
    ids = full.groupBy(*key).agg(F.min("doc_id").alias("class_id")).join(found, key, "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    out = full.select("doc_id", *key).join(ids, key).select("doc_id", "n_shingles", "component_id", "class_id")
    return out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id")))
