"""Mixing sources to target weights with hierarchical budgets.

Documents are leaves of a tree: domain, language, source. A budget of tokens enters
at the root. Each node hands its budget to its children in proportion to their
weights; a child that can't use its share (all its tokens times the epochs allowed)
takes what it can, and the rest goes to its siblings by their weights. What a whole
family can't use was never handed to it, since a node's capacity is that of its
leaves: so shortages are made up among siblings first, then among the parent's
siblings, up to the root.

A leaf then draws its budget from epochs. In each epoch its documents have an order
of their own, by a hash of seed, epoch and id; whole epochs are taken while they fit,
and of the last one the longest prefix whose tokens fit. The prefix is found as one
threshold of the hash for each leaf, by sums over ranges of hashes, so no leaf is ever
sorted as a whole. Words are counted once, into a narrow table of ids, leaves and
counts; documents are then chosen in place by their leaf's threshold, without moving
their texts.

All of it is DataFrame operations on integers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

LEAF = ["domain", "lang", "source"]
#: Target weights of the nodes of each level, and of those that aren't listed.
WEIGHTS = {"domain": {"d0": 3, "d1": 2, "d2": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src4": 2, "src9": 3}}
OTHER = 1
#: Percentage of all tokens to take; epochs of a document at most.
PERCENT, EPOCHS, SEED = 50, 2, "mix-1"
#: Leaves up to which their table is broadcast (of about a hundred bytes each); salts of a leaf beyond.
LEAVES, SALTS = 100_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 4, for sources named with a number at the end."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("int") % 4).cast("string"))).otherwise("other")


def _big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _share(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """alloc for each node: its part of ``budget``, the parent's, by ``weight`` and at most ``cap``. All are long.

    In the order of cap / weight, a node is full if it is when what the nodes before it
    leave is dealt by weight; the others deal what the full ones leave. Shares are
    rounded down, so at most one token a node is left over.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), key) if parent else Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), key)
    all_ = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    first = by.rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumn("used", F.coalesce(F.sum("cap").over(first), F.lit(0))).withColumn("rest", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(first), F.lit(0)))
    n = n.withColumn("full", _big("cap") * _big("rest") <= _big(F.col("budget") - F.col("used")) * _big("weight"))
    n = n.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_), F.lit(0)))
    n = n.withColumn("among", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_), F.lit(1)))
    exact = F.expr("cast((cast(left as decimal(19,0)) * cast(weight as decimal(19,0))) div cast(among as decimal(19,0)) as long)")
    return n.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(exact)).drop("used", "rest", "full", "left", "among")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    listed = weights.get(level) or {}
    found = F.create_map(*(F.lit(x) for kv in listed.items() for x in kv))[F.col(level)] if listed else F.lit(None)
    return F.coalesce(found, F.lit(OTHER)).cast("long")


def budgets(leaves: DataFrame, total: int, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves: LEAF and tokens. Adds alloc, the tokens that each leaf is to give.

    The children of one node meet in one task: they are rows of a table of names, one for
    each domain, language of a domain or source of a language, however many documents there are.
    """
    nodes = leaves.withColumn("cap", F.col("tokens") * epochs)
    given = None
    for n in range(1, len(LEAF) + 1):
        parent, level = LEAF[: n - 1], LEAF[n - 1]
        level_nodes = nodes.groupBy(*LEAF[:n]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights))
        level_nodes = level_nodes.join(given, parent) if parent else level_nodes.withColumn("budget", F.lit(total).cast("long"))
        given = _share(level_nodes, parent, level).select(*LEAF[:n], F.col("alloc").alias("budget"))
    return leaves.join(given.withColumnRenamed("budget", "alloc"), LEAF).select(*LEAF, "tokens", "alloc")


def _of_leaf(rows: DataFrame, side: DataFrame, few: bool) -> DataFrame:
    """rows (with doc_id) and what side holds for their leaf. A leaf may hold a third of all rows: its rows stay where they are, or are spread."""
    if few:
        return rows.join(F.broadcast(side), LEAF)
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*LEAF, "__salt"]).drop("__salt")


def mix_sources(docs: DataFrame, id_: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED, weights: dict[str, dict[str, int]] | None = None, carry: tuple[str, ...] = (), leaves_at_once: int = LEAVES) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch) and the columns named in carry, once for each epoch that takes a row.

    Tokens are words. ``percent`` of all tokens are to be taken, each row in at most
    ``epochs`` epochs (numbered from 0). weights: for each level (domain, lang, source)
    the target weights of its nodes by name; others weigh 1.

    * A null or wordless text has no tokens and is never taken. Null languages and
      sources are a language ``und`` and a source ``none``; the domain of names without
      a number at their end is ``other``.
    * Rows that share an id have one place in an epoch's order: all of them that are in
      one leaf are taken or none. A null id counts as ''.
    * A budget above all capacities takes every row in every epoch. An empty table gives
      an empty table. Carried columns come last, and one named like a result is left out.
    """
    weights = WEIGHTS if weights is None else weights
    result = ["doc_id", *LEAF, "n_tokens", "epoch"]
    carry = tuple(c for c in carry if c not in result)
    kept = [f"__carry{i}" for i in range(len(carry))]
    from_source = F.coalesce(F.col(source).cast("string"), F.lit("none"))
    whole_text = F.col(text).cast("string")
    rows = docs.where(F.coalesce(whole_text.rlike(WORD), F.lit(False))).select(
        F.col(id_).cast("long").alias("doc_id"), domain_of(from_source).alias("domain"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), from_source.alias("source"),
        F.regexp_count(whole_text, F.lit(WORD)).cast("long").alias("n_tokens"), *(F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept)),
    )
    narrow = cut(rows.drop(*kept))
    leaves = cut(narrow.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    size = leaves.agg(F.sum("tokens"), F.sum("n"), F.count(F.lit(1))).first()
    total, n, few = (size[0] or 0) * percent // 100, size[1] or 1, size[2] <= leaves_at_once
    plan = budgets(leaves.drop("n"), total, epochs, weights).withColumn("whole", F.expr("alloc div tokens").cast("int")).withColumn("rest", F.col("alloc") % F.col("tokens"))
    plan = cut(plan)

    # of the epoch that is taken in part: the largest hash within the prefix
    digits = min(4, max(1, math.ceil(math.log(max(n / 256, 1), 16))))
    def place(epoch: Column) -> Column:
        return F.md5(F.concat(F.lit(f"{seed}/"), epoch.cast("string"), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))

    keyed = _of_leaf(narrow, plan.where("rest > 0").select(*LEAF, "whole", "rest"), few).withColumn("place", place(F.col("whole")))
    ranges = keyed.groupBy(*LEAF, "rest", F.substring("place", 1, digits).alias("range")).agg(F.sum("n_tokens").alias("t"))
    ranges = ranges.withColumn("upto", F.sum("t").over(Window.partitionBy(*LEAF).orderBy("range")))
    edge = ranges.where("upto > rest").groupBy(*LEAF).agg(F.min("range").alias("edge"), F.min(F.col("upto")).alias("upto"), F.min(F.struct("range", "t"))["t"].alias("t"))
    edge = edge.select(*LEAF, "edge", (F.col("upto") - F.col("t")).alias("before"))
    edge = cut(edge)
    within = _of_leaf(keyed, edge, few).where(F.substring("place", 1, digits) == F.col("edge")).groupBy(*LEAF, "rest", "before", "place").agg(F.sum("n_tokens").alias("t"))
    within = within.withColumn("upto", F.col("before") + F.sum("t").over(Window.partitionBy(*LEAF).orderBy("place")))
    last = within.where("upto <= rest").groupBy(*LEAF).agg(F.max("place").alias("last"))
    limits = plan.where("alloc > 0").select(*LEAF, "whole").join(edge.select(*LEAF, "edge"), LEAF, "left").join(last, LEAF, "left").withColumn("limit", F.coalesce("last", "edge"))

    drawn = _of_leaf(rows if kept else narrow, cut(limits.select(*LEAF, "whole", "limit")), few)
    some = F.coalesce(place(F.col("whole")) <= F.col("limit"), F.lit(False))
    n_epochs = F.col("whole") + F.when(some, 1).otherwise(0)
    drawn = drawn.withColumn("n_epochs", n_epochs).where("n_epochs > 0")
    out = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("n_epochs") - 1)))
    return out.select(*result, *(F.col(k).alias(c) for c, k in zip(carry, kept)))


def oracle_sql(percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED, weights: dict[str, dict[str, int]] | None = None) -> str:
    """DuckDB SQL for mix_sources over documents, without range sums and thresholds."""
    weights = WEIGHTS if weights is None else weights

    def weight(of: str) -> str:
        return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in (weights.get(of) or {"": OTHER}).items()) + f" ELSE {OTHER} END"

    def level(name: str, nodes: str, parent: str, key: str, budget: str) -> str:
        over = f"PARTITION BY {parent}" if parent else "PARTITION BY 0"
        return f"""
{name}0 AS (SELECT n.*, {budget} AS budget FROM {nodes}),
{name}1 AS (SELECT *, coalesce(sum(cap) OVER ({over} ORDER BY cap / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER ({over}) - coalesce(sum(weight) OVER ({over} ORDER BY cap / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM {name}0),
{name}2 AS (SELECT *, cap::HUGEINT * rest <= (budget - used)::HUGEINT * weight AS fits FROM {name}1),
{name}3 AS (SELECT *, budget - coalesce(sum(cap) FILTER (WHERE fits) OVER ({over}), 0) AS remains, coalesce(sum(weight) FILTER (WHERE NOT fits) OVER ({over}), 1) AS among FROM {name}2),
{name} AS (SELECT *, CASE WHEN fits THEN cap ELSE (remains::HUGEINT * weight) // among END AS alloc FROM {name}3)"""

    return f"""
WITH r AS (SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, 'none') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
d AS (SELECT *, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::INT % 4) ELSE 'other' END AS domain FROM r WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {epochs} AS cap FROM d GROUP BY ALL),
{level("dom", f"(SELECT domain, sum(cap)::BIGINT AS cap, {weight('domain')} AS weight FROM leaf GROUP BY 1) n", "", "domain", f"(SELECT sum(tokens)::BIGINT * {percent} // 100 FROM leaf)").strip()},
{level("lan", f"(SELECT domain, lang, sum(cap)::BIGINT AS cap, {weight('lang')} AS weight FROM leaf GROUP BY 1, 2) n JOIN dom USING (domain)", "domain", "lang", "dom.alloc").strip()},
{level("src", f"(SELECT *, {weight('source')} AS weight FROM leaf) n JOIN lan USING (domain, lang)", "domain, lang", "source", "lan.alloc").strip()},
plan AS (SELECT domain, lang, source, alloc // tokens AS whole, alloc % tokens AS rest FROM src),
k AS (SELECT d.*, whole, rest, md5('{seed}/' || whole::BIGINT || '/' || coalesce(doc_id::VARCHAR, '')) AS place FROM d JOIN plan USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM k),
e AS (SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS n FROM c)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, n))::INT AS epoch FROM e WHERE n > 0
"""
