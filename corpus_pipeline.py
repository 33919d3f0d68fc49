"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last
one ids instead of text. Null handling, ties and empty tables are those of the
operators: rows with a null or wordless text have no language and go with the first
stage, a null lang is recognised, a null source is a source ``none``, equal rows are one
document from the second stage on, and an empty table gives an empty table. docs may
hold any columns besides the five that are passed on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulite.llm.language_id import language_id
from granulite.llm.lineage import checkpoint_dir
from granulite.llm.mixing import mix_sources
from granulite.llm.ngram_join import ngram_jaccard_join
from granulite.llm.pieces import encode_pieces
from granulite.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Of all tokens that reach the mixing stage, the percentage that it takes, each document once.
MIX_PERCENT = 90


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; lang becomes what was recognised."""
    found = language_id(docs, carry=("text", "source", "n_chars"))
    return found.where("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, that with the least id; of equal rows one.

    Where rows share an id or have none, each is taken by itself, by a key of id and text,
    and of a component's rows with its least id the one with the least key stays; a null
    id comes last. Documents without a word don't link, and stay.
    """
    docs = docs.select(*COLUMNS)
    if not docs.groupBy("doc_id").count().where("count > 1").take(1):
        first = ngram_jaccard_join(docs).where("doc_id <=> component_id").select("doc_id").distinct()
        stays = F.col("doc_id").eqNullSafe(F.col("first_id"))
        return docs.join(first.withColumnRenamed("doc_id", "first_id"), stays, "left_semi").select(*COLUMNS)
    rows = docs.dropDuplicates(["doc_id", "text"]).withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = ngram_jaccard_join(rows, id_="row_key").select(F.col("doc_id").alias("row_key"), "component_id")
    found = found.join(rows.select("row_key", "doc_id"), "row_key")
    least = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    return rows.join(least.select("first.row_key"), "row_key", "left_semi").select(*COLUMNS)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a text that loses nothing stays as it is, one that loses all goes."""
    out = substring_dedup(docs, carry=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that their leaf's budget takes."""
    out = mix_sources(docs, percent=MIX_PERCENT, epochs=1, carry=("text", "n_chars"))
    return out.select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return encode_pieces(docs, carry=("lang", "source")).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("language ID", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("substring dedup", passage_stage),
    ("mixing", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: SQL can't express language ID and SentencePiece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
