from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 997} of" for i in range(20000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, slot string, n_words string, n_removed string, kept_text string, ids string, epoch string, domain string, held_out string, __block string, tokens string, component_id string, size string, law string, `a.b` string"
TEXTS = [
    (1, "the cat sat on the mat and then the dog came in to see what the cat had been doing all of the day long", "en", "src1"),
    (2, None, "en", "src0"),
    (3, "", "de", None),
    (4, "ein Hund und eine Katze sind im Haus und der Hund schläft", None, "src2"),
    (5, "ein Hund und eine Katze sind im Haus und der Hund schläft", "de", "other"),
    (5, "ein Hund und eine Katze sind im Haus und der Hund schläft", "de", "other"),
    (6, LONG, "en", "src0"),
    (7, LONG + " more", "en", "src0"),
    (None, "the cat sat on the mat and then the dog came in to see what the cat had been doing all of the day long", "en", "src0"),
    (8, " \t\n ", "en", "src9"),
    (9, "1234 5678 !!", "en", "src9"),
    (10, "日本語のテキスト 🤗 <b>x</b>", "de", "src0"),
    (11, "one two", "en", "src0"),
    (11, "one two three four five six seven", "en", "src1"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, ties, repeats, empty and long texts, and columns named like results."""
    n = len(SCHEMA.split(",")) - 5
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["x"] * n) for i, t, lang, s in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
