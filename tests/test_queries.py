"""Every raster query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connection, same
from conftest import DATA

from granulite import plans

@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, con, name):
    same(plans.queries()[name](spark, DATA), con, plans.oracle_sql()[name])


@pytest.mark.parametrize("name", ["geom_contains", "geom_same"])
def test_some_pixel_matches(spark, name):
    assert plans.queries()[name](spark, DATA).count() > 0


def test_sample_rows(spark):
    out = plans.queries()["sample_rows"](spark, DATA)
    assert out.columns == ["file_id", "index", "v"] and out.count() == 100


def test_entry(spark):
    assert plans.entry(spark, DATA).count() == 10


def test_every_query_but_sampling_has_sql():
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"sample_rows"}


def test_negations_share_a_scan(spark):
    """All operators are counted over one scan of the catalog and one of the files."""
    assert plans.queries()["geom_not"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_negations_of_no_pixels(spark, tmp_path):
    spark.read.parquet(f"{DATA}/embeddings.parquet").where("false").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {(r.n, r.files) for r in plans.queries()["geom_not"](spark, str(tmp_path)).collect()} == {(0, 0)}


@pytest.mark.parametrize("name", ["geom_overlaps", "geom_same", "geom_conjunction", "geom_not"])
def test_boxes_are_plain_arithmetic(spark, name):
    assert "lambda" not in plans.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
