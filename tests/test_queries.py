"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from check_oracles import canonical, compare, database


KEYS = [k for k in entry.queries() if k.startswith("q_")]


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, con, small, key):
    text, *_ = compare(spark, con, key, small)
    assert text.startswith(("ok", "rows-only")), text
    assert "TYPES" not in text, text
    assert not text.startswith("rows-only 0 ")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    columns, rows = canonical(*_collect(entry.entry(spark)))
    assert columns == ["auROC", "comparison"]
    assert len(rows) == 3


def _collect(df):
    return df.columns, [tuple(r) for r in df.collect()]


def test_results_do_not_depend_on_partitioning(spark, con, small):
    """Draws are keyed and ranks are exact, so another partitioning changes nothing."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        for key in ("q_impute_multi", "q_bh", "q_confusion_strict", "q_min_alpha"):
            text, *_ = compare(spark, con, key, small)
            assert text.startswith("ok"), (key, text)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
