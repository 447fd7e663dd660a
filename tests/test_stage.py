"""Stage tables and the scope that removes them."""

import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from diffspark.plans import catalog
from diffspark.stage import finished, materialise, stage_root, stage_scope


def files(spark):
    root = stage_root(spark).removeprefix("file:")
    return {d for d in os.listdir(f"{root}/diffspark")} if os.path.isdir(f"{root}/diffspark") else set()


def test_scope_leaves_nothing(spark, small):
    before = files(spark)
    with stage_scope(spark):
        assert catalog.QUERIES["q_bh"](spark, small).count() > 0
        assert catalog.QUERIES["q_stage_reload"](spark, small).count() == 3
        assert len(files(spark)) > len(before)
    assert files(spark) == before


def test_nested_scopes(spark):
    with stage_scope(spark):
        outer = materialise(spark.range(3))
        with stage_scope(spark):
            materialise(spark.range(2))
        assert outer.count() == 3


def test_a_finished_table_leaves_nothing_else(spark):
    with stage_scope(spark):
        before = files(spark)
        done = finished(spark, lambda: materialise(spark.range(5)).where("id > 1"))
        assert len(files(spark) - before) == 1
        assert done.count() == 3


def test_shuffle_files_go_with_the_write(spark):
    """What a stage table has shuffled is not kept until the driver collects its garbage."""
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    with stage_scope(spark):
        before = tracker.shuffleStatuses().size()
        table = materialise(spark.range(5000).selectExpr("id % 100 AS k").groupBy("k").count())
        assert tracker.shuffleStatuses().size() <= before
        assert table.count() == 100


def test_consensus_methods_keeps_the_pairs_only(spark, small):
    """Tests and rates of both methods are removed once the pairs are written."""
    with stage_scope(spark):
        before = files(spark)
        pairs = catalog.QUERIES["q_consensus_methods"](spark, small)
        assert pairs.count() > 1000
        assert len(files(spark) - before) <= 3


def test_row_groups_are_cut_by_bytes(spark):
    """A task does not hold a hundred large rows before it looks at their size."""
    with stage_scope(spark):
        before = files(spark)
        large = F.udf(lambda _: os.urandom(1 << 20), "binary")
        table = materialise(spark.range(0, 60, 1, 1).select(large("id").alias("large")))
        (name,) = files(spark) - before
        folder = f"{stage_root(spark).removeprefix('file:')}/diffspark/{name}"
        (part,) = [f for f in os.listdir(folder) if f.endswith(".parquet")]
        found = pq.ParquetFile(f"{folder}/{part}").metadata
        sizes = [found.row_group(k).total_byte_size for k in range(found.num_row_groups)]
        assert table.count() == 60 and len(sizes) > 1 and max(sizes) < 40 << 20
