"""Contiguous shards of nearly equal byte size.

Rows are range-partitioned by document id; each range yields a total of bytes and rows, the
running sums of the totals (one row per range) give every range its offset, and a running
sum inside the range gives every row its place among all bytes. A row belongs to the shard
that holds the middle of its bytes, so a shard is off an equal share by at most the size of
one row at each end.

Cases: a null text has no bytes (size 8, checksum of the empty string). Null ids come
first, rows that tie are ordered by checksum, size and scan order, so one key with many rows
still spreads over several ranges. An empty table gives no rows; fewer rows than shards
leave shards empty. Columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.llm.common import parallelism, settled, table
from diffspark.stage import materialise

ROW_BYTES = 8  # added to every row's text bytes by the contract
ORDER = ["doc_id", "text_crc32", "size", "row"]


def place(rows: DataFrame, shards: int, ranges: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows that have the columns of ORDER.

    ``ranges`` bounds the table of totals, which is the only broadcast."""
    dealt = materialise(
        rows.repartitionByRange(ranges, *ORDER).withColumn("range", F.spark_partition_id())
    )
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    totals = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    inside = W.partitionBy("range").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    ends = dealt.withColumns(
        {"upto": F.sum("size").over(inside), "nth": F.row_number().over(inside)}
    ).join(F.broadcast(offsets), "range")
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")  # twice the place
    cut = F.floor(middle.cast("decimal(30,0)") * shards / (2 * F.col("all_bytes"))).cast("int")
    placed = materialise(
        ends.withColumns(
            {"shard": F.least(cut, F.lit(shards - 1)), "nth": F.col("rows_before") + F.col("nth")}
        ).drop("range", "bytes_before", "rows_before", "all_bytes", "upto")
    )
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").withColumn(
        "slot", (F.col("nth") - F.col("first")).cast("long")
    )


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, row."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    return place(rows, shards, ranges=4 * parallelism(spark)).drop("nth", "first")


def write_shards(docs: DataFrame, shards: int, path: str, files_per_shard: int = 4) -> None:
    """Write the documents in folders ``shard=0`` ... in slot order within each file. A
    shard is dealt to ``files_per_shard`` tasks by contiguous slots."""
    docs = settled(docs)
    tagged = docs.withColumn("_shard_row", F.monotonically_increasing_id())
    to = shard(tagged.select("doc_id", "text"), shards).select("row", "shard", "slot")
    both = tagged.join(to, tagged["_shard_row"] == to["row"]).drop("_shard_row", "row")
    both.repartitionByRange(shards * files_per_shard, "shard", "slot").sortWithinPartitions(
        "shard", "slot"
    ).write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by bytes."""
    out = shard(table(spark, sf_dir, "documents"), 24)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
