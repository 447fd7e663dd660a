"""Exact dedup against a persistent digest index.

The index is a Parquet table of (digest, keep_id, batch), bucketed and sorted by the SHA-256
of the text. A new batch is reduced to one row per digest, anti-joined with the index by
sort-merge (the index side needs no shuffle: its buckets are the partitioning) and appended.
A text that an earlier batch has brought keeps its first keeper; of equal texts that are new
together, the row with the largest ``doc_id`` stays.

A batch may be added again under its id, as a job does that failed after the append: digests
that it has brought itself are not known to it, so every result is as at the first time. One
writer at a time.

Cases: a null text counts as empty. A null ``doc_id`` is smaller than any other. Rows that
repeat as a whole keep exactly one row. An empty batch adds nothing. Columns beside
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm.common import settled, table
from diffspark.stage import materialise, stage_root

COLUMNS = "digest BINARY, keep_id BIGINT, batch STRING"
BUCKET_ROWS = 1 << 21  # digests of a bucket when the index begins
FEWEST, MOST = 8, 1 << 14  # buckets


class DigestIndex:
    """Index at ``path`` (default: a new one in the stage folder); opening a path again in
    another session goes on with what is there. The number of buckets is fixed by the first
    batch: as given (choose it for what is to come), or by the batch's size; the folder's name
    keeps it. Closing takes the table out of the catalog and leaves its files."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{stage_root(spark)}/diffspark/index-{uuid.uuid4().hex}"
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.wanted = buckets
        self.buckets: int | None = None
        found = self._found()
        if found is not None:
            if buckets not in (None, found):
                raise ValueError(f"the index has {found} buckets, not {buckets}")
            self._open(found)

    def _found(self) -> int | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return next((int(n.removeprefix("buckets-")) for n in names if n.startswith("buckets-")), None)

    def _open(self, buckets: int) -> None:
        self.buckets = buckets
        self.spark.sql(
            f"CREATE TABLE {self.name} ({COLUMNS}) USING parquet CLUSTERED BY (digest) "
            f"SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/buckets-{buckets}'"
        )

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def rows(self) -> DataFrame:
        if self.buckets is None:
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Append the new digests of ``docs``; return one row per row of ``docs``:
        doc_id, keep_id, group_size (copies in this batch), kept, text_sha256, known
        (another batch has brought the text), row. ``batch`` is the id to try again with."""
        batch = batch or uuid.uuid4().hex
        rows = materialise(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
                F.monotonically_increasing_id().alias("row"),
            )
        )
        groups = materialise(
            rows.groupBy("digest").agg(
                F.max("doc_id").alias("new_id"),
                F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("new_row"),
                F.count(F.lit(1)).alias("group_size"),
            )
        )
        if self.buckets is None:
            fit = 1 << max(0, groups.count() // BUCKET_ROWS).bit_length()
            self._open(self.wanted or min(MOST, max(FEWEST, fit)))
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        fresh.select("digest", F.col("new_id").alias("keep_id"), F.lit(batch).alias("batch")).write.insertInto(self.name)
        found = groups.join(self.rows().hint("merge"), "digest")
        # a digest seen once in this batch, and new, is its own keeper: only the others are joined
        known = F.col("batch") != batch
        several = materialise(
            found.select(
                "digest",
                "group_size",
                known.alias("known"),
                F.when(known, F.col("keep_id")).otherwise(F.col("new_id")).alias("keep_id"),
                F.when(~known, F.col("new_row")).alias("keep_row"),
            ).where(F.col("known") | (F.col("group_size") > 1))
        )
        out = rows.join(several, "digest", "left")
        single = F.col("group_size").isNull()
        return out.select(
            "doc_id",
            F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (single | F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            F.coalesce("known", F.lit(False)).alias("known"),
            "row",
        )


def keep_first(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns and no others; a key with many
    copies is one row on the side that is kept."""
    tag, key = "_exact_row", "_exact_digest"
    docs = settled(docs)
    tagged = docs.withColumn(tag, F.monotonically_increasing_id())
    kept = index.add(tagged.select("doc_id", "text")).where("kept").select(F.col("row").alias(key))
    return tagged.join(kept, F.col(tag) == F.col(key), "left_semi").drop(tag)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an index that starts empty."""
    with DigestIndex(spark) as index:
        return index.add(table(spark, sf_dir, "documents")).select(
            "doc_id", "keep_id", "group_size", "kept", "text_sha256"
        )


SQL = {
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
}
