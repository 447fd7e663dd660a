"""Quality classifier by importance resampling.

Every text is a bag of hashed n-grams: words, pairs of neighbouring words (a word that
repeats the one before counts as a repeat, whatever it is), word shapes and pairs of shapes.
Two generative models over the BUCKETS features are counted, one over all documents (raw)
and one over documents labelled good (target). A document's log weight is the sum over its
features of log(target / raw). Gumbel noise, drawn from the row's key, is added and the k
largest stay: a sample without replacement in proportion to the weights. k is the number
of documents whose weight passes a threshold fitted on labelled documents that the target
model has not seen.

All documents are counted, weighted and ranked. Labels are used up to SAMPLE rows, those
with the smallest hash of the id; this bounds the broadcast and what the driver fits, as rows that
share a labelled id give the threshold one weight, the least of theirs.

Cases: null and empty texts have no features and weight 0. Repeated rows are weighted and
sampled on their own (draws of equal ids and texts are equal; ties go to the earlier row).
Labels with a null id or quality are left out; a document with several labels counts
as bad if one of them says so. Without good or without bad labels everything stays. An empty
table gives no rows. Columns beside ``doc_id`` and ``text`` pass through ``keep_good``
unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm import words
from diffspark.llm.common import settled, ship, table
from diffspark.stage import materialise

ship(__name__)

BUCKETS = 1 << 14
SAMPLE = 20_000
SMOOTH = 64.0 * BUCKETS  # counts that the target model takes from the raw one, against few labels
BINS = 1024
KEEP_COST = 4.0  # a good document rejected weighs as much as so many bad ones kept

#: Letters and digits become one class byte each; other signs stand for themselves.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = 65, 97, 48, 97
RUN = np.zeros(256, bool)
RUN[[65, 97, 48]] = True


def shapes(raw: np.ndarray) -> np.ndarray:
    """Hash of every word's shape: letters and digits by class, runs of a class once."""
    kind = CLASS[raw]
    again = np.zeros(len(kind), bool)
    again[1:] = (kind[1:] == kind[:-1]) & RUN[kind[1:]]
    return words.hash_runs(kind[~again])[0]


def _pairs(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        second = np.where(x[1:] == x[:-1], np.uint64(seed), x[1:])
        first = np.where(x[1:] == x[:-1], np.uint64(0), x[:-1])
        return words.mix(first * np.uint64(3) + second + np.uint64(seed))


def features(texts: list) -> Iterator[np.ndarray]:
    """Bucket numbers of every text's n-grams."""
    raw, at = words.buffer(texts)
    word, start = words.hash_runs(raw)
    shape = shapes(raw)
    begin = np.searchsorted(start, at)
    mask = np.uint64(BUCKETS - 1)
    for i, j in zip(begin[:-1], begin[1:], strict=True):
        w, s = word[i:j], shape[i:j]
        whole = np.concatenate([w, _pairs(w, 5), words.mix(s + np.uint64(7)), _pairs(s, 9)])
        yield (whole & mask).astype(np.int64)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition's features over all documents and over those marked good."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            marked = part.column("good").to_pylist()
            for found, good in zip(features(part.column("text").to_pylist()), marked, strict=True):
                n = np.bincount(found, minlength=BUCKETS)
                raw += n
                if good:
                    target += n
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"]
    )


def weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(features(part.column("text").to_pylist()))
                weight = [float(ratio[f].sum()) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        part.column("verdict"),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array(weight, pa.float64()),
                    ],
                    ["row", "doc_id", "verdict", "n_features", "log_weight"],
                )

    return run


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """Weight that separates labelled good from bad documents at the least cost; the middle of
    the gap in which it may lie."""
    both = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[both[0] - 1.0], (both[1:] + both[:-1]) / 2])
    rejected = np.searchsorted(np.sort(good), cuts, "left")
    kept = len(bad) - np.searchsorted(np.sort(bad), cuts, "left")
    return float(cuts[np.argmin(KEEP_COST * rejected / len(good) + kept / len(bad))])


def cutoff(keys: DataFrame, k: int) -> tuple[float, int]:
    """The k-th largest ``key``, and how many rows with just that key belong to the top k.
    Each round counts the range that still holds it in BINS bins; at most BINS rows
    come to the driver."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0  # rows over the range
    while low < high:
        width = (high - low) / BINS
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        slot = F.least(F.lit(BINS - 1), F.floor((F.col("key") - low) / width).cast("int"))
        bins = (
            inside.groupBy(slot.alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
            .collect()
        )
        for b in sorted(bins, reverse=True):
            if above + b["n"] >= k:
                low, high = b["low"], b["high"]
                break
            above += b["n"]
    return low, k - above


def nth_row(rows: DataFrame, n: int) -> int:
    """The n-th smallest ``row`` (from 1), found as in :func:`cutoff`: however many rows there
    are, none of them is gathered."""
    low, high = rows.agg(F.min("row"), F.max("row")).first()
    while low < high:
        width = (high - low) // BINS + 1
        inside = rows.where(F.col("row").between(low, high))
        bins = (
            inside.groupBy(F.expr(f"(row - {low}L) div {width}L").alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low"), F.max("row").alias("high"))
            .collect()  # BINS rows at most
        )
        for b in sorted(bins):
            if n <= b["n"]:
                low, high = b["low"], b["high"]
                break
            n -= b["n"]
    return low


def judged_weights(keyed: DataFrame) -> DataFrame:
    """(verdict, log_weight) of the labelled ids, one row each: the least weight of an id's rows."""
    one = keyed.where("verdict is not null").groupBy("doc_id", "verdict")
    return one.agg(F.min("log_weight").alias("log_weight")).select("verdict", "log_weight")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_features, log_weight, key, kept."""
    draw = F.xxhash64("doc_id")
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.min("quality") > 0).alias("good"))
        .orderBy(draw, "doc_id")
        .limit(SAMPLE)
        .select("doc_id", "good", (F.pmod(draw, F.lit(2)) == 0).alias("fits"))
    )
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    ).join(F.broadcast(materialise(sample)), "doc_id", "left")  # SAMPLE rows at most
    counts = (
        rows.select("text", (F.col("good") & F.col("fits")).alias("good"))
        .mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw"), F.sum("target"))
        .collect()  # BUCKETS rows at most
    )
    raw, target = np.ones(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in counts:
        raw[b] += r
        target[b] += t
    share = raw / raw.sum()
    ratio = np.log((target + SMOOTH * share) / (target.sum() + SMOOTH)) - np.log(share)
    seen = sum(t for _, _, t in counts)
    held = F.when(~F.col("fits"), F.col("good"))
    weighed = materialise(
        rows.select("row", "doc_id", "text", held.alias("verdict")).mapInArrow(
            weigh(ratio if seen else np.zeros(BUCKETS)),
            "row long, doc_id long, verdict boolean, n_features long, log_weight double",
        )
    )
    noise = -F.log(-F.log((F.pmod(F.xxhash64("doc_id", F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)))
    keyed = materialise(weighed.withColumn("key", F.col("log_weight") + F.coalesce(noise, F.lit(0.0))))
    judged = judged_weights(keyed).collect()  # SAMPLE rows at most
    good = np.array([w for v, w in judged if v])
    bad = np.array([w for v, w in judged if not v])
    out = keyed.drop("verdict")
    if not seen or not len(good) or not len(bad):
        return out.withColumn("kept", F.lit(True))
    k = keyed.where(F.col("log_weight") >= threshold(good, bad)).count()
    if k == 0:
        return out.withColumn("kept", F.lit(False))
    least, ties = cutoff(keyed.select("key"), k)
    tied = nth_row(keyed.where(F.col("key") == least).select("row"), ties)
    return out.withColumn(
        "kept", (F.col("key") > least) | ((F.col("key") == least) & (F.col("row") <= tied))
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are sampled, with their columns and no others."""
    tag, key = "_quality_row", "_quality_kept"
    docs = settled(docs)
    kept = scores(docs, labels).where("kept").select(F.col("row").alias(key))
    tagged = docs.withColumn(tag, F.monotonically_increasing_id())
    return tagged.join(kept, F.col(tag) == F.col(key), "left_semi").drop(tag)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weight and whether they stay."""
    out = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_features", "log_weight", "kept")
