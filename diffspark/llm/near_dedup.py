"""Near-dedup of whole texts by MinHash.

1. Every text becomes the set of its hashed word shingles, with one minimum for each of
   BANDS * ROWS universal hash functions (two bytes of each are kept) and a digest of the
   set. Texts with one set form a class, and only one node of each class goes on.
2. Nodes that agree in a band share a bucket. In every bucket each node is compared with
   the smallest node: first the signatures, then the full sets. This needs as many pairs as
   there are nodes, however large a bucket is.
3. Links give components by alternating large-star and small-star. Buckets that still
   hold several components are compared in blocks of at most BLOCK nodes: pairs from
   different components whose signatures allow the similarity, in the first band that the
   two share, are confirmed on full sets, and a block hands on a spanning forest of its links,
   never all pairs.
4. Components of all links, and the smallest ``doc_id`` of each.

A pair of the required similarity is missed if it shares no band (with 32 bands of 5 at 0.85
this has probability 7.1e-9, at 0.8 3.04e-6), or if its signatures agree in a share more than
SLACK below the similarity (9.6e-10 and 1.4e-8). Together this is 8.0e-9 and 3.05e-6 at most.

Cases: null, empty and blank texts have the empty set, stand alone and are kept. A text of
fewer words than a shingle is one shingle. Rows that repeat are linked; ``doc_id`` may be
null (larger than any other). An empty table gives no rows. Columns beside ``doc_id`` and
``text`` are not read by ``near_duplicates`` and pass through ``keep_one`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm import words
from diffspark.llm.common import settled, ship, table
from diffspark.llm.components import components
from diffspark.stage import materialise

ship(__name__)

BANDS, ROWS, BLOCK = 32, 5, 512
FILTER_BITS = 24  # of the bitmap that tells which rows need their full sets
MULTIPLY = words.series(BANDS * ROWS, 11) | np.uint64(1)
ADD = words.series(BANDS * ROWS, 12)
SLACK = 0.19  # signatures this far below the similarity are still confirmed


def signature(shingles: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minima of all hash functions."""
    least = None
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 1024):
            x = np.multiply.outer(shingles[i : i + 1024], MULTIPLY)
            x += ADD
            m = x.min(axis=0)
            least = m if least is None else np.minimum(least, m)
    return (words.mix(least) & np.uint64(0xFFFF)).astype("<u2")


SKETCH = "row long, doc_id long, n_shingles long, set_digest binary, signature binary"


def sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes, begin = words.hash_words(part.column("text").to_pylist())
                n, digest, sig = [], [], []
                for i in range(part.num_rows):
                    s = words.shingles(hashes[begin[i] : begin[i + 1]], size)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.array(sig, pa.binary()),
                    ],
                    ["row", "doc_id", "n_shingles", "set_digest", "signature"],
                )

    return run


def bitmap(rows: DataFrame) -> np.ndarray:
    """Bitmap of the hashes of ``rows`` (node): of fixed size, whatever comes in."""
    slot = F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS))
    words64 = rows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits")
    )
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for word, bits in words64.collect():  # 2 ** (FILTER_BITS - 6) rows at most
        out[word] = bits
    return out


def full_sets(size: int, wanted: np.ndarray):
    """Shingle sets of the rows whose ``slot`` is in the bitmap (a few others pass too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(wanted[slot >> 6] >> (slot & 63) & 1)
            for at in range(0, len(hit), 256):
                part = batch.take(pa.array(hit[at : at + 256]))
                hashes, begin = words.hash_words(part.column("text").to_pylist())
                sets = [
                    words.shingles(hashes[i:j], size).tobytes()
                    for i, j in zip(begin[:-1], begin[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"]
                )

    return run


def alike(percent: int):
    """Pairs whose signatures allow the similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            one, two = (np.frombuffer(b"".join(f[c]), "<u2").reshape(len(f), -1) for c in ("sig_u", "sig_v"))
            yield f.loc[(one == two).mean(axis=1) >= percent / 100 - SLACK, ["u", "v"]]

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirm(percent: int):
    """Pairs with their sets to links."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [
                similar(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), percent)
                for a, b in zip(f["set_u"], f["set_v"], strict=True)
            ]
            yield f.loc[keep, ["u", "v"]]

    return run


def compare_blocks(percent: int):
    """One bucket's block or pair of blocks to a spanning forest of its links between
    components. Columns: band, side, node, component, signature, shingles."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates("node")
        band, node, side = int(f["band"].iloc[0]), f["node"].to_numpy(), f["side"].to_numpy()
        sig = np.frombuffer(b"".join(f["signature"]), "<u2").reshape(len(f), BANDS * ROWS)
        sets = [np.frombuffer(x, "<u8") for x in f["shingles"]]
        size = np.array([len(s) for s in sets])
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        group = f["component"].to_numpy()
        found, pairs = [], []
        two = len(set(side)) > 1
        for i in range(len(f)):
            if two and side[i]:
                continue
            others = np.flatnonzero(side == 1) if two else np.arange(i + 1, len(f))
            others = others[group[others] != group[i]]
            ratio = 100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])
            others = others[ratio]
            if not len(others):
                continue
            same = sig[others] == sig[i]
            agree = same.mean(axis=1)
            first = same.reshape(len(others), BANDS, ROWS).all(axis=2).argmax(axis=1)
            good = (agree >= percent / 100 - SLACK) & (first == band)
            pairs += [(-x, i, j) for x, j in zip(agree[good], others[good], strict=True)]
        for _, i, j in sorted(pairs):
            a, b = find(int(group[i])), find(int(group[j]))
            if a != b and similar(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
                found.append((node[i], node[j]))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def links(nodes: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (u, v) among nodes (node, signature) that give the same components as all
    pairs of the required similarity. ``texts``: (node, text) of these and other rows."""
    width = 2 * ROWS
    bands = nodes.select(
        "node",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(b).alias("band"), F.substring("signature", b * width + 1, width).alias("key"))
                    for b in range(BANDS)
                ]
            )
        ).alias("b"),
    ).select("node", F.col("b.band").alias("band"), F.xxhash64("b.band", "b.key").alias("bucket"))
    buckets = materialise(
        bands.groupBy("bucket")
        .agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members"))
        .where("members > 1")
    )
    members = materialise(bands.join(buckets, "bucket"))
    pairs = members.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    sig_u = nodes.select(F.col("node").alias("u"), F.col("signature").alias("sig_u"))
    sig_v = nodes.select(F.col("node").alias("v"), F.col("signature").alias("sig_v"))
    likely = materialise(
        pairs.join(sig_u, "u").join(sig_v, "v").mapInPandas(alike(percent), "u long, v long")
    )
    wanted = bitmap(members.select("node").distinct())
    slots = texts.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS)))
    sets = materialise(slots.mapInArrow(full_sets(size, wanted), "node long, shingles binary"))
    set_u = sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u"))
    set_v = sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v"))
    star = materialise(
        likely.join(set_u, "u").join(set_v, "v").mapInPandas(confirm(percent), "u long, v long")
    )
    known = components(star)
    labelled = materialise(
        members.drop("hub")
        .join(known, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    open_buckets = (
        labelled.groupBy("bucket")
        .agg(F.min("component").alias("a"), F.max("component").alias("b"))
        .where("a <> b")
        .select("bucket")
    )
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.col("own")
    dealt = (
        labelled.join(open_buckets, "bucket")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "bucket",
            F.least(own, "other").alias("i"),
            F.greatest(own, "other").alias("j"),
            F.when(own > F.col("other"), 1).otherwise(0).alias("side"),
            "band",
            "node",
            "component",
        )
    )
    rest = (
        dealt.join(nodes.join(sets, "node"), "node")
        .groupBy("bucket", "i", "j")
        .applyInPandas(compare_blocks(percent), "u long, v long")
    )
    return star.union(materialise(rest))


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_shingles, component_id, first (this row
    is the one that stays)."""
    docs = settled(docs)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    sketches = materialise(rows.mapInArrow(sketch(size), SKETCH))
    classes = sketches.where("n_shingles > 0").groupBy("set_digest").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least")
    )
    classes = materialise(classes)
    nodes = classes.select("node").join(
        sketches.select(F.col("row").alias("node"), "signature"), "node"
    )
    texts = rows.select(F.col("row").alias("node"), "text")
    found = components(links(materialise(nodes), texts, percent, size))
    grouped = materialise(
        classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(grouped.join(least, "component").select("set_digest", "component", "component_id"))
    out = materialise(
        sketches.select("row", "doc_id", "n_shingles", "set_digest").join(named, "set_digest", "left")
    )
    own = F.col("component").isNull()
    firsts = (
        out.where(~own & F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component")
        .agg(F.min("row").alias("first_row"))
    )
    return out.join(firsts, "component", "left").select(
        "row",
        "doc_id",
        "n_shingles",
        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (own | (F.col("row") == F.col("first_row"))).alias("first"),
    )


def keep_one(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row of each component, with the columns of ``docs`` and no others."""
    tag, key = "_near_row", "_near_first"
    docs = settled(docs)
    kept = near_duplicates(docs, percent, size).where("first").select(F.col("row").alias(key))
    tagged = docs.withColumn(tag, F.monotonically_increasing_id())
    return tagged.join(kept, F.col(tag) == F.col(key), "left_semi").drop(tag)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, five-word shingles, similarity of 0.85 or more."""
    out = near_duplicates(table(spark, sf_dir, "documents"), percent=85, size=5)
    return out.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
