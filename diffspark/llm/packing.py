"""Packing of tokenised documents in windows by minimum bin slack.

A document's ids (its tokens and a closing id) are cut in pieces of a full window and a
rest. What must be packed is then a histogram of at most ``window`` lengths, however many
documents there are. The plan is made on the histogram: a window takes the longest
remaining length, a subset-sum over the remaining lengths (a bitset of reachable sums after
each length) finds the fill closest to the free space, and walking the bitsets back gives
how many pieces of each length it takes. As long as the counts allow it the same choice is
the best one again, so a plan is a list of few patterns, each with how often it is used.

Pieces are numbered within their length (locally per input partition, plus offsets from
the counts per partition and length); a piece's number and length give its sequence and
offset by looking up the plan. Nothing but the histogram reaches the driver, and no group
of pieces is gathered.

Cases: a null text is empty, and an empty text is the closing id alone. Very long texts are
cut in as many pieces as needed. Repeated rows are packed each on its own; null ids are kept.
An empty table gives no rows. Columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.llm import byte_bpe
from diffspark.llm.common import ship, table
from diffspark.stage import materialise

ship(__name__)

WINDOW, END = 2048, 1
PIECE = "part int, doc_id long, start long, length int, nth long, ids_crc32 long, doc_tokens long, ids array<int>"


def cut(batches: Iterator[pa.RecordBatch], path: str, window: int, end: int, with_ids: bool):
    """Documents to pieces, numbered by length within the partition."""
    part, numbers = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            cols = defaultdict(list)
            slice_ = batch.slice(at, 256)
            for doc, text in zip(*(slice_.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                ids = np.append(byte_bpe.ids(text, path), np.uint32(end)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    cols["doc_id"].append(doc)
                    cols["start"].append(start)
                    cols["length"].append(len(piece))
                    cols["nth"].append(numbers[len(piece)])
                    cols["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                    cols["doc_tokens"].append(len(ids))
                    cols["ids"].append(piece.astype(np.int32) if with_ids else None)
                    numbers[len(piece)] += 1
            kinds = {"length": pa.int32(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(cols["doc_id"]), pa.int32())]
                + [pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()],
                ["part", *cols],
            )


def fill(counts: dict[int, int], free: int) -> dict[int, int]:
    """Lengths and how many of each: the fill of ``free`` with least slack."""
    reach, states = 1, []
    full = (1 << (free + 1)) - 1
    for length in sorted((n for n, c in counts.items() if c and n <= free), reverse=True):
        states.append((length, reach))
        left, step = min(counts[length], free // length), 1
        while left:  # copies in powers of two reach every number of copies
            use = min(step, left)
            reach |= (reach << (use * length)) & full
            left, step = left - use, step * 2
        if reach >> free & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, before in reversed(states):
        n = 0
        while not before >> at & 1:
            at, n = at - length, n + 1
        if n:
            taken[length] = n
    return taken


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times used, lengths with their number) that use up the histogram."""
    counts, patterns = dict(histogram), []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        taken = fill(counts, window - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in taken.items())
        for n, k in taken.items():
            counts[n] -= k * times
        counts = {n: c for n, c in counts.items() if c}
        patterns.append((times, taken))
    return patterns


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length, rows (first number, pieces a sequence, first sequence, offset)."""
    used, rows, sequence = defaultdict(int), defaultdict(list), 0
    for times, taken in patterns:
        offset = 0
        for length in sorted(taken, reverse=True):
            k = taken[length]
            rows[length].append((used[length], k, sequence, offset))
            used[length] += k * times
            offset += k * length
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def put(batches: Iterator[pa.RecordBatch], where: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Numbered pieces to their sequence and offset."""
    for batch in batches:
        length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            rows = where[int(n)]
            row = rows[np.searchsorted(rows[:, 0], number[at], "right") - 1]
            inside = number[at] - row[:, 0]
            sequence[at] = row[:, 2] + inside // row[:, 1]
            offset[at] = row[:, 3] + inside % row[:, 1] * n
        names = [c for c in batch.schema.names if c not in ("part", "number")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
            [*names, "sequence_id", "offset"],
        )


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (null unless
    asked for), sequence_id, offset. ``path``: tokenizer file on every machine."""
    cutter = partial(cut, path=path, window=window, end=end, with_ids=with_ids)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialise(rows.mapInArrow(cutter, PIECE))
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = counts.groupBy("length").agg(F.sum("n")).collect()  # ``window`` rows at most
    where = places(plan({r[0]: r[1] for r in histogram}, window))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(offsets, ["part", "length"]).select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        "ids",
        (F.col("base") + F.col("nth")).alias("number"),
    )
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>, sequence_id long, offset long"
    return numbered.mapInArrow(partial(put, where=where), schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids."""
    path = public_tokenizers.path(byte_bpe.FILE)
    return pack(table(spark, sf_dir, "documents"), path).drop("ids")
