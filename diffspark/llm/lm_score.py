"""Language-model scores from a sharded Elias-Fano n-gram trie.

Words are lower-cased (A-Z) runs of bytes other than white space; every text ends with one
end token and starts from a start context. The model interpolates pairs with single tokens, all
counts from the training documents:

    p1(w)     = (c(w) + 1) / (N + V + 1)
    p2(w | v) = c(v w) / (c(v) + PRIOR) + PRIOR / (c(v) + PRIOR) * p1(w)

1. Blocks of documents send their distinct tokens with counts to word shards, which add them up,
   answer each block with the totals, and give N, V and the few tokens of at least
   N / HOT occurrences.
2. Blocks send their distinct pairs to pair shards: by the context's hash; the pairs of a
   hot context go by both, and its total is already known. A shard adds the counts up, builds
   its trie (contexts, pointers, successor codes relative to the context, quantised shares and
   backoff weights, as monotone sequences in a mapped file) and answers every block by
   searching it.
3. Answers meet their block again, which adds up the documents' log probabilities.

The model is never in one place: what a task holds is a block of BLOCK_BYTES of text or one
shard, and the number of shards is that of the shuffle partitions. Counts are exact but for
tokens that share a 64-bit hash, and successors that share a 40-bit code in one context (a
context with n of them: about n**2 / 2**41). Quantising changes a probability by a factor of
at most 10**(1 / 8192).

Cases: null and empty texts are the end token alone. Very long texts are blocks of their own.
A null id counts as an empty one for the split. Repeated rows are counted and scored each. With no
training documents all counts are 0. An empty table gives no rows. Columns beside ``doc_id``
and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm import words
from diffspark.llm.common import parallelism, settled, ship, table
from diffspark.llm.elias_fano import SUCCESSOR_BITS, Trie, value
from diffspark.stage import materialise

ship(__name__)

U = np.uint64
BLOCK_BYTES = 1 << 24
PRIOR, HOT = 16.0, 4096
END, START = words.series(2, 99)
MESSAGE = "block long, shard int, keys binary, sizes binary, codes binary, counts binary"
NAMES = [c.split()[0] for c in MESSAGE.split(", ")]


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class Block:
    """Tokens of some documents: ``vocab`` sorted hashes, ``token`` their numbers in order,
    ``at`` where each document starts."""

    def __init__(self, ids: list, texts: list):
        self.ids, n = ids, len(ids)
        hashes, begin = words.hash_words(texts)
        self.at = begin + np.arange(n + 1)
        every = np.empty(len(hashes) + n, U)
        last = np.zeros(len(every), bool)
        last[self.at[1:] - 1] = True
        every[last], every[~last] = END, hashes
        self.vocab, token = np.unique(every, return_inverse=True)
        self.token = token.astype(np.int64)
        self.held = np.array([held_out(i) for i in ids], bool)
        self.train = np.repeat(~self.held, np.diff(self.at))

    def counts(self) -> np.ndarray:
        return np.bincount(self.token[self.train], minlength=len(self.vocab))

    def pairs(self, shards: int, hot: np.ndarray):
        """Distinct pairs in the order of (shard, context, code): shards, contexts, codes, training
        counts, and for every token the place of its pair."""
        k = len(self.vocab)
        before = np.concatenate([[k], self.token[:-1]])
        before[self.at[:-1]] = k
        pair, place = np.unique(before * (k + 1) + self.token, return_inverse=True)
        count = np.bincount(place[self.train], minlength=len(pair))
        context = np.append(self.vocab, START)[pair // (k + 1)]
        with np.errstate(over="ignore"):
            both = words.mix(context * U(3) + self.vocab[pair % (k + 1)])
        code = both >> U(64 - SUCCESSOR_BITS)
        owner = np.where(np.isin(context, hot), both, words.mix(context))
        shard = (owner % U(shards)).astype(np.int64)
        order = np.lexsort((code, context, shard))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return shard[order], context[order], code[order], count[order], back[place]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """Consecutive documents of a partition up to BLOCK_BYTES of text, by the first row's number."""
    ids, texts, first, size = [], [], None, 0
    for batch in batches:
        for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
            if ids and size + len(text or "") > BLOCK_BYTES:
                yield first, Block(ids, texts)
                ids, texts, first, size = [], [], None, 0
            first = row if first is None else first
            ids.append(doc)
            texts.append(text)
            size += len(text or "")
    if ids:
        yield first, Block(ids, texts)


def message(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(
        pd.DataFrame(rows, columns=NAMES), schema=pa.schema(list(zip(NAMES, KINDS, strict=True))), preserve_index=False
    )


KINDS = [pa.int64(), pa.int32(), *[pa.binary()] * 4]


def ask_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for first, block in blocks(batches):
        shard, counts = (block.vocab % U(shards)).astype(np.int64), block.counts().astype("<u8")
        yield message(
            [
                (first, s, block.vocab[m].tobytes(), b"", b"", counts[m].tobytes())
                for s in np.unique(shard)
                for m in (shard == s,)
            ]
        )


def joined(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def answer_words(f: pd.DataFrame) -> pd.DataFrame:
    """Totals for every block, and one row (block null) with the shard's totals, counts by key."""
    keys = joined(f["keys"], "<u8")
    vocab, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(vocab), "<u8")
    np.add.at(total, place, joined(f["counts"], "<u8"))
    ends = np.cumsum([len(k) // 8 for k in f["keys"]])
    shard = int(f["shard"].iloc[0])
    rows = [
        (b, shard, b"", b"", b"", total[place[e - len(k) // 8 : e]].tobytes())
        for b, k, e in zip(f["block"], f["keys"], ends, strict=True)
    ]
    most = np.argsort(total)[::-1][:HOT]
    sums = np.array([total.sum(), (total > 0).sum()], "<u8")
    rows.append((None, shard, vocab[most].tobytes(), sums.tobytes(), b"", total[most].tobytes()))
    return pd.DataFrame(rows, columns=NAMES).astype({"block": "Int64"})


def narrow(codes: np.ndarray) -> bytes:
    """40-bit codes in five bytes."""
    return np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def ask_pairs(batches: Iterator[pa.RecordBatch], shards: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for first, block in blocks(batches):
        shard, context, code, count, _ = block.pairs(shards, hot)
        cut = np.searchsorted(shard, np.arange(shards + 1))
        for s in range(shards):
            m = slice(cut[s], cut[s + 1])
            if cut[s] < cut[s + 1]:
                keys, sizes = np.unique(context[m], return_counts=True)
                yield message(
                    [(first, s, keys.tobytes(), sizes.astype("<u4").tobytes(), narrow(code[m]), count[m].astype("<u4").tobytes())]
                )


def build(f: pd.DataFrame, hot: dict[int, int]) -> Trie:
    """Trie of one shard from the messages of all blocks."""
    keys = joined(f["keys"], "<u8")
    contexts, owner = np.unique(keys, return_inverse=True)
    owner = np.repeat(owner, joined(f["sizes"], "<u4"))
    code, count = wide(b"".join(f["codes"])), joined(f["counts"], "<u4").astype(np.int64)
    seen = count > 0
    owner, code, count = owner[seen], code[seen], count[seen]
    order = np.lexsort((code, owner))
    owner, code, count = owner[order], code[order], count[order]
    new = np.ones(len(code), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    starts = np.flatnonzero(new)
    count = np.add.reduceat(count, starts) if len(starts) else count
    owner, code = owner[starts], code[starts]
    total = np.bincount(owner, count, minlength=len(contexts))
    for i in np.flatnonzero(np.isin(contexts, np.array(list(hot), U))):
        total[i] = hot[int(contexts[i])]  # this shard has a part of its successors only
    sizes = np.bincount(owner, minlength=len(contexts))
    return Trie.of(contexts, sizes, code, count / (total[owner] + PRIOR), PRIOR / (total + PRIOR))


def answer_pairs(f: pd.DataFrame, hot: dict[int, int]) -> pd.DataFrame:
    """Codes of shares and backoff weights for every block's pairs."""
    trie = build(f, hot).mapped()
    rows = []
    for b, s, keys, sizes, codes, _ in f[NAMES].itertuples(index=False):
        share, backoff = trie.look_up(np.frombuffer(keys, "<u8"), np.frombuffer(sizes, "<u4"), wide(codes))
        rows.append((b, s, b"", b"", share.tobytes(), backoff.tobytes()))
    return pd.DataFrame(rows, columns=NAMES)


def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as one row each: the tokens go to where the answers are."""
    for first, block in blocks(batches):
        narrow_tokens = block.token.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        ids = np.array([np.iinfo(np.int64).min if i is None else i for i in block.ids], "<i8")
        yield message([(first, 0, block.vocab.tobytes(), block.at.astype("<u8").tobytes(), narrow_tokens, ids.tobytes())])


def unpack_block(keys: bytes, sizes: bytes, codes: bytes, counts: bytes) -> Block:
    block = Block.__new__(Block)
    ids = np.frombuffer(counts, "<i8")
    block.ids = [None if i == np.iinfo(np.int64).min else int(i) for i in ids]
    block.vocab, block.at = np.frombuffer(keys, "<u8"), np.frombuffer(sizes, "<u8").astype(np.int64)
    block.token = np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    block.held = np.array([held_out(i) for i in block.ids], bool)
    block.train = np.repeat(~block.held, np.diff(block.at))
    return block


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def add_up(own: pd.DataFrame, answers: pd.DataFrame, shards: int, hot: np.ndarray, n: int, v: int) -> pd.DataFrame:
    """Scores of one block's documents from its tokens and all answers."""
    block = unpack_block(*own[NAMES[2:]].iloc[0])
    about_words = answers[answers["kind"] == 0].sort_values("shard")
    shard = (block.vocab % U(shards)).astype(np.int64)
    total = np.zeros(len(block.vocab))
    for s, counts in zip(about_words["shard"], about_words["counts"], strict=True):
        total[shard == s] = np.frombuffer(counts, "<u8")
    about_pairs = answers[answers["kind"] == 1].sort_values("shard")
    pair_shard, context, _, _, place = block.pairs(shards, hot)
    shares = joined(about_pairs["codes"], "<u2")
    backoffs = joined(about_pairs["counts"], "<u2")
    if len(shares) != len(context):
        raise ValueError("the answers are not for this block: the input changed between passes")
    # contexts were asked once per shard, in the order in which they change
    change = np.ones(len(context), bool)
    change[1:] = (context[1:] != context[:-1]) | (pair_shard[1:] != pair_shard[:-1])
    weight = np.where(backoffs == 0xFFFF, 1.0, value(backoffs))[np.cumsum(change) - 1]
    base = (total + 1.0) / (n + v + 1.0)
    p = value(shares)[place] + weight[place] * base[block.token]
    at = block.at[:-1]
    sums = lambda x: np.add.reduceat(x, at)  # noqa: E731  every document has a token
    return pd.DataFrame(
        {
            "doc_id": pd.array(block.ids, "Int64"),
            "held_out": block.held,
            "n_tokens": np.diff(block.at),
            "n_known": sums((total > 0)[block.token].astype(np.int64)),
            "train_tokens": n,
            "base_score": sums(np.log10(base)[block.token]),
            "score": sums(np.log10(p)),
        }
    )


def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (SCORES), all read whole; learned from those that are not
    held out."""
    spark = docs.sparkSession
    shards = parallelism(spark)
    rows = settled(docs).select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    word_answers = materialise(
        rows.mapInArrow(partial(ask_words, shards=shards), MESSAGE).groupBy("shard").applyInPandas(answer_words, MESSAGE)
    )
    # counts of single tokens: two numbers and HOT tokens of each shard, of which only hot ones come here
    n = v = 0
    sums = word_answers.where("block is null")
    for (raw,) in sums.select("sizes").toLocalIterator():
        tokens, types = np.frombuffer(raw, "<u8")
        n, v = n + int(tokens), v + int(types)
    hot: dict[int, int] = {}
    for keys, counts in sums.select("keys", "counts").toLocalIterator():
        for key, count in zip(np.frombuffer(keys, "<u8").tolist(), np.frombuffer(counts, "<u8").tolist(), strict=True):
            if count and count * HOT >= n:  # at most HOT tokens
                hot[key] = count
    names = np.array(sorted(hot), U)

    def answer(f: pd.DataFrame) -> pd.DataFrame:
        return answer_pairs(f, hot)

    def finish(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return add_up(block, answers, shards, names, n, v)

    pair_answers = materialise(
        rows.mapInArrow(partial(ask_pairs, shards=shards, hot=names), MESSAGE)
        .groupBy("shard")
        .applyInPandas(answer, MESSAGE)
    )
    answers = (
        word_answers.where("block is not null")
        .withColumn("kind", F.lit(0))
        .unionByName(pair_answers.withColumn("kind", F.lit(1)))
    )
    own = rows.mapInArrow(pack_blocks, MESSAGE)
    return (
        own.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(finish, SCORES)
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those with crc32(doc_id) mod 7 = 2 are held out."""
    return score(table(spark, sf_dir, "documents"))
