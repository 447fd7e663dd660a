"""BPE encoding and decoding with word ends, by segment trees over pair ranks.

A text is cut at the special tokens, the rest at white space; every chunk is normalised
(NFC, lower case), split into words by the vocabulary's pattern, and every word becomes byte
signs of which the last carries the word end. A word's symbols are the leaves of a segment tree: a
leaf holds the rank of the merge of its symbol with the next one, an inner node the least of its
two children. The root is therefore the leftmost merge of lowest rank; after it is done, the
leaf, the one before and the one that vanished are set anew, with their paths to the root.
This goes on until no pair can be merged. Many words of one size run at once as rows of a
numpy array.

Chunks repeat, so their ids and tokens are kept in a dictionary of at most CACHE entries per
worker. Texts are whole; nothing is shuffled.

Cases: null and empty texts give no ids, empty strings when decoded. Very long texts are
encoded piece by piece; a word of n symbols needs n log n steps. Repeated rows and null ids are
kept. An empty table gives no rows. Columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm.byte_bpe import signs
from diffspark.llm.common import ship, table

ship(__name__)

FILE = "word_bpe_49k.json"
CACHE = 300_000
CELLS = 1 << 21  # leaves that are worked on at once
NONE = np.int64(1) << 62
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode white space
SPLIT_BLANK = re.compile(f"[{BLANK}]+")
CONTROL = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the pattern


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:  # a local file of the installed package
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern.replace(r"\s", BLANK))
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.token = {i: t for t, i in (vocab | self.special).items()}
        sign = {b: s for s, b in signs().items()}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[sign[b] + end] for b in range(256)], np.int64)
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        pair = np.array([a << 20 | b for a, b, _ in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank = pair[order], order
        self.made = np.array([c for _, _, c in merges], np.int64)
        self.cache: dict[str, tuple[int, str, str]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is no merge. A missing neighbour is -1."""
        key = np.where((left < 0) | (right < 0), -1, left << 20 | right)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NONE)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, filled up with -1, to rows in which merged ones are -1 too. The
        width is a power of two."""
        rows, width = symbols.shape
        sym = np.concatenate([symbols, np.full((rows, 1), -1)], axis=1)
        places = np.arange(width)
        # the last entry of a row stands for "no neighbour"
        after = np.tile(np.append(places + 1, width), (rows, 1))
        before = np.tile(np.append(places - 1, width), (rows, 1))
        before[:, 0] = width
        tree = np.full((rows, 2 * width), NONE)
        rank = self.ranks(sym[:, :width], sym[:, 1:])
        tree[:, width:] = np.where(rank < NONE, rank * width + places, NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(
                tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2]
            )
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            top = tree[live, 1]
            at = top % width
            gone = after[live, at]
            following, previous = after[live, gone], before[live, at]
            made = self.made[top // width]
            sym[live, at], sym[live, gone] = made, -1
            after[live, at], before[live, following] = following, at
            ranks = self.ranks(
                np.concatenate([made, sym[live, previous]]), np.concatenate([sym[live, following], made])
            )
            where = np.concatenate([at, previous, gone])
            row = np.tile(live, 3)
            value = np.full(len(where), NONE)
            value[: len(ranks)] = np.where(ranks < NONE, ranks * width + where[: len(ranks)], NONE)
            real = where < width
            row, place = row[real], where[real] + width
            tree[row, place] = value[real]
            while place[0] > 1:
                place = place >> 1
                tree[row, place] = np.minimum(tree[row, 2 * place], tree[row, 2 * place + 1])
            live = live[tree[live, 1] < NONE]
        return sym[:, :width]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of normalised words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[list[int]] = [[]] * len(raw)
        width = np.array([1 << max(2, (len(r) - 1).bit_length()) for r in raw], np.int64)
        for w in np.unique(width):
            which = np.flatnonzero(width == w)
            step = max(1, CELLS // int(w))
            for i in range(0, len(which), step):
                part = which[i : i + step]
                sym = np.full((len(part), int(w)), -1, np.int64)
                size = np.array([len(raw[k]) for k in part])
                flat = np.frombuffer(b"".join(raw[k] for k in part), np.uint8)
                first = np.cumsum(size) - size
                sym[np.repeat(np.arange(len(part)), size), np.arange(len(flat)) - np.repeat(first, size)] = (
                    self.inner[flat]
                )
                sym[np.arange(len(part)), size - 1] = self.last[flat[first + size - 1]]
                sym = self.merge(sym)
                left = sym >= 0
                ids, ends = sym[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
                for k, a, b in zip(part, [0, *ends], ends, strict=False):
                    out[k] = ids[a:b]
        return out

    def chunks(self, text: str) -> list[str]:
        """Special tokens and white-space separated chunks in order."""
        split = SPLIT_BLANK.split if CONTROL.search(text) else str.split
        if "<|" not in text:
            return [c for c in split(text) if c]
        return [
            c
            for part in self.cut.split(text)
            for c in ([part] if part in self.special else split(part))
            if c
        ]

    def learn(self, chunks: set[str]) -> None:
        """Put chunks in the dictionary: number of ids, ids and tokens as text."""
        # capital sigma is lowered by itself: only str.lower knows a final form
        lower = lambda c: "σ".join(x.lower() for x in unicodedata.normalize("NFC", c).split("Σ"))
        words = {c: self.word.findall(lower(c)) for c in chunks if c not in self.special}
        distinct = sorted({w for ws in words.values() for w in ws})
        ids = dict(zip(distinct, self.encode_words(distinct), strict=True))
        for c in chunks:
            own = [self.special[c]] if c in self.special else [i for w in words[c] for i in ids[w]]
            self.cache[c] = (len(own), " ".join(map(str, own)), self.decode(own))

    def decode(self, ids: list[int]) -> str:
        """The tokens with a space between them: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))

    def encode(self, texts: list) -> Iterator[tuple[int, str, str]]:
        """Number of ids, ids in decimal and decoded text of every text."""
        cut = [self.chunks(t or "") for t in texts]
        new = {c for chunks in cut for c in chunks} - self.cache.keys()
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = {c for chunks in cut for c in chunks}
        self.learn(new)
        found = self.cache.__getitem__
        for chunks in cut:
            if not chunks:
                yield 0, "", ""
                continue
            n, ids, tokens = zip(*map(found, chunks), strict=True)
            yield sum(n), " ".join(ids), " ".join(tokens)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, ids (array), decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = list(vocabulary(path).encode(part.column("text").to_pylist()))
                ids = [[int(i) for i in r[1].split()] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([r[2] for r in rows])],
                    ["doc_id", "ids", "decoded"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [(n, sha(ids), sha(text)) for n, ids, text in vocabulary(path).encode(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows]),
                    pa.array([r[2] for r in rows]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(partial(digest, path=path), schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents, encoded and decoded."""
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(FILE))
