"""Token counts that follow edits.

A document is kept as its pre-tokens, in leaves of LEAF, under a segment tree of sums of
characters and tokens. An edit is located by descending the sums. What must be read again
starts at the last pre-token before the edit that has a sign other than white space and LOOK
signs before the edit (what comes before it can't depend on the edit: the pattern never
looks back, and ahead only to the next sign or over a contraction), and ends where a new boundary falls on an old one behind the edit. Only these
pre-tokens are counted again; the leaves they are in get new sums, with the paths to the root.

:func:`plant` writes the trees down and :func:`edit` applies a table of edits to them, batch after
batch: leaves that no edit touches keep their stored sums.

Counts are those of the byte-level vocabulary with special tokens taken as ordinary text.

Cases: null and empty texts have no tokens and can be edited from empty. Edits beyond the
end are cut to the text. Very long texts have deeper trees. Repeated rows are counted each;
null ids are kept. An empty table gives no rows. Columns beside ``doc_id`` and ``text`` are
not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm import byte_bpe
from diffspark.llm.common import ship, table

ship(__name__)

LEAF, CACHE = 64, 500_000
LOOK = 2  # signs after its own start that the pattern may need for a contraction
PIECE = regex.compile(public_tokenizers.PATTERN)
#: What the registered query takes out: mail addresses, and numbers and keys of eight or more
#: signs with a digit among them.
PRIVATE = regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b(?=\w*\d)[\w.-]{8,}\b")
MARK = "[removed]"


class Counts(dict):
    """Number of tokens of a pre-token; emptied when it holds CACHE entries."""

    def __init__(self, path: str):
        super().__init__()
        self.encoding = byte_bpe.encoding(path)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(path)


class TokenTree:
    def __init__(self, text: str | None, count: Counts):
        self.count, self.counted = count, 0
        pieces = PIECE.findall(text or "")
        self._plant([pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]])
        for i in range(len(self.leaves)):
            self._sum(i)
        self._sums_up()

    def _plant(self, leaves: list[list[str]]) -> None:
        self.leaves = leaves
        self.width = 1 << (len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)

    def _sums_up(self) -> None:
        for i in range(self.width - 1, 0, -1):
            self._up(i)

    @classmethod
    def stored(cls, pieces: list[str], sizes: list[int], tokens: list[int], count: Counts) -> TokenTree:
        """The tree of leaves that :meth:`store` has given: nothing is counted again."""
        tree = cls.__new__(cls)
        tree.count, tree.counted = count, 0
        ends = list(accumulate(sizes, initial=0))
        tree._plant([pieces[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        for i, (leaf, n) in enumerate(zip(tree.leaves, tokens, strict=True)):
            tree.chars[tree.width + i] = sum(map(len, leaf))
            tree.tokens[tree.width + i] = n
        tree._sums_up()
        return tree

    def store(self) -> tuple[list[str], list[int], list[int]]:
        """Pre-tokens, and per leaf how many it has and their tokens. Leaves that edits have emptied
        are left out, overgrown ones are parted."""
        pieces, sizes, tokens = [], [], []
        for i, leaf in enumerate(self.leaves):
            pieces += leaf
            if len(leaf) <= 2 * LEAF:
                if leaf:
                    sizes.append(len(leaf))
                    tokens.append(self.tokens[self.width + i])
                continue
            for at in range(0, len(leaf), LEAF):
                part = leaf[at : at + LEAF]
                sizes.append(len(part))
                tokens.append(sum(map(self.count.__getitem__, part)))
        return pieces, sizes or [0], tokens or [0]

    def _sum(self, leaf: int) -> None:
        pieces = self.leaves[leaf]
        self.chars[self.width + leaf] = sum(map(len, pieces))
        self.tokens[self.width + leaf] = sum(map(self.count.__getitem__, pieces))

    def _up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _refresh(self, leaf: int) -> None:
        self._sum(leaf)
        i = (self.width + leaf) >> 1
        while i:
            self._up(i)
            i >>= 1

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _locate(self, at: int) -> tuple[int, int]:
        """Leaf that holds the character, and where the leaf starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def edit(self, start: int, length: int, new: str) -> None:
        """Replace ``length`` characters from ``start`` on by ``new``."""
        start = min(max(start, 0), self.chars[1])
        end = min(start + max(length, 0), self.chars[1])
        first, offset = self._locate(max(start - 1, 0))
        # the last pre-token that ends before the edit and is not only white space
        keep = None
        while keep is None:
            ends = list(accumulate(map(len, self.leaves[first]), initial=offset))
            for k in range(bisect_right(ends, start) - 2, -1, -1):
                if ends[k] + LOOK <= start and not self.leaves[first][k].isspace():
                    keep = k
                    break
            else:
                if first == 0:
                    keep = 0
                else:
                    first -= 1
                    offset -= self.chars[self.width + first]
        begin = ends[keep]
        last, reach = first, offset + self.chars[self.width + first]
        step = 1
        while True:  # more leaves to the right until a new boundary is an old one
            while last + 1 < len(self.leaves) and (reach <= end or step):
                last += 1
                reach += self.chars[self.width + last]
                step -= step > 0
            old = self.leaves[first][keep:] + [p for leaf in self.leaves[first + 1 : last + 1] for p in leaf]
            done = self._again(old, begin, start, end, new, last + 1 == len(self.leaves))
            if done:
                break
            step = last - first + 1
        fresh, behind = done
        self.counted += len(fresh)
        rest = old[behind:]
        tail = self.leaves[last][max(0, len(self.leaves[last]) - len(rest)) :] if last > first else rest
        middle = rest[: len(rest) - len(tail)]
        self.leaves[first] = self.leaves[first][:keep] + fresh + middle + (tail if last == first else [])
        for i in range(first + 1, last):
            self.leaves[i] = []
        if last > first:
            self.leaves[last] = tail
        for i in range(first, last + 1):
            self._refresh(i)

    def _again(self, old: list[str], begin: int, start: int, end: int, new: str, whole: bool):
        """New pre-tokens, and how many old ones they stand for; None if more text is needed."""
        text = "".join(old)
        changed = text[: start - begin] + new + text[end - begin :]
        shift = len(new) - (end - start)
        bounds = {b: i for i, b in enumerate(accumulate(map(len, old), initial=begin))}
        at, fresh = 0, []
        while True:
            behind = begin + at - shift
            if at >= start - begin + len(new) and behind in bounds and (behind > start or end > start or new):
                return fresh, bounds[behind]
            if at == len(changed):
                return (fresh, len(old)) if whole else None
            piece = PIECE.match(changed, at)
            if not whole and piece.end() == len(changed):
                return None
            fresh.append(piece.group())
            at = piece.end()


def follow(docs: DataFrame, edits, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_edits, n_tokens_edited, n_recounted (pre-tokens
    that were counted again). ``edits``: from a text to its edits (start, length, new), each
    relative to the text that the ones before it have left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text in part.column("text").to_pylist():
                    tree = TokenTree(text, counts(path))
                    before, n = tree.total, 0
                    for start, length, new in edits(text or ""):
                        tree.edit(start, length, new)
                        n += 1
                    rows.append((before, n, tree.total, tree.counted))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))],
                    ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_recounted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_recounted long"
    return rows.mapInArrow(run, schema)


TREES = (
    "row long, doc_id long, pieces array<string>, sizes array<int>, tokens array<int>, n_tokens long, "
    "n_edits long, n_recounted long"
)


def _kept(ids: list, trees: list[tuple[TokenTree, int]]) -> pa.RecordBatch:
    columns = [*ids, *([] for _ in range(6))]
    for tree, n in trees:
        for column, value in zip(columns[2:], (*tree.store(), tree.total, n, tree.counted), strict=True):
            column.append(value)
    kinds = (
        pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()),
        pa.int64(), pa.int64(), pa.int64(),
    )
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in TREES.split(", ")])


def _ids(part: pa.RecordBatch) -> list:
    return [part.column(c).to_pylist() for c in ("row", "doc_id")]


def plant(docs: DataFrame, path: str) -> DataFrame:
    """The trees of all documents as a table, one row per row of ``docs``: row, doc_id, the
    pre-tokens, their numbers and tokens by leaf, n_tokens, n_edits and n_recounted (0). Write it down:
    :func:`edit` goes on from it without reading or counting a text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _kept(_ids(part), [(TokenTree(t, counts(path)), 0) for t in part.column("text").to_pylist()])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    return rows.mapInArrow(run, TREES)


def edit(trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The table of trees after ``edits`` (doc_id, seq, start, length, new), which a document takes
    in the order of ``seq``, each relative to the text that the ones before have left; with the number
    of its edits and of pre-tokens counted again. Rows with one doc_id take the same edits, edits of
    other ids and of the null id have no effect. A document's edits follow each other in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("pieces", "sizes", "tokens", "edits")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, done = batch.slice(at, 256), []
                for *leaves, todo in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                    tree = TokenTree.stored(*leaves, counts(path))
                    for e in todo or []:
                        tree.edit(e["start"] or 0, e["length"] or 0, e["new"] or "")
                    done.append((tree, len(todo or [])))
                yield _kept(_ids(part), done)

    step = F.struct("seq", *[F.col(c).cast("long").alias(c) for c in ("start", "length")], "new")
    lists = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.sort_array(F.collect_list(step)).alias("edits")
    )
    columns = ("row", "doc_id", "pieces", "sizes", "tokens")
    return trees.select(*columns).join(lists, "doc_id", "left").mapInArrow(run, TREES)


def removals(text: str) -> Iterable[tuple[int, int, str]]:
    """Edits that put MARK for everything PRIVATE, from the end to the start."""
    return [(m.start(), m.end() - m.start(), MARK) for m in reversed(list(PRIVATE.finditer(text)))]


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents before and after personal data and keys are taken out."""
    return follow(table(spark, sf_dir, "documents"), removals, public_tokenizers.path(byte_bpe.FILE))
