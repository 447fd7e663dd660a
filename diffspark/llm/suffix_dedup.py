"""Repeated byte strings of a corpus by prefix-free parsing.

Every byte that lies in a string of LENGTH bytes with an earlier occurrence is removed. Of two
occurrences the one in the smaller document, or at the smaller start, is earlier; strings do
not cross documents and are judged on the input.

1. *Parsing.* A rolling hash over W bytes triggers a phrase start at the smallest hash (the last
   of equal ones) among every SPAN successive positions. A string of LENGTH bytes always holds the trigger
   that is chosen by its own first SPAN positions: its anchor. So strings are equal only if
   they have the same offset to their anchor and the same bytes from there on. Strings with one anchor start in
   one run of positions.
2. *Dictionary.* The entry of an anchor names the bytes that follow it in all of its strings
   (LENGTH - SPAN + 1 of them). Entries that occur once in the corpus hold no repeated string and leave:
   of text without repeats nothing else is shuffled.
3. *Parse.* The context of an anchor is the union of its strings. Contexts that agree are one
   suffix of the parse: all but the first of them are removed as a whole. An entry with one
   context is settled.
4. *Combination.* Only the first anchor of each context of an entry with several contexts
   still has to place its strings. It hands on the bytes of its context; steps 2 and 3 are
   repeated for blocks of BLOCK strings, and then one by one: equal ones meet, the first stays.

Suffixes are named by two 64-bit hashes of their first bytes instead of being ranked: of the order of
all suffixes, only which neighbours agree in LENGTH bytes is used, and ranks would need
the sorted strings themselves (LENGTH bytes for each byte). A document's own repeats are settled
where it is parsed. Hot entries and contexts are reduced on the map side or joined with skew
splitting; no list is longer than a document.

Cases: null and empty texts have no bytes and lose none. A null ``doc_id`` comes before all
others; rows with equal ids have some fixed order. Of rows that repeat all but one are later
occurrences. Texts shorter than LENGTH lose nothing. An empty table gives no rows. What
is left may end inside a character; it is digested as bytes. Columns beside ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm import words
from diffspark.llm.common import settled, ship, table
from diffspark.stage import materialise

ship(__name__)

U = np.uint64
LENGTH = 100  # bytes of a string
W = 16  # bytes under the rolling hash
SPAN = 64  # positions of which one triggers; a power of two
CHUNK = 1 << 19  # bytes parsed at a time: short documents together, a long one in pieces
PLACE_BITS = 31
BYTES = words.series(256, 21), words.series(256, 22)
BASES = U(0xD6E8FEB86659FD93), U(0x9FB21C651E98DF25)
INVERSES = tuple(U(pow(int(b), -1, 1 << 64)) for b in BASES)
WHOLE, OPEN = 0, 1  # anchors that are removed, anchors whose strings must be placed


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        with np.errstate(over="ignore"):
            both = [np.full(max(n, CHUNK + LENGTH), b, U) for b in (BASES[which], INVERSES[which])]
            for x in both:
                x[0] = 1
                np.cumprod(x, out=x)
        _POWERS[which] = both[0], both[1]
    return tuple(x[:n] for x in _POWERS[which])


class Rolling:
    """Hashes of any piece of a buffer: sums of byte values times powers, shifted back."""

    def __init__(self, raw: np.ndarray, which: int):
        n = len(raw)
        power, self.back = powers(which, n + 1)
        self.upto = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(BYTES[which][raw] * power[:n], out=self.upto[1:])

    def pieces(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.upto[end] - self.upto[start]) * self.back[start]

    def steps(self, width: int) -> np.ndarray:
        """Hashes of the pieces of ``width`` bytes at all positions."""
        with np.errstate(over="ignore"):
            return (self.upto[width:] - self.upto[:-width]) * self.back[: len(self.upto) - width]


class Parse(NamedTuple):
    """Anchors of a buffer of documents: place, document, first and last start of their
    strings, entry and context name, and whether the document has the same context before."""

    anchor: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    entry: np.ndarray
    context: np.ndarray
    again: np.ndarray


def triggers(roll: Rolling) -> np.ndarray:
    """For every position the trigger chosen by the SPAN positions from there on."""
    low = U((1 << PLACE_BITS) - 1)
    with np.errstate(over="ignore"):
        key = roll.steps(W) * BASES[1]
    key &= ~low
    key |= low - np.arange(len(key), dtype=U)
    step = 1
    while step < SPAN:  # the least of 2, 4, ... successive keys
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    return (low - (key & low)).astype(np.int64)


def _runs(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first six columns of a parse."""
    roll = Rolling(raw, 0), Rolling(raw, 1)
    sizes = np.maximum(np.diff(bounds) - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    skipped = np.cumsum(sizes) - sizes
    start = np.arange(len(doc)) - np.repeat(skipped, sizes) + bounds[doc]
    if not len(start):
        return (np.zeros(0, np.int64),) * 6
    anchor = triggers(roll[0])[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    anchor, doc, first, last = anchor[head], doc[head], start[head], start[tail]
    entry = words.mix(roll[0].pieces(anchor, anchor + LENGTH - SPAN + 1))
    with np.errstate(over="ignore"):
        shape = ((anchor - first) * SPAN + last - first).astype(U)
        context = words.mix(roll[1].pieces(first, last + LENGTH) + words.mix(shape))
    return anchor, doc, first, last, entry.view(np.int64), context.view(np.int64)


def parse(raw: np.ndarray, bounds: np.ndarray) -> Parse:
    """Anchors of the documents ``raw[bounds[i]:bounds[i + 1]]``; one that is longer than CHUNK
    stands alone and is parsed in pieces that end between two runs of starts."""
    if len(raw) <= CHUNK or len(bounds) != 2:
        columns = _runs(raw, bounds)
    else:
        parts, at = [], 0
        while True:
            piece = raw[at : at + CHUNK + LENGTH - 1]
            part = _runs(piece, np.array([0, len(piece)]))
            final = at + len(piece) == len(raw)
            keep = len(part[0]) if final else len(part[0]) - 1  # the last run may go on
            moved = [c[:keep] + at if k in (0, 2, 3) else c[:keep] for k, c in enumerate(part)]
            parts.append(moved)
            if final:
                break
            at += int(part[2][keep])
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    anchor, doc, _, _, entry, context = columns
    order = np.lexsort((anchor, context, entry, doc))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (doc[a] == doc[b]) & (entry[a] == entry[b]) & (context[a] == context[b])
    again = np.empty(len(order), bool)
    again[order] = same
    return Parse(*columns, again)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to) with their texts as one buffer and its bounds; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


ANCHORS = "entry long, context long, doc_id long, row long, place int"


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of all documents, without repeated contexts of one document."""
    for batch in batches:
        for i, _, raw, bounds in chunks(batch.column("text")):
            p = parse(raw, bounds)
            new = np.flatnonzero(~p.again)
            row = pa.array(i + p.doc[new])
            place = (p.anchor[new] - bounds[p.doc[new]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(p.entry[new]),
                    pa.array(p.context[new]),
                    batch.column("doc_id").take(row),
                    batch.column("row").take(row),
                    pa.array(place),
                ],
                ["entry", "context", "doc_id", "row", "place"],
            )


class Removed:
    """Bytes of a buffer that go, as a count of the strings that start and end."""

    def __init__(self, n: int):
        self.change = np.zeros(n + 1, np.int32)

    def add(self, start: np.ndarray, end: np.ndarray) -> None:
        np.add.at(self.change, start, 1)
        np.add.at(self.change, end, -1)

    def mask(self) -> np.ndarray:
        return np.cumsum(self.change[:-1], dtype=np.int32) > 0


def summary(raw: np.ndarray, gone: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans, kept_sha256 of one document."""
    edge = np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(len(gone) and gone[0])
    kept = raw[~gone] if edge else raw
    return len(raw), len(raw) - len(kept), int(edge), hashlib.sha256(kept.tobytes()).hexdigest()


DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESOLVED = f"row long, {DONE}, text binary, gone array<int>, places array<int>, runs array<int>, strings array<binary>"


def ragged(values, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Lists of ``values`` for the owners 0 to n - 1; owners ascend."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def named(column, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists of rows i to j, and the row (from i) of each."""
    part = column.slice(i, j - i)
    lists = part.to_pylist()
    size = [len(x) if x else 0 for x in lists]
    flat = np.fromiter((v for x in lists if x for v in x), np.int64, sum(size))
    return flat, np.repeat(np.arange(j - i), size)


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove whole contexts. A document without open anchors is finished; of the others, the text, the
    bytes known to go and the contexts of open anchors are handed on."""
    for batch in batches:
        for i, j, raw, bounds in chunks(batch.column("text")):
            p = parse(raw, bounds)
            n = j - i
            code, owner = named(batch.column("codes"), i, j)
            spot = np.searchsorted(p.anchor, (code >> 1) + bounds[owner])
            whole = np.concatenate([np.flatnonzero(p.again), spot[code & 1 == WHOLE]])
            gone = Removed(len(raw))
            gone.add(p.first[whole], p.last[whole] + LENGTH)
            gone = gone.mask()
            todo = np.sort(spot[code & 1 == OPEN])
            of = p.doc[todo]
            run = np.column_stack([p.anchor[todo] - p.first[todo], p.last[todo] - p.first[todo]])
            contexts = [raw[a:b].tobytes() for a, b in zip(p.first[todo], p.last[todo] + LENGTH, strict=True)]
            pending = np.zeros(n, bool)
            pending[of] = True
            rows, texts, spans = [], [], []
            for k in range(n):
                piece, g = raw[bounds[k] : bounds[k + 1]], gone[bounds[k] : bounds[k + 1]]
                if pending[k]:
                    rows.append((len(piece), None, None, None))
                    texts.append(piece.tobytes())
                    flips = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]])))
                    spans.append(flips.tolist())
                else:
                    rows.append(summary(piece, g))
                    texts.append(None)
                    spans.append(None)
            size, lost, runs, digest = zip(*rows, strict=True)
            part = batch.slice(i, n)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    part.column("doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array(lost, pa.int64()),
                    pa.array(runs, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(texts, pa.binary()),
                    pa.array(spans, pa.list_(pa.int32())),
                    ragged((p.first[todo] - bounds[of]).astype(np.int32), of, n, pa.int32()),
                    ragged((run[:, 0] * SPAN + run[:, 1]).astype(np.int32), of, n, pa.int32()),
                    ragged(contexts, of, n, pa.binary()),
                ],
                [c.split()[0] for c in RESOLVED.split(", ")],
            )


def contexts_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Slices of open contexts: their rows, one buffer of bytes, where each begins, and the
    offset of the anchor and the number of further strings of each."""
    for i, j, raw, bounds in chunks(batch.column("strings")):
        part = batch.slice(i, j - i)
        run = part.column("runs").to_numpy(zero_copy_only=False).astype(np.int64)
        yield part, raw, bounds[:-1], run // SPAN, run % SPAN


BLOCK = 8  # successive strings that are tried together
PART = "entry long, context long, doc_id long, row long, place int, size int, head int"


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open contexts in blocks of BLOCK strings, cut by their offset to the anchor: the bytes
    that all strings a block could have would share are its entry, all it has are its context."""
    for batch in batches:
        for part, raw, begin, offset, more in contexts_of(batch):
            roll = Rolling(raw, 0), Rolling(raw, 1)
            high, low = offset // BLOCK, (offset - more) // BLOCK
            count = high - low + 1
            of = np.repeat(np.arange(len(begin)), count)
            block = high[of] - (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
            first = begin[of] + np.maximum(offset[of] - (block * BLOCK + BLOCK - 1), 0)
            last = begin[of] + np.minimum(offset[of] - block * BLOCK, more[of])
            common = begin[of] + offset[of] - block * BLOCK  # start of the last string it could have
            shape = ((common - first) * BLOCK + last - first).astype(U)
            entry = words.mix(roll[0].pieces(common, common + LENGTH - BLOCK + 1))
            with np.errstate(over="ignore"):
                context = words.mix(roll[1].pieces(first, last + LENGTH) + words.mix(shape))
            row = pa.array(of)
            head = part.column("places").take(row)
            place = head.to_numpy(zero_copy_only=False) + first - begin[of]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(entry.view(np.int64)),
                    pa.array(context.view(np.int64)),
                    part.column("doc_id").take(row),
                    part.column("row").take(row),
                    pa.array(place.astype(np.int32)),
                    pa.array((last - first + 1).astype(np.int32)),
                    head,
                ],
                [c.split()[0] for c in PART.split(", ")],
            )


STRING = "h0 long, h1 long, doc_id long, row long, place int"


def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of open blocks (``place``, ``size``) in their contexts."""
    for batch in batches:
        for part, raw, begin, _, _ in contexts_of(batch):
            head, place, size = (
                part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("places", "place", "size")
            )
            of = np.repeat(np.arange(len(size)), size)
            shift = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + place[of] - head[of]
            at = begin[of] + shift
            found = [words.mix(Rolling(raw, k).pieces(at, at + LENGTH)).view(np.int64) for k in (0, 1)]
            row = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(f) for f in found),
                    part.column("doc_id").take(row),
                    part.column("row").take(row),
                    pa.array((head[of] + shift).astype(np.int32)),
                ],
                [c.split()[0] for c in STRING.split(", ")],
            )


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the blocks and strings found to be later ones from documents that were handed on."""
    for batch in batches:
        for i, j, raw, bounds in chunks(batch.column("text")):
            gone = Removed(len(raw))
            flat, owner = named(batch.column("gone"), i, j)
            flat = flat + bounds[owner]
            gone.add(flat[0::2], flat[1::2])
            code, owner = named(batch.column("later"), i, j)
            start = code // (2 * BLOCK) + bounds[owner]
            gone.add(start, start + code % (2 * BLOCK) - 1 + LENGTH)
            mask = gone.mask()
            rows = [
                summary(raw[a:b], mask[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)
            ]
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                [c.split()[0] for c in DONE.split(", ")],
            )


def repeated(rows: DataFrame) -> DataFrame:
    """Rows whose entry occurs more than once."""
    entries = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entry")
    return materialise(rows.join(materialise(entries), "entry"))


def later_ones(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of rows with the same ``keys`` the first (by doc_id, row, place), with how many there are
    (n), and all others."""
    others = [c for c in rows.columns if c not in (*keys, "doc_id", "row", "place")]
    first = F.min(F.struct("doc_id", "row", "place", *others)).alias("first")
    firsts = materialise(rows.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("n")))
    several = materialise(
        firsts.where("n > 1").select(*keys, F.col("first.row").alias("_row"), F.col("first.place").alias("_place"))
    )
    other = (F.col("row") != F.col("_row")) | (F.col("place") != F.col("_place"))
    later = rows.join(several, keys).where(other).drop("_row", "_place")
    return firsts, later


def still_open(firsts: DataFrame) -> DataFrame:
    """First rows of the contexts of entries with several contexts."""
    entries = firsts.groupBy("entry").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("entry")
    return firsts.join(materialise(entries), "entry", "left_semi").select("first.*")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = settled(docs)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    firsts, later = later_ones(repeated(rows.mapInArrow(anchors, ANCHORS)), ["entry", "context"])

    def coded(of: DataFrame, kind: int) -> DataFrame:
        return of.select("row", (F.col("place").cast("long") * 2 + kind).alias("code"))

    codes = coded(later, WHOLE).unionByName(coded(still_open(firsts), OPEN))
    codes = materialise(codes.groupBy("row").agg(F.collect_list("code").alias("codes")))
    handled = materialise(rows.join(codes, "row", "left").mapInArrow(resolve, RESOLVED))
    pending = handled.where("text is not null")
    contexts = materialise(
        pending.select("doc_id", "row", F.inline(F.arrays_zip("places", "runs", "strings")))
    )
    firsts, later = later_ones(repeated(contexts.mapInArrow(parts, PART)), ["entry", "context"])
    opened = still_open(firsts).select(F.col("row"), "place", "size", F.col("head").alias("places"))
    strings = materialise(contexts.join(opened, ["row", "places"]).mapInArrow(single, STRING))
    _, same = later_ones(strings, ["h0", "h1"])
    code = F.col("place").cast("long") * (2 * BLOCK) + F.col("size")
    removed = later.select("row", "place", "size").unionByName(
        same.select("row", "place", F.lit(1).alias("size"))
    )
    lists = materialise(removed.groupBy("row").agg(F.collect_list(code).alias("later")))
    rest = pending.select("row", "doc_id", "text", "gone").join(lists, "row", "left")
    return handled.where("text is null").select([c.split()[0] for c in DONE.split(", ")]).unionByName(
        rest.select("doc_id", "text", "gone", "later").mapInArrow(finish, DONE)
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all, strings of 100 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"))
