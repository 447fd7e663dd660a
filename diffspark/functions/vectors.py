"""Numpy kernels of vector imputation: an identifier is one row whose numbers are vectors over
the imputations.

A vector travels as the bytes of its doubles; NaN stands for a missing number. Matrices have a
row per identifier (or pair) and a column per imputation.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle

from diffspark.functions.special import np_digamma, np_t_two_sided, np_trigamma

# Travels with its code, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 128  # rows of a matrix in memory


def pack(v) -> bytes:
    return np.ascontiguousarray(v, float).tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


# --- draws -------------------------------------------------------------------------------------


def keyed_uniforms(prefix: bytes, ends: list[bytes]) -> np.ndarray:
    """Uniforms on (0, 1) from the first 12 hex digits of the md5 of ``prefix`` with each end."""
    six = b"".join([b"\0\0" + hashlib.md5(prefix + e, usedforsecurity=False).digest()[:6] for e in ends])
    return (np.frombuffer(six, ">u8").astype(float) + 0.5) / 2.0**48


class Numbers(NamedTuple):
    """Ends of the hashed keys of the imputations from ``start`` to ``stop``."""

    first: list[bytes]
    second: list[bytes]

    @classmethod
    def of(cls, start: int, stop: int) -> Numbers:
        return cls(*([f"|{i}|{stream}".encode() for i in range(start, stop)] for stream in "ab"))


def draw(identifier, condition, replicate, centre, spread, seed, numbers: Numbers) -> np.ndarray:
    """Draws of a missing value, as :func:`keyed.keyed_normal` has them."""
    prefix = f"{seed}|{identifier}|{condition}|{replicate}".encode()
    radius = np.sqrt(-2.0 * np.log(keyed_uniforms(prefix, numbers.first)))
    return centre + spread * (radius * np.cos(2 * np.pi * keyed_uniforms(prefix, numbers.second)))


DRAWN = "array<double>"


def draws(*columns: pa.Array, m: int) -> pa.Array:
    """The ``m`` draws of missing values (identifier, condition, replicate, centre, spread, seed)."""
    numbers = Numbers.of(0, m)
    found = [draw(*row, numbers) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
    edges = pa.array(np.arange(len(found) + 1) * m, pa.int32())
    return pa.ListArray.from_arrays(edges, pa.array(np.concatenate([np.zeros(0), *found])))


def drawer(m: int):
    """A function of Arrow columns that gives the draws."""

    def drawn(
        identifier: pa.Array, condition: pa.Array, replicate: pa.Array, centre: pa.Array, spread: pa.Array, seed: pa.Array
    ) -> pa.Array:
        return draws(identifier, condition, replicate, centre, spread, seed, m=m)

    return drawn


# --- sums of draws -----------------------------------------------------------------------------


class Weight(NamedTuple):
    """Precision weight exp(-2 ln spread) at a value, by the coefficients of a trend."""

    intercept: float
    slope: float
    upper_intercept: float
    upper_slope: float

    def at(self, y: np.ndarray, upper: bool) -> np.ndarray:
        line = self.intercept + self.slope * y
        if upper:
            line = line + self.upper_intercept + self.upper_slope * y
        return np.exp(-2 * line)


class Range(NamedTuple):
    """Imputations from ``start`` to ``stop``."""

    start: int
    stop: int

    def size(self) -> int:
        return self.stop - self.start


def gap_sums(identifier: str, gap: dict, weight: Weight | None, numbers: Numbers) -> np.ndarray:
    """Draws of a missing value about their centre: d and d^2, or d, w, w d and w d^2."""
    names = ("condition", "replicate", "centre", "spread", "seed")
    y = draw(identifier, *(gap[n] for n in names), numbers)
    d = y - gap["centre"]
    if weight is None:
        return np.stack([d, d * d])
    w = weight.at(y, gap["upper"])
    return np.stack([d, w, w * d, w * d * d])


# --- profiles ------------------------------------------------------------------------------------


class Cell(NamedTuple):
    """Moments of a condition: count, mean, and what variance and weight are made of."""

    n: int
    mean: np.ndarray | float
    w: np.ndarray | float
    wmean: np.ndarray | float
    wss: np.ndarray | float


def _together(w, mean, ss, w2, mean2, ss2):
    """Moments of two disjoint sets of values from the moments of each."""
    total = w + w2
    away = mean2 - mean
    return total, mean + w2 / total * away, ss + ss2 + w * (w2 / total) * away * away


def cells_of(
    identifier: str, observed: list, gaps: list, weighted: bool, weight: Weight | None, numbers: Numbers
) -> dict[str, Cell]:
    """Cells of measured values and of draws, which are made here and kept as sums only."""
    m, out = len(numbers.first), {}
    for condition, c in observed or []:
        w, mean, ss = (c["w"], c["wmean"], c["wss"]) if weighted else (c["n"], c["mean"], c["ss"])
        out[condition] = Cell(c["n"], c["mean"], w, mean, ss)
    filled: dict[str, list] = {}
    for gap in gaps or []:
        part = filled.setdefault(gap["condition"], [gap["centre"], 0, 0.0])
        part[1] += 1
        part[2] = part[2] + gap_sums(identifier, gap, weight, numbers)
    for condition, (centre, g, sums) in filled.items():
        mean = centre + sums[0] / g
        if weighted:
            w, wmean = sums[1], centre + sums[2] / sums[1]
            wss = np.maximum(sums[3] - sums[2] ** 2 / sums[1], 0.0) if g > 1 else np.zeros(m)
        else:
            w, wmean, wss = float(g), mean, np.maximum(sums[1] - sums[0] ** 2 / g, 0.0)
        seen = out.get(condition)
        if seen is None:
            out[condition] = Cell(g, mean, w, wmean, wss)
        else:
            _, plain, _ = _together(seen.n, seen.mean, 0.0, g, mean, 0.0)
            out[condition] = Cell(seen.n + g, plain, *_together(seen.w, seen.wmean, seen.wss, w, wmean, wss))
    return out


class Profile(NamedTuple):
    df: float
    level: np.ndarray | float
    s2: np.ndarray | float
    cells: dict[str, Cell]


def profile_of(cells: dict[str, Cell]) -> Profile:
    df = float(sum(max(c.n - 1, 0) for c in cells.values()))
    n = sum(c.n for c in cells.values())
    level = sum(c.n * c.mean for c in cells.values()) / n if n else np.nan
    s2 = sum(c.wss for c in cells.values()) / df if df > 0 else np.nan
    return Profile(df, level, s2, cells)


def profiles(part: pa.RecordBatch, weighted: bool, numbers: Numbers) -> list[Profile]:
    """Profiles of rows (identifier, cells, gaps, weight: coefficients, the same in all rows)."""
    found = part.column("weight")[0].as_py() if part.num_rows else None
    weight = None if found is None else Weight(*found)
    rows = zip(*(part.column(c).to_pylist() for c in ("identifier", "cells", "gaps")), strict=True)
    return [profile_of(cells_of(name, seen, gaps, weighted, weight, numbers)) for name, seen, gaps in rows]


RESIDUALS = "e binary, level binary, first_level double, tri double"


def residuals(batches: Iterator[pa.RecordBatch], some: Range, weighted: bool) -> Iterator[pa.RecordBatch]:
    """ln s2 on the scale where it is expected at ln of the prior variance; identifiers without
    residual variance are left out."""
    numbers = Numbers.of(*some)
    for batch in batches:
        for part in slices(batch):
            rows = []
            for p in profiles(part, weighted, numbers):
                s2 = np.atleast_1d(p.s2)
                if not (p.df > 0 and (s2 > 0).any()):
                    continue
                half = p.df / 2
                with np.errstate(divide="ignore"):
                    e = np.where(s2 > 0, np.log(s2) - np_digamma(half) + np.log(half), np.nan)
                level = np.atleast_1d(p.level)
                rows.append((pack(e), pack(level), float(level[0]), float(np_trigamma(half))))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.binary(), pa.binary(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["e", "level", "first_level", "tri"]
            )


def matrix(column, m: int) -> np.ndarray:
    """Vectors as rows; a vector of one number holds for all imputations."""
    out = np.empty((len(column), m))
    for k, b in enumerate(column.to_pylist()):
        out[k] = unpack(b)
    return out


def residual_matrices(batches: Iterator[pa.RecordBatch], m: int):
    for batch in batches:
        for part in slices(batch):
            yield part, matrix(part.column("e"), m)


# --- prior ------------------------------------------------------------------------------------

class Basis(NamedTuple):
    """Functions of the level that ln of the prior variance is a combination of: a parabola about
    ``centre``, a constant (no ``degree``), or a natural cubic spline through ``knots``."""

    degree: int
    centre: float = 0.0
    knots: tuple[float, ...] = ()

    def size(self) -> int:
        return len(self.knots) if self.knots else self.degree + 1

    def at(self, level) -> list:
        if not self.knots:
            u = level - self.centre
            return [u**k for k in range(self.degree + 1)]
        first, last = self.knots[0], self.knots[-1]
        z = (level - first) / (last - first)
        past = np.maximum(z - 1, 0.0) ** 3

        def bend(knot: float):
            q = (knot - first) / (last - first)
            return (np.maximum(z - q, 0.0) ** 3 - past) / (1 - q)

        outer = bend(self.knots[-2])
        return [z**0, z, *(bend(k) - outer for k in self.knots[:-2])]

    def sums(self) -> list[str]:
        """Names of the sums of a fit: lower half of the squares, products with e, the rest."""
        k = range(self.size())
        return [f"b{i}{j}" for i in k for j in range(i + 1)] + [f"e{i}" for i in k] + ["ee", "tri"]


def fit_sums(batches: Iterator[pa.RecordBatch], m: int, basis: Basis, low, high) -> Iterator[pa.RecordBatch]:
    """Sums for a least-squares fit of e on the basis, per imputation; e is first drawn in to
    [low, high]."""
    names, k = basis.sums(), basis.size()
    total = dict.fromkeys(names, 0.0)
    for part, e in residual_matrices(batches, m):
        tri = part.column("tri").to_numpy(zero_copy_only=False)[:, None]
        some = ~np.isnan(e)
        e = np.where(some, np.clip(e, low, high), 0.0)
        x = [np.where(some, f, 0.0) for f in basis.at(matrix(part.column("level"), m))]
        for i in range(k):
            for j in range(i + 1):
                total[f"b{i}{j}"] = total[f"b{i}{j}"] + (x[i] * x[j]).sum(axis=0)
            total[f"e{i}"] = total[f"e{i}"] + (x[i] * e).sum(axis=0)
        total["ee"] = total["ee"] + (e * e).sum(axis=0)
        total["tri"] = total["tri"] + (some * tri).sum(axis=0)
    columns = {c: np.broadcast_to(v, m) for c, v in total.items()}
    yield pa.RecordBatch.from_pydict({"imputation": np.arange(m, dtype=np.int32), **columns})


def ranges(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """Count, smallest and largest e of each imputation."""
    n, low, high = np.zeros(m, np.int64), np.full(m, np.inf), np.full(m, -np.inf)
    for _, e in residual_matrices(batches, m):
        n += (~np.isnan(e)).sum(axis=0)
        low, high = np.fmin(low, np.fmin.reduce(e)), np.fmax(high, np.fmax.reduce(e))
    yield pa.RecordBatch.from_pydict({"imputation": np.arange(m, dtype=np.int32), "n": n, "low": low, "high": high})


def below_cuts(batches: Iterator[pa.RecordBatch], m: int, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many e of each imputation are below each of its cuts (targets, cuts, imputations)."""
    count = np.zeros(cuts.shape, np.int64)
    for _, e in residual_matrices(batches, m):
        for t in range(cuts.shape[0]):
            for k in range(cuts.shape[1]):
                count[t, k] += (e < cuts[t, k]).sum(axis=0)
    yield pa.RecordBatch.from_pydict({"cell": np.arange(count.size, dtype=np.int32), "n": count.ravel()})


def between(batches: Iterator[pa.RecordBatch], m: int, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The e of each imputation in its brackets [low, high) (targets, imputations)."""
    for _, e in residual_matrices(batches, m):
        for t in range(len(low)):
            row, imputation = np.nonzero((e >= low[t]) & (e < high[t]))
            columns = {"target": np.full(len(row), t, np.int32), "imputation": imputation.astype(np.int32)}
            yield pa.RecordBatch.from_pydict(columns | {"e": e[row, imputation]})


# --- tests -------------------------------------------------------------------------------------


class Prior(NamedTuple):
    """Over the imputations: degrees of freedom, and coefficients (basis, imputations) of ln prior
    variance."""

    d0: np.ndarray
    coefficients: np.ndarray
    basis: Basis

    def shrink(self, p: Profile) -> tuple[np.ndarray, np.ndarray]:
        """Shrunk variance and its degrees of freedom."""
        infinite = np.isinf(self.d0)
        half = np.where(infinite, 1.0, self.d0) / 2
        line = sum(c * f for c, f in zip(self.coefficients, self.basis.at(p.level), strict=True))
        step = np.where(infinite, 0.0, np_digamma(half) - np.log(half))
        prior = np.exp(line + step)
        s2 = p.s2 if p.df > 0 else 0.0
        own = np.where(infinite, 1.0, self.d0)
        blend = (own * prior + p.df * s2) / (own + p.df)
        return np.where(infinite, prior, blend), self.d0 + p.df


BLOCKS = "comparison string, block long, identifiers array<string>, p binary, median_lfc array<double>"


def middle(values: np.ndarray) -> np.ndarray:
    """Median of every row, NaN left out."""
    ordered = np.sort(values, axis=1)
    n = (~np.isnan(ordered)).sum(axis=1)
    last = np.maximum(n - 1, 0)
    row = np.arange(len(values))
    found = (ordered[row, last // 2] + ordered[row, (last + 1) // 2]) / 2
    return np.where(n > 0, found, np.nan)


def only(p: Profile, some: Range) -> Profile:
    """A profile of all imputations for some of them."""

    def cut(x):
        return x[some.start : some.stop] if np.ndim(x) else x

    cells = {k: Cell(c.n, *(cut(x) for x in c[1:])) for k, c in p.cells.items()}
    return Profile(p.df, cut(p.level), cut(p.s2), cells)


def tests(
    batches: Iterator[pa.RecordBatch],
    some: Range,
    m: int,
    weighted: bool,
    prior: Prior,
    contrasts: list,
    rows: int = ROWS,
) -> Iterator[pa.RecordBatch]:
    """P-values of ``some`` imputations in blocks of ``rows`` identifiers or somewhat fewer, one block
    per contrast. Medians are those of all ``m`` imputations, and come with the first ones."""
    whole = some.start == 0
    numbers, size = Numbers.of(*((0, m) if whole else some)), some.size()
    number = TaskContext.get().partitionId() << 33
    missing = Cell(0, np.nan, np.nan, np.nan, np.nan)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            names: list[str] = []
            p_values: dict[str, list[bytes]] = {c: [] for c, _, _ in contrasts}
            medians: dict[str, list] = {c: [] for c, _, _ in contrasts}
            for part in slices(batch.slice(at, rows)):
                names += part.column("identifier").to_pylist()
                found = profiles(part, weighted, numbers)
                drawn = [only(p, some) for p in found] if size < len(numbers.first) else found
                shrunk = [prior.shrink(p) for p in drawn]
                df = np.stack([np.broadcast_to(d, size) for _, d in shrunk])
                for comparison, a, b in contrasts:
                    t, lfc = np.empty((len(drawn), size)), np.empty((len(found), len(numbers.first)))
                    for k, (p, (s2, _)) in enumerate(zip(drawn, shrunk, strict=True)):
                        x, y = p.cells.get(a, missing), p.cells.get(b, missing)
                        with np.errstate(divide="ignore", invalid="ignore"):
                            se2 = s2 * (1 / np.asarray(x.w, float) + 1 / np.asarray(y.w, float))
                            t[k] = np.where((p.df > 0) & (se2 > 0), (x.wmean - y.wmean) / np.sqrt(se2), np.nan)
                    p_values[comparison].append(pack(np_t_two_sided(t, df)))
                    if whole:
                        for k, p in enumerate(found):
                            lfc[k] = p.cells.get(a, missing).wmean - p.cells.get(b, missing).wmean
                        medians[comparison] += _nulls(middle(lfc))
            for comparison, _, _ in contrasts:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([comparison]),
                        pa.array([number], pa.int64()),
                        pa.array([names], pa.list_(pa.string())),
                        pa.array([b"".join(p_values[comparison])], pa.binary()),
                        pa.array([medians[comparison] if whole else None], pa.list_(pa.float64())),
                    ],
                    [c.split()[0] for c in BLOCKS.split(", ")],
                )
            number += 1


def _nulls(values: np.ndarray) -> list:
    return [None if np.isnan(v) else float(v) for v in values]


def first_values(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """P-values of the first imputation."""
    for batch in batches:
        for b in batch.column("p").to_pylist():
            p = unpack(b).reshape(-1, m)[:, 0]
            yield pa.RecordBatch.from_pydict({"p_val": p[~np.isnan(p)]})


# --- false discovery rate -------------------------------------------------------------------------


COUNTED = 1 << 23  # counts in memory at a time


def bucket_counts(batches: Iterator[pa.RecordBatch], m: int, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Number of p-values per comparison, bucket and imputation, from a matrix per comparison."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for comparison, b in zip(batch.column("comparison").to_pylist(), batch.column("p").to_pylist(), strict=True):
            p = unpack(b)
            at = np.flatnonzero(~np.isnan(p))
            cell = np.searchsorted(cuts, p[at], "right") * m + at % m
            found = np.bincount(cell, minlength=(len(cuts) + 1) * m)
            counts[comparison] = counts.get(comparison, 0) + found
            if len(counts) * len(found) > COUNTED:
                yield from _counted(counts, m)
                counts = {}
    yield from _counted(counts, m)


def _counted(counts: dict[str, np.ndarray], m: int) -> Iterator[pa.RecordBatch]:
    for comparison, found in counts.items():
        cell = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict(
            {
                "comparison": pa.array([comparison] * len(cell), pa.string()),
                "bucket": (cell // m).astype(np.int32),
                "imputation": (cell % m).astype(np.int32),
                "n": found[cell],
            }
        )


PIECES = "comparison string, bucket int, part int, block long, place binary, p binary"


def deal(batches: Iterator[pa.RecordBatch], cuts: np.ndarray, flat: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of p-values cut into pieces by bucket. Buckets of a single value (``flat``) need no
    order and are dealt over ``parts`` tasks."""
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("comparison", "block", "p"))
        for comparison, block, b in zip(*columns, strict=True):
            p = unpack(b)
            place = np.flatnonzero(~np.isnan(p)).astype(np.int32)
            bucket = np.searchsorted(cuts, p[place], "right")
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            for piece in np.split(order, edges):
                if len(piece):
                    k = int(bucket[piece[0]])
                    part = block % parts if flat[k] else 0
                    rows.append((comparison, k, part, block, place[piece].tobytes(), pack(p[place[piece]])))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")]
        )


RANKED = "comparison string, bucket int, block long, place binary, low binary"
LEAST = -1  # block number of the row that holds a bucket's least values


def rank(pieces: pa.Table, sizes: pa.Table, m: int, flat: np.ndarray) -> pa.Table:
    """Least of size / rank * p from each p-value on, within its bucket."""
    names = [c.split()[0] for c in RANKED.split(", ")]
    if not pieces.num_rows:
        return pa.table([pa.array([], t) for t in (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())], names)
    comparison, bucket = pieces.column("comparison")[0].as_py(), pieces.column("bucket")[0].as_py()
    blocks = pieces.column("block").to_pylist()
    place = [np.frombuffer(b, np.int32) for b in pieces.column("place").to_pylist()]
    sizes_of_pieces = [len(x) for x in place]
    place = np.concatenate(place)
    p = np.concatenate([unpack(b) for b in pieces.column("p").to_pylist()])
    imputation = place % m
    row = sizes.slice(0, 1).to_pylist()[0]
    before, inside, total = (np.zeros(m) for _ in range(3))
    for i, b, n, size in zip(row["imputation"], row["before"], row["n"], row["size"], strict=True):
        before[i], inside[i], total[i] = b, n, size
    if flat[bucket]:
        low = total[imputation] / (before + inside)[imputation] * p
    else:
        order = np.lexsort((p, imputation))
        group = imputation[order]
        start = np.searchsorted(group, np.arange(m))
        nth = np.arange(len(order)) - start[group] + 1
        raw = total[group] / (before[group] + nth) * p[order]
        low = np.empty(len(order))
        low[order] = _least_from(raw, start)
    least = np.full(m, np.inf)
    np.minimum.at(least, imputation, low)
    ends = np.cumsum(sizes_of_pieces)[:-1]
    places = [x.tobytes() for x in np.split(place, ends)] + [b""]
    lows = [pack(x) for x in np.split(low, ends)] + [pack(least)]
    n = len(blocks) + 1
    return pa.table(
        [
            pa.array([comparison] * n, pa.string()),
            pa.array([bucket] * n, pa.int32()),
            pa.array([*blocks, LEAST], pa.int64()),
            pa.array(places, pa.binary()),
            pa.array(lows, pa.binary()),
        ],
        names,
    )


def _least_from(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running minimum from the right within the runs that begin at ``start``."""
    out = raw.copy()
    ends = np.append(start[1:], len(raw))
    for a, b in zip(start, ends, strict=True):
        if b - a > 1:
            out[a:b] = np.minimum.accumulate(raw[a:b][::-1])[::-1]
    return out


def least_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least values of buckets, one row per imputation that has any."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("comparison", "bucket", "low")), strict=True)
        for comparison, bucket, b in rows:
            low = unpack(b)
            i = np.flatnonzero(np.isfinite(low))
            yield pa.RecordBatch.from_pydict(
                {
                    "comparison": pa.array([comparison] * len(i), pa.string()),
                    "bucket": np.full(len(i), bucket, np.int32),
                    "imputation": i.astype(np.int32),
                    "low": low[i],
                }
            )


def adjusted(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """Rates of the pieces: nothing above 1 or above the least value of later buckets."""
    for batch in batches:
        rates = []
        columns = (batch.column(c) for c in ("place", "low", "imputation", "tail"))
        for place, low, imputations, tails in zip(*columns, strict=True):
            tail = np.ones(m)
            if imputations.is_valid:  # as arrays: a piece may be shorter than its lists
                tail[imputations.values.to_numpy()] = np.minimum(tails.values.to_numpy(), 1.0)
            where = np.frombuffer(place.as_py(), np.int32) % m
            rates.append(pack(np.minimum(unpack(low.as_py()), tail[where])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("comparison"), batch.column("block"), batch.column("place"), pa.array(rates, pa.binary())],
            ["comparison", "block", "place", "q"],
        )


RATES = "comparison string, block long, identifiers array<string>, median_lfc array<double>, q binary"
AGREED = "identifier string, comparison string, hits long, median_p_val double, median_lfc double, critical double"


def rates_of(row: dict, pieces: pa.Table, m: int) -> np.ndarray:
    """Rates of a block as a matrix, from its pieces."""
    q = np.full(len(row["identifiers"]) * m, np.nan)
    for place, rates in zip(pieces.column("place").to_pylist(), pieces.column("q").to_pylist(), strict=True):
        q[np.frombuffer(place, np.int32)] = unpack(rates)
    return q.reshape(-1, m)


def _first_row(block: pa.Table) -> dict:
    return block.select(["comparison", "block", "identifiers", "median_lfc"]).slice(0, 1).to_pylist()[0]


def block_rates(block: pa.Table, pieces: pa.Table, m: int) -> pa.Table:
    """Rates of a block over ``m`` imputations, with its identifiers and medians if it has these."""
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.binary())
    names = [c.split()[0] for c in RATES.split(", ")]
    if not block.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names)
    row = _first_row(block)
    q = pack(rates_of(row, pieces, m))
    named = row["identifiers"] if row["median_lfc"] is not None else None
    values = (row["comparison"], row["block"], named, row["median_lfc"], q)
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def agreement(block: pa.Table, pieces: pa.Table, m: int, alpha: float, need: int) -> pa.Table:
    """Hits, medians and the ``need``-th smallest rate of every pair of a block."""
    if not block.num_rows:
        return _agreed([], "", [], np.empty((0, m)), alpha, need)
    row = _first_row(block)
    return _agreed(row["identifiers"], row["comparison"], row["median_lfc"], rates_of(row, pieces, m), alpha, need)


def agreement_of_parts(alpha: float, need: int):
    """The same of a block whose rates come in parts of some imputations each."""

    def agreed(parts: pa.Table) -> pa.Table:
        named = next(r for r in parts.drop_columns(["q"]).to_pylist() if r["identifiers"] is not None)
        n = len(named["identifiers"])
        q = np.concatenate([unpack(b).reshape(n, -1) for b in parts.column("q").to_pylist()], axis=1)
        return _agreed(named["identifiers"], named["comparison"], named["median_lfc"], q, alpha, need)

    return agreed


def _agreed(identifiers: list, comparison: str, median_lfc: list, q: np.ndarray, alpha: float, need: int) -> pa.Table:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    columns = (
        identifiers,
        [comparison] * len(q),
        (q < alpha).sum(axis=1),
        _nulls(middle(q)),
        median_lfc,
        _nulls(np.sort(q, axis=1)[:, need - 1]),
    )
    names = [c.split()[0] for c in AGREED.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
