"""Whitening of integer vectors by spectrum slicing.

1. Components become integers, floor(64 * c) + 1000000; vectors are made distinct. Exact sums give
   the mean, a second pass sums the products of centred components: d * d numbers, d being
   the dimension, whatever the number of rows.
2. The leading eigenvalues of that matrix V are isolated on the driver. V - s I = L D L' with
   symmetric pivoting has as many negative eigenvalues as D (Sylvester), so one factorisation counts the
   eigenvalues below s. Bisection on these counts goes on until every wanted eigenvalue has an
   interval of its own. Inside it Rayleigh quotient iteration converges cubically; a limit that
   leaves the interval is given up and the interval is halved again. Counts on both sides of
   each limit certify its number.
3. Eigenvalues that cannot be told apart (closer than TIE times the trace) form a cluster with
   one interval; its vectors are found one after the other, each orthogonal to those before.
4. Rows are projected in tasks.

Every row meets vectors of bounded size; nothing but sums of the dimension's size reaches the driver.

Cases: vectors that are null or empty, or hold a null, a non-finite or a component beyond 64-bit
integers, take no part. Vectors of different sizes are filled up as with zeros. Rows that
repeat count once in the fit and all have results. Components whose eigenvalue is zero
(below ZERO times the trace) have no whitened value and no rows: equal vectors only, a single
vector or an empty table give no rows. ``vec_id`` may be null or repeat. ``deviation`` is null where it
does not fit 64 bits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm.common import ship, table
from diffspark.stage import materialise

ship(__name__)

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 62)
ZERO, TIE = 1e-12, 1e-13  # shares of the trace
PIVOT = (1 + 17**0.5) / 8  # bound of element growth of symmetric pivoting
SLICE = 4096  # vectors that a task turns into a matrix at a time


# --- eigenvalues by slicing ----------------------------------------------------------------


def below(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``v`` below ``shift``: the negative ones of D in the LDL'
    factorisation of v - shift I, with pivots of one or two rows."""
    a = v - shift * np.eye(len(v))
    tiny = np.finfo(float).tiny
    count, k, n = 0, 0, len(a)
    while k < n:
        rest = a[k:, k:]
        diagonal = np.abs(np.diagonal(rest))
        p = int(diagonal.argmax())
        size = n - k
        if size > 1:
            off = np.abs(rest)
            off.flat[:: size + 1] = 0.0
            largest = off.max()
        else:
            largest = 0.0
        if diagonal[p] >= PIVOT * largest or size == 1:
            _swap(rest, 0, p)
            d = rest[0, 0]
            count += d < 0
            if size > 1 and abs(d) > tiny:
                column = rest[1:, 0] / d
                rest[1:, 1:] -= np.outer(column, rest[0, 1:])
            k += 1
        else:  # a block of two rows with eigenvalues of both signs
            i, j = np.unravel_index(int(off.argmax()), off.shape)
            _swap(rest, 0, min(i, j))
            _swap(rest, 1, max(i, j))
            block = rest[:2, :2].copy()
            count += 1
            if size > 2:
                rest[2:, 2:] -= rest[2:, :2] @ np.linalg.solve(block, rest[:2, 2:])
            k += 2
    return count


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


class Interval(NamedTuple):
    """(low, high) holds the eigenvalues number ``first`` to ``last`` from the largest, and no others."""

    low: float
    high: float
    first: int
    last: int


def isolate(v: np.ndarray, wanted: int, tie: float) -> list[Interval]:
    """Disjoint intervals of the ``wanted`` largest eigenvalues, largest first, each of one
    eigenvalue or of a cluster no wider than ``tie``."""
    n = len(v)
    reach = float(np.abs(v).sum(axis=1).max())  # no eigenvalue is larger (Gershgorin)
    todo = [Interval(-2 * reach - tie, 2 * reach + tie, 1, n)]
    done = []
    while todo:
        it = todo.pop()
        if it.first > wanted:
            continue
        if it.first == it.last or it.high - it.low <= tie:
            done.append(it)
            continue
        todo += reversed(_halve(v, it))
    return done


def _halve(v: np.ndarray, it: Interval) -> list[Interval]:
    """The parts of an interval that hold eigenvalues, upper part first."""
    middle = (it.low + it.high) / 2
    above = len(v) - below(v, middle)  # eigenvalues from ``middle`` up
    upper = Interval(middle, it.high, it.first, min(above, it.last))
    lower = Interval(it.low, middle, max(above + 1, it.first), it.last)
    return [part for part in (upper, lower) if part.first <= part.last]


def _iterate(v: np.ndarray, shift: float, found: np.ndarray, scale: float, seed: int) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from an eigenvalue estimate, orthogonal to ``found``."""
    n = len(v)
    x = np.random.default_rng(seed).standard_normal(n)

    def unit(y: np.ndarray) -> np.ndarray:
        for _ in range(2):
            y = y - found.T @ (found @ y)
            y = y / np.linalg.norm(y)
        return y

    x, rho = unit(x), shift
    for step in range(30):
        try:
            y = np.linalg.solve(v - rho * np.eye(n), x)
        except np.linalg.LinAlgError:  # the estimate is an eigenvalue to the last digit
            y = np.linalg.solve(v - (rho + 4e-16 * scale) * np.eye(n), x)
        x = unit(y)
        if step:  # the first step only turns a random vector towards the interval
            rho = float(x @ v @ x)
            if np.linalg.norm(v @ x - rho * x) <= 4e-15 * scale:
                break
    return float(x @ v @ x), x


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``wanted`` largest eigenvalues of ``v`` that are not zero, and unit eigenvectors as rows.

    Raises ArithmeticError if the counts do not certify the numbering.
    """
    scale = float(np.trace(v))
    n = len(v)
    values, vectors = [], np.zeros((0, n))
    if not scale > 0:
        return np.array(values), vectors
    wanted = min(wanted, n - below(v, ZERO * scale))
    tie = TIE * scale
    for interval in isolate(v, wanted, tie):
        it = interval
        for number in range(it.first, it.last + 1):
            while True:
                rho, x = _iterate(v, (it.low + it.high) / 2, vectors, scale, number)
                if it.low - tie <= rho <= it.high + tie:
                    break
                if it.high - it.low <= tie:
                    raise ArithmeticError(f"eigenvalue {number} was not found in ({it.low}, {it.high})")
                (it,) = _halve(v, it)
            values.append(rho)
            vectors = np.vstack([vectors, x])
        for value in values[interval.first - 1 :]:
            if not (n - below(v, value + tie) < interval.last and n - below(v, value - tie) >= interval.first):
                raise ArithmeticError(f"counts do not certify the eigenvalues in {interval}")
    by_size = np.argsort(-np.array(values), kind="stable")[:wanted]
    return np.array(values)[by_size], vectors[by_size]


# --- rows ------------------------------------------------------------------------------------


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part."""
    v = F.col("_v")

    def bad(c):
        d = c.cast("double")
        return c.isNull() | F.isnan(d) | (F.abs(d) >= LARGEST / SCALE)

    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad)
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("_v"))
        .where(usable)
        .select(
            "vec_id",
            F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x"),
        )
    )


def matrices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as rows of a matrix."""
    for at in range(0, batch.num_rows, SLICE):
        part = batch.slice(at, SLICE)
        column = part.column("x")
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False)
        out = np.full((part.num_rows, width), SHIFT, np.int64)
        out[np.arange(width) < sizes[:, None]] = flat
        yield part, out


def sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Exact sums of every component."""
    total = [0] * width
    for batch in batches:
        for _, x in matrices(batch, width):
            # high and low halves of the integers have sums that cannot overflow
            high, low = (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)
            total = [t + (int(h) << 31) + int(n) for t, h, n in zip(total, high, low, strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(width), pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))],
        ["cell", "total"],
    )


def products(batches: Iterator[pa.RecordBatch], mean: np.ndarray, turn: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the products of turned, centred components."""
    k = turn.shape[1]
    total = np.zeros((k, k))
    for batch in batches:
        for _, x in matrices(batch, len(turn)):
            y = centred(x, mean) @ turn
            total += y.T @ y
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["cell", "total"])


def centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x minus ``mean`` (whole part and fraction): large numbers cancel as integers."""
    return (x - mean[0].astype(np.int64)).astype(float) - mean[1]


def collected(rows: DataFrame, size: int, zero) -> list:
    """Sums per cell: ``size`` numbers, bounded by the dimension."""
    out = [zero] * size
    for cell, value in rows.groupBy("cell").agg(F.sum("total")).collect():
        out[cell] = value
    return out


class Fit(NamedTuple):
    """What a row needs: the number of fitted vectors, exact sums, mean, spectrum."""

    n: int
    total: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    def whitener(self) -> np.ndarray:
        return self.vectors.T / np.sqrt(self.values)


def fit(rows: DataFrame, components: int) -> Fit:
    """Spectrum of the distinct vectors of ``rows`` (x), a stage table."""
    distinct = materialise(rows.select("x").distinct())
    n, width = distinct.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        none = np.zeros(0)
        return Fit(0, [], np.zeros((2, 0)), none, np.zeros((0, 0)), none, 0.0)
    total = [
        int(t)
        for t in collected(
            distinct.mapInArrow(partial(sums, width=width), "cell long, total decimal(38,0)"), width, 0
        )
    ]
    mean = np.array([[t // n for t in total], [t % n / n for t in total]])

    def covariance(turn: np.ndarray) -> np.ndarray:
        k = turn.shape[1]
        cells = distinct.mapInArrow(partial(products, mean=mean, turn=turn), "cell long, total double")
        return np.array(collected(cells, k * k, 0.0)).reshape(k, k) / n

    v = covariance(np.eye(width))
    v = (v + v.T) / 2
    values, vectors = leading(v, components)
    error = 0.0
    found = Fit(n, total, mean, values, vectors, values / np.trace(v) if len(values) else values, error)
    if len(values):
        error = float(np.abs(covariance(found.whitener()) - np.eye(len(values))).max())
    return found._replace(identity_error=error)


RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 per row, exactly; None beyond 64 bits."""
    s = np.array(total, object)
    away = x.astype(object) * n - s
    largest = max((abs(int(a)) for a in (away.min(), away.max())), default=0)
    if largest**2 * len(total) < 1 << 63:
        small = away.astype(np.int64)
        return (small * small).sum(axis=1).tolist()
    exact = (away * away).sum(axis=1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def project(batches: Iterator[pa.RecordBatch], found: Fit) -> Iterator[pa.RecordBatch]:
    turn, k = found.whitener(), len(found.values)
    for batch in batches:
        for part, x in matrices(batch, len(found.total)):
            white = centred(x, found.mean) @ turn
            rows = part.num_rows
            each = pa.array(np.repeat(np.arange(rows), k))
            deviation = pa.array(deviations(x, found.n, found.total), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, found.n)),
                    deviation.take(each),
                    pa.array(white.ravel()),
                    pa.array(np.tile(found.explained, rows)),
                    pa.array(np.full(rows * k, found.identity_error)),
                ],
                [c.split()[0] for c in RESULT.split(", ")],
            )


def whiten(vectors: DataFrame, id_col: str, vector_col: str, components: int) -> DataFrame:
    """One row per vector and component (from 1, up to ``components``): vec_id, component, n,
    deviation, whitened, explained, identity_error."""
    rows = materialise(integers(vectors, id_col, vector_col))
    found = fit(rows, components)
    if not len(found.values):
        return rows.sparkSession.createDataFrame([], RESULT)
    return rows.mapInArrow(partial(project, found=found), RESULT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their 16 leading components."""
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 16)
