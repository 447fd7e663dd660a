"""Multiple imputation with one row per identifier, however many imputations there are.

What :mod:`impute`, :mod:`moderated` and :mod:`consensus` do row by row is done here on vectors
over the m imputations, for the numbers of imputations that studies run:

* The draws of a missing value are a function of its key. A profile lists its gaps; whoever needs
  their draws makes them in the task and keeps the sums of a cell. An identifier without gaps has
  single numbers and is never repeated.
* Imputations are done some at a time where all together would hold too many numbers (SLICE_VALUES):
  priors, p-values and rates of a slice are made before those of the next, and only p-values and
  rates are kept.
* The prior of all imputations is a matrix of sums per task. Order statistics (the robust prior)
  come from counts below shared cuts: every pass narrows a bracket per imputation.
* P-values are stored in blocks of identifiers. The false discovery rate cuts all blocks at
  shared cuts of the p-values, so one task holds one range of values of a comparison for all
  imputations; ranks start at the counts of lower ranges, and the least values of higher ranges
  close the running minimum. These tables have one number per comparison, range and imputation.
* A block gets its rates back and finds hits, medians and critical values row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffspark.functions import vectors
from diffspark.functions.special import (
    binomial_tail_table,
    np_trigamma_inverse,
    smallest_significant,
)
from diffspark.operators.impute import missing_with_centre
from diffspark.operators.moderated import WINSOR_TAILS
from diffspark.operators.moments import direct_profiles
from diffspark.operators.ordered import quantile_list
from diffspark.operators.trend import UPPER, Trend
from diffspark.schema import Contrast
from diffspark.stage import materialise, new_path, remove_stage, stage_scope, write_stage

# Blocks and ranges grow with the data, as every block has a piece in every range: beyond PIECES of
# both the pieces grow instead of their number, up to the bounds that a task holds.
PIECES = 256
RANGE_VALUES, MOST_VALUES = 1 << 18, 1 << 22  # p-values that a task ranks at a time, about
MOST_IN_BLOCK = 1 << 17  # p-values of a block, about
SLICE_VALUES = 1 << 26  # p-values of a slice of imputations, about
HELD = 200_000  # numbers that the driver takes to finish order statistics
CUTS = 32  # cuts of a bracket in a pass
PARTS = 64  # tasks that share a range of one single value


def draw_vectors(
    measurements: DataFrame,
    cells: DataFrame,
    trend: Trend,
    low: float,
    m: int,
    seed: int = 1,
    labels: DataFrame | None = None,
) -> DataFrame:
    """One row per missing value with its ``m`` draws, the same as those of
    :func:`impute.imputation_draws`; ``labels`` (identifier, c) adds the label."""
    missing = missing_with_centre(measurements, cells, low)
    if labels is None:
        missing = missing.withColumn("c", F.lit(None).cast("string"))
    else:
        missing = missing.join(labels.select("identifier", "c"), "identifier", "left")
    centre = F.col("_centre")
    centred = materialise(
        missing.select(
            "identifier", "condition", "replicate", centre.alias("centre"), trend.predict(centre).alias("spread"),
            F.lit(seed).cast("long").alias("seed"), "c",
        )
    )
    keys = ("identifier", "condition", "replicate", "centre", "spread", "seed")
    return centred.withColumn("draws", F.arrow_udf(vectors.drawer(m), vectors.DRAWN)(*keys))


def vector_profiles(
    measurements: DataFrame,
    draws: DataFrame,
    m: int,
    conditions: Sequence[str],
    weight: Trend | None = None,
    labelled: bool = False,
) -> DataFrame:
    """Per identifier the cells of its measured values, the gaps that ``draws`` fill and the
    coefficients of the weight, as a stage table.

    ``measurements`` has the label ``c`` if the weight depends on it. The draws themselves, ``m`` for
    a gap, are made again where they are summed, as they are many times their keys.
    """
    label = F.col("c") if labelled else None
    column = None if weight is None else weight.precision_weight(F.col("y"), label)
    observed = direct_profiles(measurements, conditions, weight=column)
    upper = F.coalesce(F.col("c") == UPPER, F.lit(False)) if labelled else F.lit(False)
    gap = F.struct("condition", "replicate", "centre", "spread", "seed", upper.alias("upper"))
    gaps = draws.groupBy("identifier").agg(F.sort_array(F.collect_list(gap)).alias("gaps"))
    joined = observed.select("identifier", "cells").join(gaps, "identifier", "full")
    numbers = F.array(*[F.lit(float(x)) for x in weight[:4]]) if weight else F.lit(None).cast("array<double>")
    # the work is in the vectors that come of a row, not in its bytes: all tasks get rows
    parts = int(measurements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(joined.withColumn("weight", numbers).repartition(parts, "identifier"))


def order_statistics(residuals: DataFrame, m: int, probs: Sequence[float]) -> np.ndarray:
    """Exact quantiles (linearly interpolated) of ``e`` of every imputation: (probs, m).

    Brackets of two ranks per quantile and imputation are cut in CUTS parts per pass, until
    the numbers inside them are few enough for the driver, or equal.
    """
    spans = residuals.mapInArrow(partial(vectors.ranges, m=m), "imputation int, n long, low double, high double")
    spans = spans.groupBy("imputation").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    n, low, high = np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
    for r in spans.collect():  # m rows
        n[r["imputation"]], low[r["imputation"]], high[r["imputation"]] = r["n"], r["low"], r["high"]
    position = np.multiply.outer(np.asarray(probs, float), np.maximum(n - 1, 0))
    wanted = np.concatenate([np.floor(position), np.ceil(position)]).astype(np.int64)  # ranks from 0
    targets = len(wanted)
    low, high = np.tile(low, (targets, 1)), np.nextafter(np.tile(high, (targets, 1)), np.inf)
    before, inside = np.zeros_like(wanted), np.tile(n, (targets, 1))
    while True:
        open_ = (np.nextafter(low, np.inf) < high) & (inside > 0)
        if inside[open_].sum() <= HELD or not open_.any():
            break
        shares = np.arange(1, CUTS)[:, None] / CUTS
        cuts = low[:, None] + shares * (high - low)[:, None]
        cuts = np.clip(cuts, low[:, None], high[:, None])
        middle = CUTS // 2 - 1  # also by bits, so that brackets of very uneven numbers shrink
        cuts[:, middle] = np.clip(_between(low, high), cuts[:, middle - 1], cuts[:, middle + 1])
        counted = residuals.mapInArrow(partial(vectors.below_cuts, m=m, cuts=cuts), "cell int, n long")
        table = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # targets * CUTS * m rows
        below = np.zeros(cuts.size, np.int64)
        below[table.column("cell").to_numpy()] = table.column("n").to_numpy()
        below = below.reshape(cuts.shape)
        edge = np.concatenate([low[:, None], cuts, high[:, None]], axis=1)
        under = np.concatenate([before[:, None], below, (before + inside)[:, None]], axis=1)
        k = (under[:, 1:-1] <= wanted[:, None]).sum(axis=1)[:, None]
        low, high = (np.take_along_axis(edge, k + d, 1)[:, 0] for d in (0, 1))
        before, after = (np.take_along_axis(under, k + d, 1)[:, 0] for d in (0, 1))
        inside = after - before
    found = low.copy()
    if open_.any():
        sought = np.where(open_, low, np.inf), np.where(open_, high, -np.inf)
        held = residuals.mapInArrow(
            partial(vectors.between, m=m, low=sought[0], high=sought[1]), "target int, imputation int, e double"
        ).toArrow()  # HELD rows at most
        target, imputation, e = (held.column(c).to_numpy() for c in ("target", "imputation", "e"))
        order = np.lexsort((e, target * m + imputation))
        cell, e = (target * m + imputation)[order], e[order]
        start = np.searchsorted(cell, np.arange(targets * m)).reshape(targets, m)
        at = np.where(open_, start + wanted - before, 0)
        found = np.where(open_, e[at], found)
    below, above = np.split(found, 2)
    return below + (above - below) * (position - np.floor(position))


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The double half way between two doubles in their order."""

    def rank(x: np.ndarray) -> np.ndarray:
        bits = x.view(np.int64)
        return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)

    a, b = rank(np.ascontiguousarray(low)), rank(np.ascontiguousarray(high))
    middle = (a >> 1) + (b >> 1) + (a & b & 1)
    return np.where(middle < 0, np.int64(-(2**63)) - middle, middle).view(float)


SPLINE = "spline"
#: Shares of identifiers at the knots of the spline.
KNOTS = (0.0, 1 / 3, 2 / 3, 1.0)


def prior_basis(residuals: DataFrame, trend: bool | str) -> vectors.Basis:
    """Basis of a trend: False for a constant, True for a parabola, SPLINE for a natural spline
    with knots at exact quantiles of the levels (of the first imputation); levels that leave
    fewer than three different knots have a line or a constant."""
    if not trend:
        return vectors.Basis(0)
    if trend != SPLINE:
        return vectors.Basis(2, float(residuals.agg(F.avg("first_level")).first()[0] or 0.0))
    found = np.array(quantile_list(residuals.select("first_level"), "first_level", KNOTS))
    knots = np.unique(found[~np.isnan(found)])
    if len(knots) < 3:
        return vectors.Basis(max(0, len(knots) - 1), float(knots[0]) if len(knots) else 0.0)
    return vectors.Basis(3, knots=tuple(float(k) for k in knots))


def vector_prior(
    residuals: DataFrame, m: int, trend: bool | str, robust: bool, basis: vectors.Basis | None = None
) -> vectors.Prior:
    """Prior of every imputation, see :func:`moderated.variance_prior` and :func:`prior_basis`
    (``basis``, if it is known); ``residuals`` is a stage table."""
    basis = basis or prior_basis(residuals, trend)
    low, high = np.full(m, -np.inf), np.full(m, np.inf)
    if robust:
        low, high = order_statistics(residuals, m, (WINSOR_TAILS[0], 1 - WINSOR_TAILS[1]))
    names = basis.sums()
    schema = "imputation int, " + ", ".join(f"{c} double" for c in names)
    summed = residuals.mapInArrow(partial(vectors.fit_sums, m=m, basis=basis, low=low, high=high), schema)
    s = {c: np.zeros(m) for c in names}
    for r in summed.groupBy("imputation").agg(*[F.sum(c).alias(c) for c in names]).collect():  # m rows
        for c in names:
            s[c][r["imputation"]] = r[c]
    k = basis.size()
    left = np.empty((m, k, k))
    for i in range(k):
        for j in range(i + 1):
            left[:, i, j] = left[:, j, i] = s[f"b{i}{j}"]
    right = np.stack([s[f"e{i}"] for i in range(k)], axis=1)
    b = np.einsum("kij,kj->ki", np.linalg.pinv(left, rcond=1e-14, hermitian=True), right).T
    rss = s["ee"] - (b * right.T).sum(axis=0)
    n = s["b00"]
    free = n - k
    excess = np.where(free > 0, rss / np.where(free > 0, free, 1.0) - s["tri"] / np.maximum(n, 1.0), 0.0)
    x, ok = np_trigamma_inverse(excess)
    return vectors.Prior(np.where(ok, 2 * x, np.inf), b, basis)


def vector_tests(
    profiles: DataFrame,
    contrasts: Sequence[Contrast],
    m: int,
    trend: bool | str = False,
    weighted: bool = False,
    robust: bool = False,
) -> DataFrame:
    """Moderated tests of all imputations: blocks of identifiers (comparison, block, identifiers,
    p, median_lfc, slice) as a stage table with a folder for each slice of the imputations. Medians
    are those of all imputations and come with the first slice. All slices read the same files, and
    so have the same blocks."""
    spark = profiles.sparkSession
    n = profiles.count()
    slices = min(m, 1 + n * len(contrasts) * m // SLICE_VALUES)
    edges = slice_edges(m, slices)
    wanted = [(c.comparison, c.cond_a, c.cond_b) for c in contrasts]
    rows = max(vectors.ROWS, min(n // PIECES, MOST_IN_BLOCK * slices // m))
    path, basis = new_path(spark), None
    for k in range(slices):
        some = vectors.Range(*edges[k : k + 2])
        with stage_scope(spark):
            residuals = materialise(
                profiles.mapInArrow(partial(vectors.residuals, some=some, weighted=weighted), vectors.RESIDUALS)
            )
            basis = basis or prior_basis(residuals, trend)
            prior = vector_prior(residuals, some.size(), trend, robust, basis)
        kernel = partial(
            vectors.tests, some=some, m=m, weighted=weighted, prior=prior, contrasts=wanted, rows=rows
        )
        write_stage(profiles.mapInArrow(kernel, vectors.BLOCKS), f"{path}/slice={k}")
    found = spark.read.schema(f"{vectors.BLOCKS}, slice int").parquet(path)
    found.stage_path = path
    return found


def slice_edges(m: int, slices: int) -> list[int]:
    """The imputations at which slices begin, and ``m``."""
    return [m * k // slices for k in range(slices + 1)]


def sliced(tests: DataFrame, m: int) -> tuple[DataFrame, list[int]]:
    """Tests with their slices, and the edges of these; tests without slices have one."""
    if "slice" not in tests.columns:
        return tests.withColumn("slice", F.lit(0)), [0, m]
    last = tests.agg(F.max("slice")).first()[0]
    return tests, slice_edges(m, (last or 0) + 1)


def first_p_values(tests: DataFrame, m: int, comparison: str | None = None) -> DataFrame:
    """P-values of the first imputation (p_val), of one comparison or all."""
    tests, edges = sliced(tests, m)
    some = tests.where("slice = 0")
    if comparison is not None:
        some = some.where(F.col("comparison") == comparison)
    return some.select("p").mapInArrow(partial(vectors.first_values, m=edges[1]), "p_val double")


def vector_thresholds(tests: DataFrame, m: int, first_comparison: str) -> DataFrame:
    """As :func:`consensus.consensus_thresholds`."""
    first = first_p_values(tests, m, first_comparison)
    return first.select(F.explode(F.array("p_val", F.lit(1.0))).alias("alpha")).distinct()


def shared_cuts(tests: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of the p-values of a slice into ranges of about RANGE_VALUES, and which ranges hold one
    single value. They come from the first imputation; a value that fills a whole range has one to itself."""
    first = first_p_values(tests, m)
    comparisons = tests.select("comparison").distinct().count()
    edges = sliced(tests, m)[1]
    values = first.count() * -(-m // (len(edges) - 1)) // max(1, comparisons)
    ranges = max(1, -(-values // max(RANGE_VALUES, min(values // PIECES, MOST_VALUES))))
    if ranges == 1:
        return np.zeros(0), np.zeros(1, bool)
    shares = [k / ranges for k in range(1, ranges)]
    found = np.array(first.agg(F.percentile_approx("p_val", shares, 100 * ranges)).first()[0], float)
    repeated = np.unique(found[1:][np.diff(found) == 0])
    own = set(repeated.tolist())
    cuts = np.unique(np.concatenate([found, repeated, np.nextafter(repeated, np.inf)]))
    flat = np.array([False, *(c in own for c in cuts.tolist())])
    return cuts, flat


def adjusted_pieces(
    tests: DataFrame, m: int, cuts: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """False discovery rates within (comparison, imputation) of one slice of ``m`` imputations, or
    of all: (comparison, block, place, q), the place being row * m + imputation of the block."""
    cuts, flat = cuts or shared_cuts(tests, m)
    counted = tests.select("comparison", "p").mapInArrow(
        partial(vectors.bucket_counts, m=m, cuts=cuts), "comparison string, bucket int, imputation int, n long"
    )
    lists = Window.partitionBy("comparison", "imputation")
    lower = lists.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = ("imputation", "before", "n", "size")
    placed = (
        counted.groupBy("comparison", "bucket", "imputation")
        .agg(F.sum("n").alias("n"))
        .withColumns({"before": F.coalesce(F.sum("n").over(lower), F.lit(0)), "size": F.sum("n").over(lists)})
        .groupBy("comparison", "bucket")
        .agg(F.collect_list(F.struct(*names)).alias("v"))
        .select("comparison", "bucket", *[F.col(f"v.{c}").alias(c) for c in names])
    )
    flats = F.array(*[F.lit(int(k)) for k in np.flatnonzero(flat)]) if flat.any() else F.array().cast("array<int>")
    parts = F.when(F.array_contains(flats, F.col("bucket")), F.sequence(F.lit(0), F.lit(PARTS - 1)))
    sizes = materialise(placed).withColumn("part", F.explode(F.coalesce(parts, F.array(F.lit(0)))))
    pieces = tests.select("comparison", "block", "p").mapInArrow(
        partial(vectors.deal, cuts=cuts, flat=flat, parts=PARTS), vectors.PIECES
    )
    keys = ("comparison", "bucket", "part")
    ranked = materialise(
        pieces.groupBy(*keys)
        .cogroup(sizes.groupBy(*keys))
        .applyInArrow(partial(vectors.rank, m=m, flat=flat), vectors.RANKED)
    )
    least = ranked.where(F.col("block") == vectors.LEAST).select("comparison", "bucket", "low")
    rows = least.mapInArrow(vectors.least_rows, "comparison string, bucket int, imputation int, low double")
    higher = lists.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    tails = (
        rows.groupBy("comparison", "bucket", "imputation")
        .agg(F.min("low").alias("low"))
        .withColumn("tail", F.min("low").over(higher))
        .where("tail is not null")
        .groupBy("comparison", "bucket")
        .agg(F.collect_list(F.struct("imputation", "tail")).alias("v"))
        .select("comparison", "bucket", F.col("v.imputation").alias("imputation"), F.col("v.tail").alias("tail"))
    )
    return (
        ranked.where(F.col("block") != vectors.LEAST)
        .join(materialise(tails), ["comparison", "bucket"], "left")
        .mapInArrow(partial(vectors.adjusted, m=m), "comparison string, block long, place binary, q binary")
    )


def vector_consensus(
    tests: DataFrame, m: int, alpha: float = 0.05, level: float = 0.05, last: bool = False
) -> DataFrame:
    """As :func:`consensus.consensus_table`, from blocks of :func:`vector_tests`. If this is the
    ``last`` use of the tests, their p-values are removed as soon as their rates are known."""
    need = smallest_significant(m, level)
    if need is None:
        raise ValueError(f"{m} imputations can never be significant at {level}")
    spark = tests.sparkSession
    path = new_path(spark)
    own = getattr(tests, "stage_path", None) if last else None
    tests, edges = sliced(tests, m)
    slices = len(edges) - 1
    with stage_scope(spark):
        cuts = shared_cuts(tests, m)
        if slices == 1:
            kernel = partial(vectors.agreement, m=m, alpha=alpha, need=need)
            write_stage(_with_rates(tests, m, cuts, kernel, vectors.AGREED), f"{path}/share=0")
        else:
            rates = _staged_rates(tests, edges, cuts, own)
            kernel = vectors.agreement_of_parts(alpha, need)
            for k in range(slices):
                some = rates.where(F.col("share") == k).groupBy(*BLOCK_KEYS)
                write_stage(some.applyInArrow(kernel, vectors.AGREED), f"{path}/share={k}")
    if own:
        remove_stage(spark, own)
    agreed = spark.read.schema(f"{vectors.AGREED}, share int").parquet(path)
    tail = F.broadcast(binomial_tail_table(spark, m))  # m + 1 rows
    return agreed.join(tail, "hits").select(
        "identifier", "comparison", "hits", "binom_p_value", "median_p_val", "median_lfc", "critical"
    )


BLOCK_KEYS = ("comparison", "block")


def _with_rates(tests: DataFrame, m: int, cuts: tuple[np.ndarray, np.ndarray], kernel, schema: str) -> DataFrame:
    """Blocks of a slice with their rates."""
    named = tests.select(*BLOCK_KEYS, "identifiers", "median_lfc").groupBy(*BLOCK_KEYS)
    return named.cogroup(adjusted_pieces(tests, m, cuts).groupBy(*BLOCK_KEYS)).applyInArrow(kernel, schema)


def _staged_rates(tests: DataFrame, edges: list[int], cuts: tuple[np.ndarray, np.ndarray], own: str | None) -> DataFrame:
    """Rates of all slices, dealt by block to as many shares as there are slices, so that a share is no
    larger than a slice. Those of a slice are complete before the next is read; under ``own``
    its p-values are removed then."""
    spark = tests.sparkSession
    path, slices = new_path(spark), len(edges) - 1
    share = F.pmod(F.xxhash64(*BLOCK_KEYS), F.lit(slices)).cast("int")
    for k in range(slices):
        size = edges[k + 1] - edges[k]
        with stage_scope(spark):
            kernel = partial(vectors.block_rates, m=size)
            found = _with_rates(tests.where(F.col("slice") == k), size, cuts, kernel, vectors.RATES)
            write_stage(found.withColumn("share", share), f"{path}/slice={k}", ["share"])
        if own:
            remove_stage(spark, f"{own}/slice={k}")
    return spark.read.schema(f"{vectors.RATES}, slice int, share int").parquet(path)
