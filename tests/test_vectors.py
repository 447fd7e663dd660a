"""Vector imputation against the row by row path and brute force."""

import os

import numpy as np
import pytest

from diffspark.functions import vectors as kernels
from diffspark.operators import consensus, moderated, vectors
from diffspark.operators.moments import cell_moments
from diffspark.plans import catalog
from diffspark.plans.views import COMPARISONS, CONTRASTS
from diffspark.stage import materialise, stage_root


@pytest.fixture(scope="module")
def gaps(spark, small):
    return catalog.Missing(spark, small)


def by_pair(table):
    return {(r["identifier"], r["comparison"]): r for r in table.collect()}


def row_by_row(gaps, m, weighted, **options):
    rows = materialise(moderated.residual_variance(gaps.profiles(m, weighted, expand=False), weighted))
    return materialise(moderated.moderated_t(rows, CONTRASTS, weighted=weighted, m=m, **options))


@pytest.mark.parametrize(
    "m, weighted, options",
    [
        (20, False, {}),
        (20, False, {"trend": True, "robust": True}),
        (50, True, {"trend": True}),
        (200, True, {"trend": True, "robust": True}),
    ],
)
def test_same_as_row_by_row(gaps, m, weighted, options, monkeypatch):
    monkeypatch.setattr(vectors, "RANGE_VALUES", 20_000)
    results = row_by_row(gaps, m, weighted, **options)
    want = by_pair(consensus.consensus_table(consensus.adjust_within_imputation(results), m))
    tests = gaps.tests(m, weighted, **options)
    got = by_pair(vectors.vector_consensus(tests, m))
    assert got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert g["hits"] == w["hits"] and g["binom_p_value"] == pytest.approx(w["binom_p_value"])
        for name in ("median_p_val", "median_lfc", "critical"):
            assert g[name] == pytest.approx(w[name], rel=1e-7, abs=1e-10), (key, name)
    alphas = sorted(r[0] for r in vectors.vector_thresholds(tests, m, COMPARISONS[0]).collect())
    wanted = sorted(r[0] for r in consensus.consensus_thresholds(results, COMPARISONS[0]).collect())
    assert alphas == pytest.approx(wanted, rel=1e-8, abs=1e-13)


def blocks(spark, p):
    """Blocks of 16 rows of a matrix of p-values, for two comparisons."""
    rows = []
    for k, comparison in enumerate(("a vs b", "a vs c")):
        q = p if k == 0 else np.sqrt(p)
        for at in range(0, len(q), 16):
            part = q[at : at + 16]
            names = [f"i{at + i}" for i in range(len(part))]
            rows.append((comparison, at // 16, names, bytearray(kernels.pack(part)), [1.0] * len(part)))
    return materialise(spark.createDataFrame(rows, kernels.BLOCKS).repartition(3))


def brute_rates(p):
    out = np.full_like(p, np.nan)
    for i in range(p.shape[1]):
        at = np.flatnonzero(~np.isnan(p[:, i]))
        order = at[np.argsort(p[at, i])]
        raw = len(at) / np.arange(1, len(at) + 1) * p[order, i]
        out[order, i] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    return out


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_rates_over_shared_ranges(spark, ranges, monkeypatch):
    """Ties, missing values, and one value that a third of all rows share."""
    rng = np.random.default_rng(3)
    p = rng.random((300, 9)) ** 3
    p[rng.random(p.shape) < 0.05] = np.nan
    p[::3] = 0.125
    p[5] = p[6]
    p[:, 4] = np.nan
    monkeypatch.setattr(vectors, "RANGE_VALUES", -(-p.size // ranges))
    monkeypatch.setattr(vectors, "PARTS", 3)
    tests = blocks(spark, p)
    if ranges > 7:
        assert vectors.shared_cuts(tests, 9)[1].any()
    found = np.full((2, *p.shape), np.nan)
    for r in vectors.adjusted_pieces(tests, 9).collect():
        place = np.frombuffer(r["place"], np.int32) + r["block"] * 16 * 9
        found[int(r["comparison"] == "a vs c")].ravel()[place] = kernels.unpack(r["q"])
    for got, want in zip(found, (brute_rates(p), brute_rates(np.sqrt(p))), strict=True):
        assert np.allclose(got, want, rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("held", [1, 500, 10**6])
def test_order_statistics(spark, held, monkeypatch):
    monkeypatch.setattr(vectors, "HELD", held)
    rng = np.random.default_rng(4)
    e = rng.normal(size=(120, 6)) * 10.0 ** rng.integers(-6, 6, (120, 6))
    e[::3] = 2.5
    e[rng.random(e.shape) < 0.1] = np.nan
    e[:, 3] = np.nan
    e[7, 3] = -4.0
    e[:, 5] = 1.0
    rows = [(bytearray(kernels.pack(v)), bytearray(kernels.pack(v)), 0.0, 1.0) for v in e]
    rows += [(bytearray(kernels.pack([0.25])), bytearray(kernels.pack([0.25])), 0.0, 1.0)]
    df = materialise(spark.createDataFrame(rows, kernels.RESIDUALS).repartition(3))
    got = vectors.order_statistics(df, 6, (0.05, 0.9))
    full = np.vstack([e, np.full(6, 0.25)])
    for i in range(6):
        some = full[~np.isnan(full[:, i]), i]
        assert got[:, i] == pytest.approx(np.quantile(some, [0.05, 0.9]), rel=1e-12, abs=1e-15), i


def residual_rows(spark, e, level, tri):
    rows = [
        (bytearray(kernels.pack(a)), bytearray(kernels.pack(b)), float(b[0]), float(t))
        for a, b, t in zip(e, level, tri, strict=True)
    ]
    return materialise(spark.createDataFrame(rows, kernels.RESIDUALS).repartition(3))


def test_spline_prior(spark):
    """Natural spline on quantile knots against least squares over truncated cubes."""
    rng = np.random.default_rng(5)
    n, m = 200, 3
    level = rng.uniform(8, 22, (n, m)) * np.array([1.0, 1.01, 0.98])
    e = np.sin(level / 3) + rng.normal(0, 0.7, (n, m))
    e[rng.random((n, m)) < 0.1] = np.nan
    tri = rng.uniform(0.05, 0.2, n)
    prior = vectors.vector_prior(residual_rows(spark, e, level, tri), m, vectors.SPLINE, False)
    knots = np.quantile(level[:, 0], vectors.KNOTS)
    assert prior.basis.knots == pytest.approx(tuple(knots))
    cube = lambda x, k: np.maximum(x - k, 0.0) ** 3
    for i in range(m):
        ok = ~np.isnan(e[:, i])
        x, y = level[ok, i], e[ok, i]
        # cubic splines with these knots whose cubic and square terms vanish beyond the last one
        free = np.column_stack([np.ones_like(x), x, *(cube(x, k) for k in knots)])
        bound = np.array([np.ones(4), knots])  # sums of coefficients, and of coefficients times knots
        null = np.linalg.svd(bound)[2][2:].T
        natural = np.column_stack([free[:, :2], free[:, 2:] @ null])
        fitted = natural @ np.linalg.lstsq(natural, y, rcond=None)[0]
        mine = sum(c * f for c, f in zip(prior.coefficients[:, i], prior.basis.at(x), strict=True))
        assert np.allclose(mine, fitted, atol=1e-7)
        excess = ((y - fitted) ** 2).sum() / (len(y) - 4) - tri[ok].mean()
        assert kernels.np_trigamma(prior.d0[i] / 2) == pytest.approx(excess, rel=1e-6)


@pytest.mark.parametrize("levels, size", [([5.0] * 9, 1), ([5.0] * 8 + [6.0], 2), ([], 1)])
def test_spline_of_few_levels(spark, levels, size):
    """Levels that leave too few knots have a line or a constant, no levels an infinite prior."""
    e = [[0.1 * k, 0.2 * k] for k in range(len(levels))]
    df = residual_rows(spark, e, [[v, v] for v in levels], [0.1] * len(levels)) if levels else materialise(
        spark.createDataFrame([], kernels.RESIDUALS)
    )
    prior = vectors.vector_prior(df, 2, vectors.SPLINE, False)
    assert len(prior.coefficients) == size and np.isfinite(prior.coefficients).all()
    assert levels or np.isinf(prior.d0).all()


def test_no_gaps_and_nothing(spark, gaps):
    """Identifiers without gaps stay one number; conditions without values give no test."""
    rows = spark.createDataFrame(
        [(f"i{k}", c, r, float(k + r + (c == "A"))) for k in range(8) for c in "AN" for r in (1, 2, 3)]
        + [("lonely", "A", 1, 2.0)],
        "identifier string, condition string, replicate long, y double",
    )
    draws = vectors.draw_vectors(rows, materialise(cell_moments(rows)), gaps.trend, 0.0, 20)
    assert draws.count() == 0
    profiles = vectors.vector_profiles(rows, draws, 20, ["A", "N", "R"])
    tests = vectors.vector_tests(profiles, CONTRASTS, 20)
    table = by_pair(vectors.vector_consensus(tests, 20))
    assert len(table) == 9 * 3
    assert table["i3", "A vs N"]["median_lfc"] == pytest.approx(1.0)
    assert table["i3", "A vs N"]["median_p_val"] is not None
    assert table["lonely", "A vs N"]["median_p_val"] is None and table["lonely", "A vs N"]["hits"] == 0


def test_blocks_of_several_slices(spark, gaps, monkeypatch):
    """Larger blocks hold the same tests, and draws are those of the rows."""
    monkeypatch.setattr(vectors, "PIECES", 1)
    monkeypatch.setattr(kernels, "ROWS", 16)
    large = gaps.tests(20, trend=True)
    assert max(len(r.identifiers) for r in large.collect()) > 16
    rows = consensus.consensus_table(consensus.adjust_within_imputation(row_by_row(gaps, 20, False, trend=True)), 20)
    want, got = by_pair(rows), by_pair(vectors.vector_consensus(large, 20))
    assert got.keys() == want.keys()
    assert all(got[k]["critical"] == pytest.approx(w["critical"], rel=1e-9) for k, w in want.items())
    mine = vectors.draw_vectors(gaps.rows, gaps.cells, gaps.trend, gaps.low, 20)
    mine = sorted(x for r in mine.collect() for x in r.draws)
    assert mine == pytest.approx(sorted(r.y for r in gaps.draws(20).collect()), rel=1e-13)


@pytest.mark.parametrize("trend, robust", [(True, True), (vectors.SPLINE, False)])
def test_slices_of_imputations_change_nothing(gaps, trend, robust, monkeypatch):
    """Imputations done some at a time have the same priors, rates and medians as all at once."""
    monkeypatch.setattr(vectors, "RANGE_VALUES", 2_000)
    options = {"weighted": True, "trend": trend, "robust": robust}
    whole = by_pair(vectors.vector_consensus(gaps.tests(23, **options), 23))
    monkeypatch.setattr(vectors, "SLICE_VALUES", 3_000)
    tests = gaps.tests(23, **options)
    assert tests.select("slice").distinct().count() > 4
    alphas = vectors.vector_thresholds(tests, 23, COMPARISONS[0]).count()
    got = by_pair(vectors.vector_consensus(tests, 23, last=True))
    assert alphas > 100 and got.keys() == whole.keys()
    for key, w in whole.items():
        assert got[key]["hits"] == w["hits"]
        for name in ("median_p_val", "median_lfc", "critical"):
            assert got[key][name] == pytest.approx(w[name], rel=1e-9, abs=1e-12), (key, name)


def test_neither_draws_nor_p_values_stay(spark, gaps):
    """Of a finished consensus only the pairs stay on disk; draws are never written."""
    root = stage_root(spark).removeprefix("file:")

    def held():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)

    m, before = 400, held()
    n = gaps.cells.agg({"gaps": "sum"}).first()[0]
    tests = gaps.tests(m, weighted=True, trend=True)
    pairs = tests.selectExpr("sum(octet_length(p))").first()[0]
    assert held() - before < 1.1 * pairs + n * m * 4
    vectors.vector_consensus(tests, m, last=True)
    assert held() - before < n * m * 4 < pairs
