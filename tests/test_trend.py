import numpy as np
import pytest

from diffspark.operators import posterior, trend
from diffspark.schema import pairwise_contrasts


def gamma_fit(x, y, steps=200):
    """Reweighted least squares for a gamma response with log link (all weights 1)."""
    beta = np.linalg.lstsq(x, np.log(y), rcond=None)[0]
    for _ in range(steps):
        mu = np.exp(x @ beta)
        beta = np.linalg.lstsq(x, x @ beta + (y - mu) / mu, rcond=None)[0]
    mu = np.exp(x @ beta)
    return beta, (((y - mu) / mu) ** 2).sum() / (len(y) - x.shape[1])


@pytest.fixture(scope="module")
def stats(spark):
    rng = np.random.default_rng(9)
    n = 1500
    mean = rng.uniform(8, 22, n)
    upper = rng.random(n) < 0.3
    sd = np.exp(1 - 0.15 * mean + upper * (0.8 + 0.02 * mean)) * rng.gamma(8, 1 / 8, n)
    rows = [(f"i{k}", float(a), float(b), "U" if u else "L") for k, (a, b, u) in enumerate(zip(mean, sd, upper))]
    rows += [("zero", 10.0, 0.0, "L"), ("none", 10.0, None, "U")]
    df = spark.createDataFrame(rows, "identifier string, mean double, sd double, c string").cache()
    return df, mean, sd, upper.astype(float)


@pytest.mark.parametrize("terms", ["mean", "mean+c", "mean*c"])
def test_gamma_regression(stats, terms):
    df, mean, sd, up = stats
    columns = [np.ones_like(mean), mean, up, up * mean][: {"mean": 2, "mean+c": 3, "mean*c": 4}[terms]]
    beta, dispersion = gamma_fit(np.column_stack(columns), sd)
    fit = trend.fit_gamma_trend(df, "sd", terms)
    assert list(fit[: len(beta)]) == pytest.approx(list(beta), abs=1e-7)
    assert fit.dispersion == pytest.approx(dispersion, rel=1e-7)


def test_log_trend(stats):
    df, mean, sd, _ = stats
    slope, intercept = np.polyfit(mean, np.log(sd), 1)
    fit = trend.fit_log_trend(df)
    assert (fit.intercept, fit.slope) == pytest.approx((intercept, slope))


def test_partition_finds_two_separate_trends(spark):
    rng = np.random.default_rng(10)
    n = 800
    mean = rng.uniform(8, 22, n)
    upper = rng.random(n) < 0.3
    sd = np.exp(-1 - 0.1 * mean + 2.0 * upper + rng.normal(0, 0.15, n))
    rows = [(f"i{k}", float(a), float(b), bool(u)) for k, (a, b, u) in enumerate(zip(mean, sd, upper))]
    df = spark.createDataFrame(rows, "identifier string, mean double, sd double, up boolean")
    result = trend.partition_trends(df, 3, 4, (0.05, 0.4), (0.05, 0.4))
    grid = result.grid.orderBy("rank").collect()
    assert len(grid) == 12
    assert [r.score for r in grid] == sorted((r.score for r in grid), reverse=True)
    labelled = result.labelled.toPandas()
    assert len(labelled) == n
    assert ((labelled.c == "U") == labelled.up).mean() > 0.99


def test_posterior_matches_fine_integral(spark):
    n, k, wss, w, level = 6, 2, 3.7, (1.4, 2.1), 12.0
    prior = trend.Trend(0.4, -0.03, dispersion=0.2)
    rows = [("i", {"A": (3, 12.5, 0.0, w[0], 12.4, wss / 2), "B": (3, 11.5, 0.0, w[1], 11.6, wss / 2)})]
    schema = (
        "identifier string, cells map<string, struct<n: long, mean: double, ss: double,"
        " w: double, wmean: double, wss: double>>"
    )
    profile = spark.createDataFrame(rows, schema)
    got = posterior.posterior_variance(profile, prior).first()
    s_hat = np.exp(0.4 - 0.03 * level)
    a, b = 1 / 0.2, 1 / 0.2 / s_hat
    ln_s = np.linspace(np.log(s_hat / 20), np.log(20 * s_hat), 200001)
    s = np.exp(ln_s)
    ln_w = (a - (n - k)) * ln_s - b * s - wss * s_hat**2 / (2 * s**2)
    weight = np.exp(ln_w - ln_w.max())
    want = (s**2 * weight).sum() / weight.sum()
    assert got["e_s2"] == pytest.approx(want, rel=1e-9)
    row = posterior.decision_error(profile, prior, pairwise_contrasts(["A", "B"])).first()
    inverse = (1 / w[0] + 1 / w[1]) / s_hat**2
    z = 0.8 / np.sqrt(want * inverse)
    assert row["z"] == pytest.approx(z, rel=1e-9)
    assert 0 < row["err"] < 1
