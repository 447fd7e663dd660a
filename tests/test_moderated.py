import numpy as np
import pytest

from diffspark.operators import moderated, moments, ttest
from diffspark.schema import pairwise_contrasts

CONTRASTS = pairwise_contrasts(["A", "B"])


def simulate(spark, d0, s02, n=3000, slope=0.0, seed=1):
    """Residual variances drawn from the scaled inverse chi-square prior."""
    rng = np.random.default_rng(seed)
    level = rng.uniform(8, 20, n)
    prior = s02 * np.exp(slope * (level - 14))
    var = prior * d0 / rng.chisquare(d0, n)
    s2 = var * rng.chisquare(4, n) / 4
    rows = [(0, float(a), 4.0, float(b)) for a, b in zip(level, s2)]
    return spark.createDataFrame(rows, "imputation int, level double, df double, s2 double")


def test_prior_is_recovered(spark):
    prior = moderated.variance_prior(simulate(spark, 6.0, 0.3, 20000), ["imputation"])
    shrunk = moderated.shrink(simulate(spark, 6.0, 0.3, 10), prior, ["imputation"]).first()
    assert shrunk["d0"] == pytest.approx(6.0, rel=0.15)
    assert shrunk["s02"] == pytest.approx(0.3, rel=0.05)
    assert shrunk["df_total"] == pytest.approx(shrunk["d0"] + 4)


def test_trend_is_recovered(spark):
    rows = simulate(spark, 8.0, 0.3, 20000, slope=-0.2)
    prior = moderated.variance_prior(rows, ["imputation"], trend=True).first()
    assert prior["b1"] == pytest.approx(-0.2, abs=0.02)
    assert prior["b2"] == pytest.approx(0.0, abs=0.01)
    assert prior["d0"] == pytest.approx(8.0, rel=0.25)


def test_constant_variance_gives_infinite_prior(spark):
    rows = simulate(spark, 1e9, 0.5, 4000, seed=3)
    prior = moderated.variance_prior(rows, ["imputation"]).first()
    assert prior["d0"] > 50


def test_robust_prior_ignores_outliers(spark):
    from pyspark.sql import functions as F

    rows = simulate(spark, 10.0, 0.3, 5000)
    dirty = rows.withColumn("s2", F.when(F.rand(1) < 0.03, F.col("s2") * 1e4).otherwise(F.col("s2")))
    plain = moderated.variance_prior(dirty, ["imputation"]).first()["d0"]
    robust = moderated.variance_prior(dirty, ["imputation"], robust=True).first()["d0"]
    assert robust > plain


def test_moderated_t_is_the_t_test_with_a_shrunk_variance(spark):
    rng = np.random.default_rng(8)
    sds = np.exp(rng.normal(0, 0.5, 200))
    rows = [
        (f"i{i}", c, r, float(rng.normal(10, sds[i]))) for i in range(200) for c in "AB" for r in range(3)
    ]
    df = spark.createDataFrame(rows, "identifier string, condition string, replicate int, y double")
    profile = moments.profiles(moments.cell_moments(df)).selectExpr("0 as imputation", "*")
    by_id = lambda d: d.toPandas().set_index("identifier").sort_index()
    mod = by_id(moderated.moderated_t(profile, CONTRASTS))
    plain = by_id(ttest.t_statistics(profile, CONTRASTS))
    rows = moderated.residual_variance(profile)
    shrunk = by_id(moderated.shrink(rows, moderated.variance_prior(rows, ["imputation"]), ["imputation"]))
    post = (shrunk.d0 * shrunk.s02 + 4 * shrunk.s2) / (shrunk.d0 + 4)
    assert np.allclose(mod.t, plain.t * np.sqrt(shrunk.s2 / post))
    assert np.allclose(mod.df_total, shrunk.d0 + 4)
    assert np.allclose(mod.lfc, plain.lfc)
    assert post.std() < shrunk.s2.std()
