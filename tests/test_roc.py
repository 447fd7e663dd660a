import numpy as np
import pandas as pd
import pytest

from diffspark.operators import roc

GOLDEN = [(0.01, True), (0.02, False), (0.02, True), (0.5, False)]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [("c", f"i{k}", p, t) for k, (p, t) in enumerate(GOLDEN)]
    return spark.createDataFrame(
        rows, "comparison string, identifier string, score double, truth boolean"
    )


def cells(df):
    return {r.alpha: (r.TP, r.TN, r.FP, r.FN) for r in df.collect()}


def test_strict_golden(golden):
    assert cells(roc.confusion(golden)) == {
        0.01: (0, 2, 0, 1),
        0.02: (1, 1, 0, 0),
        0.5: (2, 0, 1, 0),
        1.1: (2, 0, 2, 0),
    }


def test_inclusive_golden(golden):
    assert cells(roc.confusion(golden, mode=roc.INCLUSIVE)) == {
        -0.1: (0, 2, 0, 2),
        0.01: (1, 2, 0, 2),
        0.02: (2, 2, 1, 1),
        0.5: (2, 1, 2, 0),
    }


@pytest.mark.parametrize("mode", [roc.STRICT, roc.INCLUSIVE])
def test_area_golden(golden, mode):
    assert roc.auroc(roc.roc(golden, mode=mode)).first()["auROC"] == pytest.approx(0.875)


def test_area_from_scores_golden(golden):
    assert roc.auroc_of_scores(golden).first()["auROC"] == pytest.approx(0.875)


@pytest.fixture(scope="module")
def random_scores(spark):
    rng = np.random.default_rng(2)
    n = 1500
    pdf = pd.DataFrame(
        {
            "comparison": np.where(rng.random(n) < 0.5, "big", rng.choice(["x", "y"], n)),
            "identifier": [f"i{k % 700}" for k in range(n)],
            "score": np.where(rng.random(n) < 0.35, 0.25, rng.integers(0, 300, n) / 300),
            "truth": [k % 700 % 3 == 0 for k in range(n)],
        }
    )
    pdf.loc[::17, "score"] = np.nan
    df = spark.createDataFrame(
        [(a, b, None if np.isnan(c) else float(c), bool(d)) for a, b, c, d in pdf.itertuples(index=False)],
        "comparison string, identifier string, score double, truth boolean",
    )
    return pdf, df


@pytest.mark.parametrize("mode", [roc.STRICT, roc.INCLUSIVE])
@pytest.mark.parametrize("scope", ["group", "global"])
def test_brute_force(random_scores, mode, scope):
    pdf, df = random_scores
    got = roc.roc(df, mode=mode, pn_scope=scope).toPandas()
    ids = pdf.drop_duplicates("identifier")
    for comparison, rows in pdf.groupby("comparison"):
        mine = got[got.comparison == comparison].set_index("alpha")
        s, t = rows.score.to_numpy(), rows.truth.to_numpy()
        alphas = set(s[~np.isnan(s)]) | set(roc.SENTINELS[(mode, scope)])
        assert set(mine.index) == alphas
        base = rows if scope == "group" else ids
        p, n = base.truth.sum(), (~base.truth).sum()
        for a in alphas:
            below, above = (s < a, s > a) if mode == roc.STRICT else (s <= a, s >= a)
            want = (below & t).sum(), (above & ~t).sum(), (below & ~t).sum(), (above & t).sum()
            row = mine.loc[a]
            assert (row.TP, row.TN, row.FP, row.FN) == want
            assert row.TPR == pytest.approx(want[0] / p)
            assert row.FPR == pytest.approx(want[2] / n)


def test_rates_are_monotone_and_mirror(random_scores, spark):
    from pyspark.sql import functions as F

    _, df = random_scores
    table = roc.roc(df).toPandas().sort_values(["comparison", "alpha"])
    for _, part in table.groupby("comparison"):
        assert part.TPR.is_monotonic_increasing and part.FPR.is_monotonic_increasing
    seen = df.where("score is not null")
    direct = {r.comparison: r.auROC for r in roc.auroc_of_scores(seen).collect()}
    turned = roc.auroc_of_scores(seen.withColumn("score", 1 - F.col("score")))
    for r in turned.collect():
        assert r.auROC == pytest.approx(1 - direct[r.comparison])


def test_area_paths_agree(random_scores):
    _, df = random_scores
    long = {r.comparison: r.auROC for r in roc.auroc(roc.roc(df)).collect()}
    short = {r.comparison: r.auROC for r in roc.auroc_of_scores(df).collect()}
    assert long == pytest.approx(short)


def test_one_sided_truth_gives_null_rates(spark):
    df = spark.createDataFrame(
        [("c", "a", 0.1, True), ("c", "b", 0.2, True)],
        "comparison string, identifier string, score double, truth boolean",
    )
    table = roc.roc(df)
    assert all(r.FPR is None and r.MCC is None for r in table.collect())
    assert roc.auroc(table).first()["auROC"] is None


@pytest.mark.parametrize("count,limit", [(50, 2000), (2000, 2000), (2001, 2000), (5000, 2000), (37, 10)])
def test_thin(spark, count, limit):
    values = spark.range(count).selectExpr("id / 7.0D as alpha")
    got = sorted(r.alpha for r in roc.thin(values, limit=limit).collect())
    ordered = [k / 7.0 for k in range(count)]
    if count > limit:
        ordered = [ordered[int(k * (count - 1) // (limit - 1))] for k in range(limit)]
    assert got == pytest.approx(ordered)


def test_label_positions(spark):
    rows = [("c", m, a) for m, a in (("p", 0.5), ("q", 0.9), ("r", 0.7))] + [("d", "p", 0.6)]
    df = spark.createDataFrame(rows, "comparison string, method string, auROC double")
    got = {(r.comparison, r.method): r.FPR for r in roc.label_positions(df).collect()}
    assert got == pytest.approx({("c", "q"): 0.1, ("c", "r"): 0.54, ("c", "p"): 0.98, ("d", "p"): 0.1})
