import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from diffspark.operators import impute, moments, ordered
from diffspark.operators.trend import Trend
from diffspark.plans import catalog, views

TREND = Trend(0.3, -0.05)


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        for c in "AB":
            for r in range(4):
                y = float(rng.normal(10 + i % 5, 1))
                hole = rng.random() < 0.25 or (i == 7 and c == "B") or i == 11
                rows.append((f"i{i}", c, r, None if hole else y))
    return spark.createDataFrame(rows, "identifier string, condition string, replicate long, y double")


@pytest.fixture(scope="module")
def parts(gaps):
    cells = moments.cell_moments(gaps).cache()
    return cells, impute.low_tail(cells)


def test_low_tail(parts):
    cells, low = parts
    means = [r["mean"] for r in cells.where("mean is not null").collect()]
    assert low == pytest.approx(np.quantile(means, 0.01))


def test_single_keeps_observed_and_fills_all(gaps, parts):
    cells, low = parts
    filled = impute.single_imputation(gaps, cells, TREND, low).toPandas()
    before = gaps.toPandas()
    key = ["identifier", "condition", "replicate"]
    both = before.merge(filled, on=key, suffixes=("", "_new"))
    assert len(both) == len(before) and both.y_new.notna().all()
    seen = both[both.y.notna()]
    assert (seen.y == seen.y_new).all()


def test_draws_do_not_depend_on_layout(gaps, parts):
    cells, low = parts
    a = impute.imputation_draws(gaps, cells, TREND, low, 3).toPandas()
    b = impute.imputation_draws(gaps.repartition(9), cells, TREND, low, 3).toPandas()
    key = ["imputation", "identifier", "condition", "replicate"]
    assert a.sort_values(key).y.tolist() == b.sort_values(key).y.tolist()
    assert a.groupby(key).ngroups == len(a)


def test_spread_of_draws_follows_the_trend(spark):
    rows = spark.range(4000).select(
        F.concat(F.lit("i"), "id").alias("identifier"),
        F.lit("A").alias("condition"),
        F.lit(0).cast("long").alias("replicate"),
        F.lit(None).cast("double").alias("y"),
    )
    cells = rows.select(
        "identifier", "condition", F.lit(8.0).alias("mean"), F.lit(1).alias("gaps")
    )
    y = impute.imputation_draws(rows, cells, TREND, 0.0, 1).toPandas().y
    assert y.mean() == pytest.approx(8.0, abs=0.06)
    assert y.std() == pytest.approx(np.exp(0.3 - 0.05 * 8), rel=0.05)


@pytest.mark.parametrize("weighted", [False, True])
def test_merged_profiles_equal_direct_moments(gaps, parts, weighted):
    """Observed moments plus draw moments must equal the moments of the filled data."""
    cells, low = parts
    weight = TREND.precision_weight(F.col("y")) if weighted else None
    draws = impute.imputation_draws(gaps, cells, TREND, low, 3)
    observed = moments.direct_profiles(gaps, ["A", "B"], weight=weight)
    merged = impute.imputed_profiles(observed, draws, 3, weight)
    flat = merged.select("imputation", "identifier", F.explode("cells").alias("condition", "m"))
    got = flat.select("imputation", "identifier", "condition", "m.*").toPandas()
    seen = gaps.where("y is not null").toPandas()
    filled = pd.concat([seen.assign(imputation=k) for k in range(3)] + [draws.toPandas()])
    key = ["imputation", "identifier", "condition"]
    want = filled.groupby(key).y
    got = got.set_index(key).sort_index()
    assert len(got) == want.ngroups
    assert (got.n == want.size().sort_index()).all()
    assert np.allclose(got["mean"], want.mean().sort_index())
    assert np.allclose(got.ss, want.var(ddof=0).sort_index() * got.n, atol=1e-9)
    if weighted:
        filled["w"] = np.exp(-2 * (0.3 - 0.05 * filled.y))
        filled["wy"] = filled.w * filled.y
        sums = filled.groupby(key)[["w", "wy"]].sum().sort_index()
        assert np.allclose(got.w, sums.w)
        assert np.allclose(got.wmean, sums.wy / sums.w)
        filled = filled.join((sums.wy / sums.w).rename("m"), on=key)
        filled["d"] = filled.w * (filled.y - filled.m) ** 2
        assert np.allclose(got.wss, filled.groupby(key).d.sum().sort_index(), atol=1e-9)


def test_hot_condition_keeps_every_draw(spark):
    """One condition holds most gaps and is matched by broadcast; nothing is lost."""
    rows = spark.range(2000).selectExpr(
        "if(id % 3 > 0, 'hot', concat('i', id)) as identifier",
        "'A' as condition",
        "id as replicate",
        "if(id % 2 = 0, null, 5.0D + id % 7) as y",
    )
    cells = moments.cell_moments(rows)
    draws = impute.imputation_draws(rows, cells, TREND, 1.0, 2).toPandas()
    assert len(draws) == 2 * rows.where("y is null").count()
    assert draws.y.notna().all()
    centre = cells.where("identifier = 'hot'").first()["mean"]
    assert draws[draws.identifier == "hot"].y.mean() == pytest.approx(centre, abs=0.2)


@pytest.mark.parametrize("weighted", [False, True])
def test_direct_profiles_equal_folded_cells(gaps, weighted):
    weight = TREND.precision_weight(F.col("y")) if weighted else None
    direct = moments.direct_profiles(gaps, ["A", "B"], weight=weight)
    folded = moments.profiles(moments.cell_moments(gaps, weight=weight).where("n > 0"))

    def flat(p):
        rows = p.select("identifier", F.explode("cells").alias("condition", "m"))
        table = rows.select("identifier", "condition", "m.*").toPandas()
        return table.set_index(["identifier", "condition"]).sort_index()

    a, b = flat(direct), flat(folded)
    assert list(a.columns) == list(b.columns) and (a.index == b.index).all()
    assert np.allclose(a, b, atol=1e-9)


def test_one_row_for_profiles_without_gaps(gaps):
    """Unexpanded profiles are the expanded ones, with gap-free identifiers once."""
    cells = moments.cell_moments(gaps)
    draws = impute.imputation_draws(gaps, cells, TREND, 1.0, 7)
    observed = moments.direct_profiles(gaps, ["A", "B"])
    full = impute.imputed_profiles(observed, draws, 7)
    short = impute.imputed_profiles(observed, draws, 7, expand=False)
    whole = {r.identifier for r in gaps.groupBy("identifier").agg(F.count_if(F.col("y").isNull()).alias("n")).where("n = 0").collect()}
    assert {r.identifier for r in short.where("imputation is null").collect()} == whole

    def flat(p):
        return sorted(map(tuple, p.select("identifier", "imputation", F.sort_array(F.map_entries("cells"))).collect()))

    assert flat(impute.every_imputation(short, 7)) == flat(full)


def test_tasks_follow_the_number_of_draws(spark, small, monkeypatch):
    """Pieces of the draws, of the lines and of ordered rows keep their size as data grow; same results."""
    names = ("q_imputed_cells", "q_variance_prior")

    def results():
        return [sorted(map(tuple, catalog.QUERIES[q](spark, small).collect()), key=repr) for q in names]

    want = results()
    gaps = catalog.Missing(spark, small)
    assert gaps.draws(20).rdd.getNumPartitions() == 5
    monkeypatch.setattr(impute, "ROWS_A_TASK", 500)
    monkeypatch.setattr(ordered, "ROWS_A_BUCKET", 200)
    monkeypatch.setattr(views, "LINES_A_TASK", 600)
    n = gaps.cells.agg({"gaps": "sum"}).first()[0] * 20
    assert gaps.draws(20).rdd.getNumPartitions() == -(-n // 500) > 5
    assert gaps.profiles(20).rdd.getNumPartitions() == -(-n // 500)
    assert views.measurements(spark, small).rdd.getNumPartitions() == 10
    rows = gaps.cells.where("mean is not null")
    placed = ordered.row_index(rows, [], ["mean", "identifier", "condition"], rows=rows.count())
    assert placed.select(ordered.BUCKET).distinct().count() > 2
    got = results()
    assert [len(x) for x in got] == [len(x) for x in want]
    assert got == want
