"""Bucketed ordered operators against plain computations, with hot values and groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from diffspark.operators import ordered


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 3000
    group = np.where(rng.random(n) < 0.7, "big", rng.choice(list("abc"), n))
    value = np.where(rng.random(n) < 0.4, 0.5, rng.integers(0, 400, n) / 400)
    pdf = pd.DataFrame({"id": np.arange(n), "g": group, "v": value, "w": rng.random(n)})
    return pdf, spark.createDataFrame(pdf)


def test_running_sums(data):
    pdf, df = data
    counts = df.groupBy("g", "v").agg(F.count("id").alias("n"))
    got = ordered.running_sums(ordered.range_buckets(counts, ["g"], ["v"]), ["g"], ["v"], ["n"])
    assert got.select(ordered.BUCKET).distinct().count() > 1
    for r in got.collect():
        group = pdf[pdf.g == r.g]
        assert r.n_before == (group.v < r.v).sum()
        assert r.n_total == len(group)


@pytest.mark.parametrize("inclusive", [True, False])
def test_suffix_min(data, inclusive):
    pdf, df = data
    low = df.groupBy("g", "v").agg(F.min("w").alias("w"))
    got = ordered.suffix_min(
        ordered.range_buckets(low, ["g"], ["v"]), ["g"], ["v"], "w", "m", inclusive
    )
    for r in got.collect():
        group = pdf[pdf.g == r.g]
        later = group[group.v >= r.v] if inclusive else group[group.v > r.v]
        assert r.m == (later.w.min() if len(later) else None)


def test_row_index(data):
    pdf, df = data
    got = ordered.row_index(df, ["g"], ["v", "id"]).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values(["v", "id"])
        assert list(part["index"]) == list(range(1, len(part) + 1))
        assert set(part["size"]) == {len(part)}


def test_row_index_skips_nulls(spark, data):
    _, df = data
    holes = df.withColumn("v", F.when(F.col("id") % 7 != 0, F.col("v")))
    got = ordered.row_index(holes, ["g"], ["v", "id"], valid="v").toPandas()
    for _, part in got.groupby("g"):
        seen = part[part.v.notna()].sort_values(["v", "id"])
        assert list(seen["index"]) == list(range(1, len(seen) + 1))
        assert set(part["size"]) == {len(seen)}


def test_quantiles(data):
    pdf, df = data
    probs = {"lo": 0.01, "mid": 0.5, "hi": 0.9}
    got = {r.g: r for r in ordered.quantiles(df, ["g"], "w", probs).collect()}
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part.w, p), abs=1e-12)


def test_quantiles_without_groups(data):
    pdf, df = data
    got = ordered.quantiles(df, [], "v", {"q": 0.25}).first()["q"]
    assert got == pytest.approx(np.quantile(pdf.v, 0.25))


def test_trapezoid(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y"], 500), "a": rng.random(500), "b": rng.random(500)})
    got = {r.g: r.area for r in ordered.trapezoid(spark.createDataFrame(pdf), ["g"], "a", "b", "area").collect()}
    for g, part in pdf.groupby("g"):
        part = part.sort_values(["a", "b"])
        assert got[g] == pytest.approx(np.trapezoid(part.b, part.a))


def test_trapezoid_edges(spark):
    df = spark.createDataFrame(
        [("one", 0.5, 0.5), ("none", None, 0.1)], "g string, a double, b double"
    )
    got = {r.g: r.area for r in ordered.trapezoid(df, ["g"], "a", "b", "area").collect()}
    assert got == {"one": 0.0, "none": None}


@pytest.mark.parametrize("hot", [2, 64, 10**9])
def test_lookup_splits_hot_keys(data, monkeypatch, hot):
    """With no, some and only hot keys."""
    monkeypatch.setattr(ordered, "HOT_KEYS", hot)
    pdf, df = data
    table = df.groupBy("v").agg(F.count("id").alias("n"), F.max("id").alias("top"))
    got = ordered.lookup(df, table, ["v"], "n").toPandas()
    assert len(got) == len(pdf)
    want = pdf.groupby("v").id.max()
    assert (got.top.to_numpy() == want[got.v].to_numpy()).all()
