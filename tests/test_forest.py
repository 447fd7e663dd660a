"""The forest filter, judged by another engine from the SQL of its trees."""

import random

import duckdb
import pytest

from diffspark.functions import trees as trees_of
from diffspark.operators import classify
from diffspark.operators.moments import direct_profiles
from diffspark.plans import catalog
from diffspark.plans.views import CONTRASTS, TRUTH
from diffspark.stage import materialise


@pytest.mark.parametrize("trees, depth", [(3, 2), (40, 20)])
def test_other_engine_gives_the_same_classes(spark, small, trees, depth):
    names = classify.feature_names(CONTRASTS)
    features = materialise(
        classify.filter_features(catalog.profile(spark, small, "light"), CONTRASTS, TRUTH)
    )
    model = classify.fit_filter(features, names, trees=trees, depth=depth)
    nodes = classify.forest_nodes(model, spark)
    assert len(nodes) == trees
    assert all(abs(sum(n.shares) - 1) < 1e-12 for tree in nodes for n in tree.values())
    want = {r["identifier"]: r["pred"] for r in classify.predict_class(model, features, names).collect()}
    files = [f.removeprefix("file:").replace("///", "/") for f in features.inputFiles()]
    con = duckdb.connect()
    complete = " AND ".join(f'"{n}" IS NOT NULL' for n in names)
    rows = con.execute(
        f"SELECT identifier, {classify.forest_sql(nodes, names)} FROM read_parquet(?) WHERE {complete}", [files]
    ).fetchall()
    assert dict(rows) == want and len(rows) == len(want)
    assert set(want.values()) == {"TP", "TN"}


def test_identifiers_without_any_value_are_dropped(spark):
    """They have no features, as the all-null rows that the reference removes first."""
    rows = [("p:Brand#1", c, 1, 1.0) for c in "ANR"] + [("q:Brand#5", c, 1, None) for c in "ANR"]
    rows += [("r:Brand#5", "A", 1, 2.0), ("r:Brand#5", "N", 1, None)]
    df = spark.createDataFrame(rows, "identifier string, condition string, replicate long, y double")
    features = classify.filter_features(direct_profiles(df, ["A", "N", "R"]), CONTRASTS, TRUTH)
    assert sorted(r.identifier for r in features.collect()) == ["p:Brand#1", "r:Brand#5"]


def noisy(spark, n=3000):
    """Rows of five features that tell the class in part only; some features are heavily tied."""
    draw = random.Random(5)
    rows = []
    for k in range(n):
        x = [draw.gauss(0, 1), draw.gauss(0, 1), float(draw.randrange(4)), draw.gauss(0, 1), draw.random() ** 3]
        lift = x[0] + x[2] / 2 + draw.gauss(0, 1) > 2
        rows.append((f"p{k}", "TP" if lift else "TN", *x))
    names = ["a", "b", "c", "d", "e"]
    columns = "identifier string, class string, " + ", ".join(f"{x} double" for x in names)
    return materialise(spark.createDataFrame(rows, columns)), names


def test_splits_of_all_tasks_and_of_one_give_the_same_trees(spark):
    """A forest does not depend on how much of it is grown by counts of all tasks, nor on the blocks."""
    rows, names = noisy(spark)
    whole = classify.fit_filter(rows, names, trees=6)
    parted = classify.fit_filter(materialise(rows.repartition(7)), names, trees=6, at_once=150)
    assert parted.nodes.count() > whole.nodes.count() == 6
    trees = classify.forest_nodes(whole, spark)
    assert trees == classify.forest_nodes(parted, spark)
    assert classify.predict_class(whole, rows, names).where("pred <> class").count() < 300
    out = [sorted(classify.predict_class(m, rows, names).collect()) for m in (whole, parted)]
    assert out[0] == out[1] and len(out[0]) == 3000
    for tree in trees:
        for k, n in tree.items():
            assert (n.left < 0) == (n.right < 0) and k < (1 << 21)
            if n.left >= 0:
                pair = tree[n.left], tree[n.right]
                sides = {x.shares[1] > x.shares[0] for x in pair}
                assert len(sides) == 2 or any(x.left >= 0 for x in pair)


def test_a_split_is_the_best_of_all_cuts(spark):
    """The root of a tree that may try all features, against a search over the drawn rows."""
    rows, names = noisy(spark, 400)
    seed, least = 3, 5
    model = classify.fit_filter(rows, names, trees=1, depth=1, seed=seed, least_in_node=least, tried=5)
    (root, *_) = classify.forest_nodes(model, spark)[0].values()
    data = rows.selectExpr("xxhash64(identifier) AS key", "class", *names).toPandas()
    drawn = trees_of.times_drawn(data.key.to_numpy().view("uint64"), 0, seed).astype(float)
    assert 0.9 < drawn.mean() < 1.1 and 0.5 < (drawn > 0).mean() < 0.75
    share = (data["class"] == "TP").mean()
    weight = drawn * ((data["class"] == "TP") * (1 - share) + (data["class"] == "TN") * share)

    def impure(side):
        p = weight[side & (data["class"] == "TP")].sum()
        n = weight[side & (data["class"] == "TN")].sum()
        return 2 * p * n / (p + n)

    found = {}
    for f, name in enumerate(names):
        for cut in model.cuts[f]:
            low = data[name] <= cut
            if min(drawn[low].sum(), drawn[~low].sum()) >= least:
                found[f, cut] = -impure(low) - impure(~low)
    assert (root.feature, root.value) == max(found, key=found.get)


def test_one_class_only_and_nothing_to_learn_from(spark):
    rows, names = noisy(spark, 60)
    for only in ("TP", "TN"):
        model = classify.fit_filter(rows.where(rows["class"] == only), names, trees=5)
        got = classify.predict_class(model, rows, names).select("pred").distinct().collect()
        assert [r.pred for r in got] == [only]
    assert classify.predict_class(model, rows.limit(0), names).count() == 0
    with pytest.raises(ValueError):
        classify.fit_filter(rows.limit(0), names)


def test_all_rows_are_learned_from(spark):
    """Class weights and counts are those of all rows, however many there are."""
    n = 1_100_000
    label = "CASE WHEN id % 7 = 0 THEN 'TP' ELSE 'TN' END AS class"
    rows = materialise(spark.range(n).selectExpr("cast(id AS string) AS identifier", label, "id % 100 / 1.0D AS a"))
    model = classify.fit_filter(rows, ["a"], trees=1, depth=1)
    positives = -(-n // 7)
    assert model.weights[0] == pytest.approx(positives / n, abs=1e-12)
    keys = rows.selectExpr("xxhash64(identifier) AS key").toPandas().key.to_numpy().view("uint64")
    drawn = int(trees_of.times_drawn(keys, 0, 1).sum())
    levels = [trees_of.unpacked(r) for r in model.nodes.collect()]
    assert sum(int((x.positives + x.negatives)[x.feature == trees_of.LEAF].sum()) for x in levels) == drawn
