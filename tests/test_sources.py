import pytest
from pyspark.sql import functions as F

from diffspark import schema
from diffspark.functions import labels
from diffspark.operators import relational
from diffspark.sources import tables


def test_text_round_trip_with_na(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "identifier string, y double")
    for sep in ("\t", ","):
        path = str(tmp_path / f"t{ord(sep)}")
        tables.write_delimited(df, path, sep)
        assert "NA" in "".join(r.value for r in spark.read.text(path).collect())
        back = tables.read_delimited(spark, path, df.schema, sep)
        assert sorted(map(tuple, back.collect()), key=str) == [("a", 1.5), ("b", None)]


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "once")
    assert tables.write_once(spark.range(3), path).count() == 3
    assert tables.write_once(spark.range(9), path).count() == 3


def test_results_are_kept_per_dataset(spark, tmp_path):
    root = str(tmp_path / "results")
    one = spark.createDataFrame([("human", 1.0)], "dataset string, alpha double")
    two = spark.createDataFrame([("yeast", 2.0)], "dataset string, alpha double")
    tables.save_result(one, root)
    tables.save_result(two, root)
    tables.save_result(two.withColumn("alpha", F.lit(3.0)), root)
    got = {r.dataset: r.alpha for r in tables.load_results(spark, root).collect()}
    assert got == {"human": 1.0, "yeast": 3.0}


def test_names(spark):
    assert tables.clean_name("Protein ID (main)") == "protein_id_main"
    assert tables.clean_name("sampleOne") == "sample_one"
    assert tables.clean_name("25 fmol") == "x25_fmol"
    df = spark.createDataFrame([(1, 2)], "`A b` int, `a.b` int")
    assert tables.clean_names(df).columns == ["a_b", "a_b_2"]


def test_wide_ingest(spark):
    df = spark.createDataFrame(
        [("p1", "x", 1.0, 2.0, None, 4.0)],
        "id string, note string, `1-6_a` double, `1-6_b` double, `1-12_a` double, `1-12_b` double",
    )
    named = tables.first_as_identifier(df, drop=range(1, 2))
    wide = tables.rename_samples(named, lambda n: "spike_" + n.split("_")[0][2:], 2)
    assert wide.columns == ["identifier", "spike_6_1", "spike_6_2", "spike_12_1", "spike_12_2"]
    long = tables.wide_to_long(wide).collect()
    assert {(r.condition, r.replicate): r.y for r in long} == {
        ("spike_6", 1): 1.0,
        ("spike_6", 2): 2.0,
        ("spike_12", 1): None,
        ("spike_12", 2): 4.0,
    }


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "x")], "a int, p_val double, median_p_val double, s string")
    assert relational.columns_like(df, "(median_|^)p_val") == ["p_val", "median_p_val"]
    assert relational.columns_like(df, "p_val", exclude=True) == ["a", "s"]
    assert relational.column_range(df, "p_val", "s") == ["p_val", "median_p_val", "s"]
    assert relational.zero_as_missing(df.withColumn("p_val", F.lit(0.0))).first()["p_val"] is None


def test_contrasts(spark):
    assert [c.comparison for c in schema.pairwise_contrasts(["x", "y", "z"])] == ["x vs y", "x vs z", "y vs z"]
    assert schema.parse_contrast("ng50-ng100").comparison == "ng50 vs ng100"
    design = spark.createDataFrame([("c",), ("a",), ("b",)], "condition string")
    got = sorted(r.comparison for r in schema.contrast_table(design, ["b", "a", "x", "c"]).collect())
    assert got == ["a vs c", "b vs a", "b vs c"]
    assert schema.contrast_table(design.limit(1), ["c", "a"]).count() == 0


def test_labels(spark):
    pairs = schema.pairwise_contrasts(["ng50", "ng100"])
    rows = [("ng100 Vs ng50", 2.0), ("ng50 vs ng100", 1.0), ("x vs y", 3.0)]
    turned = labels.orient_results(spark.createDataFrame(rows, "comparison string, lfc double"), pairs)
    assert [tuple(r) for r in turned.collect()] == [("ng50 vs ng100", -2.0), ("ng50 vs ng100", 1.0), ("x vs y", 3.0)]
    named = labels.relabel_comparisons(turned, pairs, {"ng50": "50", "ng100": "100"}).collect()
    assert [(r.comparison, r.position) for r in named] == [("50 vs 100", 1), ("50 vs 100", 1), ("x vs y", None)]
    df = spark.createDataFrame([("B vs A", 2.0), ("A vs B", 1.0)], "comparison string, lfc double")
    row = df.select(
        labels.replace_first(F.lit("aXbXc"), "X", "-").alias("one"),
        labels.replace_all(F.lit("Mix-Gamma"), {"Mix": "GCR", "Gamma": "GR"}).alias("all"),
    ).first()
    assert (row.one, row.all) == ("a-bXc", "GCR-GR")
    level = labels.with_level(df, "comparison", ["A vs B"], "k").collect()
    assert [r.k for r in level] == [None, 1]


def test_nest_and_first(spark):
    df = spark.createDataFrame([("i", "x vs y", 1.0), ("i", "x vs z", 2.0)], "identifier string, comparison string, t double")
    back = relational.unnest(relational.nest(df, ["identifier"]))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    first = relational.first_comparison(df, schema.pairwise_contrasts(["x", "y", "z"]))
    assert [r.t for r in first.collect()] == [1.0]
    with pytest.raises(ValueError):
        schema.parse_contrast("abc")


def _write(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_scan_by_names_with_rejected_cells(spark, tmp_path):
    path = _write(
        tmp_path / "t",
        a="y,more,identifier,n\n1.5,x,i1,3\nabc,x,i2,4\nNA,x,NA,NA\n",
        b="y,more,identifier,n\n2,x,i3,4.5\n7,x\n8,x,i4,5,6\n-,x,i5,seven\n",
    )
    scan = tables.scan_delimited(spark, path, "identifier string, y double, n int")
    assert scan.rows.columns == ["identifier", "y", "n"]
    rows = {tuple(r) for r in scan.rows.collect()}
    assert rows == {("i1", 1.5, 3), ("i2", None, 4), (None, None, None), ("i3", 2.0, None), ("i5", None, None)}
    rejected = {(r["file"][-5:], r["column"], r["value"]) for r in scan.rejected.collect()}
    assert rejected == {
        ("a.csv", "y", "abc"),
        ("b.csv", "n", "4.5"),
        ("b.csv", None, "7,x"),
        ("b.csv", None, "8,x,i4,5,6"),
        ("b.csv", "y", "-"),
        ("b.csv", "n", "seven"),
    }
    assert scan.rejected.count() == len(rejected)
    with pytest.raises(ValueError, match="no_such"):
        tables.scan_delimited(spark, path, "no_such string")


def test_interrupted_write_is_written_again(spark, tmp_path):
    path = str(tmp_path / "once")
    spark.range(2).write.parquet(f"{path}/data-of-a-killed-job")  # no pointer names it
    assert tables.write_once(spark.range(5), path).count() == 5
    assert tables.write_once(spark.range(9), path).count() == 5


def test_first_of_two_writers_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "once")
    publish = tables._Files.publish

    def late(self, name, text, replace):
        monkeypatch.undo()
        assert tables.write_once(spark.range(3), path).count() == 3  # finishes in between
        return publish(self, name, text, replace)

    monkeypatch.setattr(tables._Files, "publish", late)
    assert tables.write_once(spark.range(7), path).count() == 3
    assert len([f for f in (tmp_path / "once").iterdir() if f.name.startswith("data-")]) == 1


def test_unpublished_snapshots_do_not_count(spark, tmp_path):
    root = str(tmp_path / "r")
    rows = spark.createDataFrame([("a/b", 1), ("c", 2), (None, 3)], "dataset string, v int")
    tables.save_result(rows, root)
    spark.range(4).select(F.lit(9).alias("v")).write.parquet(f"{root}/dataset=c/snapshot=broken")
    tables.save_result(rows.where("dataset = 'a/b'").withColumn("v", F.lit(5)), root)
    got = {r.dataset: r.v for r in tables.load_results(spark, root).collect()}
    assert got == {"a/b": 5, "c": 2, None: 3}
    assert tables.drop_superseded(spark, root) == 2
    assert tables.load_results(spark, root).count() == 3
    with pytest.raises(ValueError):
        tables.load_results(spark, str(tmp_path / "none"))
