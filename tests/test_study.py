"""Whole studies on the planted effect, and the forest filter."""

import pytest

from diffspark.operators import classify
from diffspark.plans import catalog, study, views
from diffspark.plans.views import COMPARISONS, CONTRASTS, TRUTH

PLANTED = COMPARISONS[:2]


@pytest.fixture(scope="module")
def rows(spark, small):
    wide, samples = views.matrix(spark, small)
    return study.normalised(wide, samples)


@pytest.fixture(scope="module")
def done(rows):
    return study.run_study(rows, catalog.study_options(imputations=6, grid=(3, 3)))


def test_every_method_is_scored(done):
    areas = done.areas.toPandas()
    assert set(areas.method) == set(study.METHOD_ORDER)
    assert len(areas) == len(study.METHOD_ORDER) * len(COMPARISONS)
    assert areas.auROC.between(0, 1).all()


def test_planted_effect_is_found(done):
    areas = done.areas.toPandas().set_index(["method", "comparison"]).auROC
    for method in study.METHOD_ORDER:
        assert max(areas[method, c] for c in PLANTED) > areas[method, "N vs R"], method
        assert max(areas[method, c] for c in PLANTED) > 0.6, method


def test_every_identifier_has_a_result(done, rows):
    n = rows.select("identifier").distinct().count()
    counts = done.results.groupBy("method", "comparison").count().collect()
    assert len(counts) == len(study.METHOD_ORDER) * len(COMPARISONS)
    assert {r["count"] for r in counts} == {n}


def test_save_and_summarise(spark, done, tmp_path):
    root = str(tmp_path / "studies")
    study.save_study(done, root, "first")
    study.save_study(done, root, "second")
    summary = study.summarise_studies(spark, root).toPandas()
    assert set(summary.dataset) == {"first", "second"}
    assert set(summary.name) == {"TPR", "FPR", "precision", "accuracy", "MCC"}
    assert summary.level.notna().all()


def test_survivor_evidence_and_two_stage_partition(rows):
    options = catalog.study_options(
        imputations=6,
        grid=(2, 2),
        consensus_evidence="survivors",
        gaps_grid=(2, 2),
        gaps_two_stage=True,
        weight_spread="sd_p",
        weight_terms="mean*c",
        mode="inclusive",
        pn_scope="global",
        adjust_t=False,
        robust=False,
    )
    other = study.run_study(rows, options)
    assert "c_p" not in other.partition.columns
    assert set(other.weight_partition.columns) >= {"c", "c_p"}
    assert {r.method for r in other.areas.collect()} == set(study.METHOD_ORDER)


def test_preset_settings():
    """Which data the labels of the weights come from, and what is reported."""
    human, ramus, ups, yeast = (study.preset(d) for d in ("human", "ramus", "ups", "yeast"))
    assert [p.gaps_grid for p in (human, ramus, ups, yeast)] == [(25, 25), None, (30, 30), (25, 25)]
    assert [p.gaps_two_stage for p in (human, ramus, ups, yeast)] == [False, False, True, False]
    assert [p.weight_spread for p in (human, ramus, ups, yeast)] == ["sd", "sd", "sd_p", "sd"]
    assert human.ensemble_methods == () and ramus.relabel == study.RAMUS_AMOUNTS
    assert all(p.threshold_limit is None for p in (human, ramus, ups, yeast))


def test_presets():
    assert [len(study.preset(d).contrasts) for d in ("human", "ramus", "ups", "yeast")] == [3, 36, 3, 1]
    assert study.preset("yeast", imputations=20).imputations == 20
    assert list(study.RAMUS_AMOUNTS) == study.RAMUS_CONDITIONS


def test_forest_filter(spark, small):
    everything, predicted = study.identifiers_to_keep(
        views.measurements(spark, small, "light"), CONTRASTS, TRUTH, trees=20
    )
    kept = {r.identifier for r in classify.keep_list(predicted).collect()}
    out = predicted.toPandas()
    assert kept == set(out[out.cls_prd != "TP-TN"].identifier)
    labelled = classify.with_predictions(everything, predicted).toPandas()
    assert len(labelled) == everything.count()
    sizes = labelled.groupby("cls_prd").size().sort_values(ascending=False)
    levels = labelled.drop_duplicates("cls_prd").set_index("cls_prd").level
    assert levels[sizes.index[0]] == 1


def test_registered_study_runs_the_defaults():
    options = catalog.study_options()
    whole = study.StudyOptions(CONTRASTS, TRUTH)
    for name in ("imputations", "grid", "gaps_grid", "robust", "threshold_limit"):
        assert getattr(options, name) == getattr(whole, name), name
    assert options.imputations == catalog.IMPUTATIONS_OF_STUDIES == 1000


def test_consensus_parts_are_those_of_the_full_test(spark, small):
    """The query of 1000 imputations, for as many as the query that has SQL."""
    parts = catalog.consensus_parts(spark, small, catalog.IMPUTATIONS).cache()
    full = catalog.q_consensus_methods(spark, small).where("method = 'full'").drop("method")
    pairs = parts.where("part = 'pairs'").select(*full.columns)
    assert sorted(map(tuple, pairs.collect()), key=repr) == sorted(map(tuple, full.collect()), key=repr)
    rows = parts.where("part = 'roc'").select("comparison", "alpha", *catalog.CELLS).collect()
    assert {r.comparison for r in rows} == set(COMPARISONS)
    n = full.where("critical is not null").groupBy("comparison").count().collect()
    assert {r.comparison: r["count"] for r in n} == {
        r.comparison: sum(r[c] for c in catalog.CELLS) for r in rows
    }
