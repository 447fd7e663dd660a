"""The registered queries: every operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark import schema
from diffspark.functions import labels
from diffspark.functions.special import binomial_upper
from diffspark.operators import (
    classify,
    consensus,
    ensemble,
    impute,
    moderated,
    moments,
    multiplicity,
    normalize,
    posterior,
    relational,
    roc,
    trend,
    ttest,
    vectors,
)
from diffspark.plans import study, views
from diffspark.plans.views import COMPARISONS, CONTRASTS, METHODS, TRUTH
from diffspark.sources import tables
from diffspark.stage import finished, materialise, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def profile(spark: SparkSession, d: str, missing: str | None = None) -> DataFrame:
    return moments.direct_profiles(views.measurements(spark, d, missing), views.CONDITIONS)


# --- sources and sinks --------------------------------------------------------------


@query
def q_text_scan(spark, d):
    """Tab- and comma-separated text with NA tokens, written and read back by schema."""
    lines = views.table(spark, d, "lineitem").select("l_returnflag", "l_tax", "l_extendedprice")
    root = new_path(spark)
    schema_text = "l_returnflag string, l_tax double, l_extendedprice double"
    parts = []
    for name, sep in (("tab", "\t"), ("comma", ",")):
        tables.write_delimited(relational.zero_as_missing(lines, ["l_tax"]), f"{root}/{name}", sep=sep)
        read = tables.read_delimited(spark, f"{root}/{name}", schema_text, sep=sep)
        parts.append(read.withColumn("format", F.lit(name)))
    return relational.union_all(parts).groupBy("format", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("l_tax").alias("taxed"),
        F.round(F.sum("l_extendedprice"), 2).alias("total"),
    )


@query
def q_text_rejects(spark, d):
    """A text table with its columns in another order, one column too many and prices that are
    no numbers: rows by name, rejected cells on the side."""
    price = F.col("l_extendedprice").cast("string")
    odd = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("$"), price)).otherwise(price)
    lines = views.table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("note"),
        odd.alias("l_extendedprice"),
        "l_returnflag",
        "l_tax",
    )
    path = new_path(spark)
    tables.write_delimited(relational.zero_as_missing(lines, ["l_tax"]), path, sep="\t")
    scan = tables.scan_delimited(
        spark, path, "l_returnflag string, l_tax double, l_extendedprice double", sep="\t"
    )
    rows = scan.rows.groupBy(F.col("l_returnflag").alias("what")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("l_tax").alias("taxed"),
        F.round(F.sum("l_extendedprice"), 2).alias("total"),
    )
    rejects = scan.rejected.groupBy(F.col("column").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(rejects, allowMissingColumns=True)


@query
def q_interrupted_write(spark, d):
    """Tables over what killed jobs have left: a folder of rows that was never published does
    not count, neither for a table that is written once nor for a saved dataset."""
    s = views.scores(spark, d)
    once, root = new_path(spark), new_path(spark)
    part = s.where("score > 1")
    part.write.parquet(f"{once}/data-killed")
    first = tables.write_once(s, once)
    again = tables.write_once(part, once)
    saved = s.withColumn("dataset", F.col("method"))
    tables.save_result(saved, root)
    part.select("identifier", "comparison", "score", "lfc", "truth", "method").write.parquet(
        f"{root}/dataset=ttest/snapshot=killed"
    )
    loaded = tables.load_results(spark, root).drop("dataset")
    found = {"first": first, "again": again, "saved": loaded}
    every = relational.union_all([t.withColumn("read", F.lit(k)) for k, t in found.items()])
    return every.groupBy("read", "method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("truth").alias("n_true"), F.max("score").alias("top")
    )


@query
def q_stage_reload(spark, d):
    """Result tables saved per dataset and loaded together, tagged by their folder."""
    root, scores = new_path(spark), new_path(spark)
    for _ in range(2):  # the second write finds the table and leaves it
        s = tables.write_once(views.scores(spark, d), scores)
    s = s.withColumn("dataset", F.col("method"))
    tables.save_result(s.where("method <> 'ttest'"), root)
    tables.save_result(s.where("method = 'ttest'"), root)
    loaded = tables.load_results(spark, root)
    return loaded.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("top")
    )


@query
def q_wide_ingest(spark, d):
    """Wide matrix with raw headers to long measurements."""
    long = views.measurements(spark, d, log=False)
    aggs = []
    for c in views.CONDITIONS:
        y = F.when(F.col("condition") == c, F.col("y"))
        aggs += [F.max(y).alias(f"{c} Max."), F.min(y).alias(f"{c} Min.")]
    wide = long.groupBy(F.col("identifier").alias("Protein ID")).agg(
        F.count("y").alias("Rows"), *aggs
    )
    named = tables.first_as_identifier(tables.clean_names(wide), drop=range(1, 2))
    samples = tables.rename_samples(named, ["condi1", "condi2", "condi3"], 2)
    return rounded(tables.wide_to_long(samples), "y")


@query
def q_clean_headers(spark, d):
    """Raw headers and what becomes of them, next to the sums of their columns."""
    raw = ["Retail Price (USD)", "retail-price USD", "Size %", "2nd Size", "µm α", "Part#Key"]
    sources = ["p_retailprice", "p_retailprice", "p_size", "p_size", "p_size", "p_partkey"]
    wide = views.table(spark, d, "part").select(
        *[F.col(c).cast("double").alias(n) for n, c in zip(raw, sources, strict=True)]
    )
    named = tables.clean_names(wide)
    sums = named.agg(*[F.round(F.sum(c), 2).alias(c) for c in named.columns])
    return relational.to_long(sums.withColumn("all", F.lit(1)), ["all"], named.columns, "header", "total").drop("all")


@query
def q_renamed_samples(spark, d):
    """Sample columns renamed by a function of their names and counted anew, then picked by a
    pattern."""
    wide, _ = views.matrix(spark, d)
    flags = {"A": "first", "N": "second", "R": "third"}
    named = tables.rename_samples(wide, lambda old: flags[old.split("_")[0]], 3)
    wanted = relational.columns_like(named, "^(first|third)_[12]$")
    return rounded(tables.wide_to_long(named.select("identifier", *wanted), wanted), "y")


# --- filters ------------------------------------------------------------------------


@query
def q_truth_count(spark, d):
    m = views.measurements(spark, d)
    return m.groupBy(labels.truth_flag(TRUTH).alias("truth")).agg(F.count(F.lit(1)).alias("n"))


@query
def q_all_null_filter(spark, d):
    m = views.measurements(spark, d, "heavy")
    return rounded(relational.drop_all_missing(m, ("identifier", "condition")), "y")


@query
def q_complete_cases(spark, d):
    return rounded(relational.complete_cases(views.measurements(spark, d, "light")), "y")


@query
def q_membership(spark, d):
    lines = views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    wanted = views.table(spark, d, "part").where(F.col("p_brand").rlike("^Brand#[123]$"))
    return relational.members(lines, wanted.select(F.col("p_partkey").alias("l_partkey")), "l_partkey")


@query
def q_first_comparison(spark, d):
    t = ttest.t_statistics(profile(spark, d), CONTRASTS)
    first = relational.first_comparison(t, CONTRASTS).where(F.col("t").isNotNull())
    return rounded(first.select("identifier", "comparison", "t"), "t")


@query
def q_pairwise_complete(spark, d):
    p = profile(spark, d, "heavy")
    pair = p.select("identifier", *[F.col("cells")[c]["mean"].alias(n) for n, c in (("a", "A"), ("b", "N"))])
    return rounded(pair.where("a is not null and b is not null"), "a", "b")


# --- columns and labels ---------------------------------------------------------------


@query
def q_zero_to_null(spark, d):
    lines = views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"
    )
    return relational.zero_as_missing(lines)


@query
def q_unlog(spark, d):
    parts = views.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return relational.unlog(parts, ["p_size"])


@query
def q_separate_unite(spark, d):
    orders = views.table(spark, d, "orders")
    code = F.split("o_orderpriority", "-")
    label = F.concat(F.lit("Single-Imputation+"), code[1])
    parts = F.split(label, r"\+")
    return orders.select(
        "o_orderkey",
        parts[0].alias("imputation"),
        parts[1].alias("method"),
        F.concat_ws("-", "o_orderstatus", F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("cls_prd"),
    )


@query
def q_regex_labels(spark, d):
    brand = F.col("p_brand")
    return views.table(spark, d, "part").select(
        "p_partkey",
        labels.replace_all(F.col("p_name"), {"red": "RED", "blue": "BLUE"}).alias("every"),
        labels.replace_first(brand, "[0-9]", "n").alias("first_only"),
        labels.remove(brand, "Brand#").alias("removed"),
        F.concat(brand, F.lit("_"), F.col("p_size").cast("string")).alias("joined"),
        F.round(F.sqrt(F.abs("p_retailprice")), 1).alias("root"),
    )


@query
def q_pair_canonical(spark, d):
    """Labels in both directions and spellings, of names whose numbers do not sort as text."""
    names = ["ng50", "ng100", "fmol25", "fmol100"]
    name = F.array(*[F.lit(n) for n in names])
    key = F.col("o_orderkey")
    left, right = (key % 4).cast("int"), ((key % 4 + 1 + F.col("o_custkey") % 3) % 4).cast("int")
    sep = F.when(F.col("o_orderstatus") == "F", " Vs ").otherwise(" vs ")
    orders = views.table(spark, d, "orders").select(
        "o_orderkey",
        F.concat(F.get(name, left), sep, F.get(name, right)).alias("comparison"),
        F.col("o_totalprice").alias("lfc"),
    )
    return labels.orient_results(orders, schema.pairwise_contrasts(names[:3]))


@query
def q_order_dimension(spark, d):
    orders = views.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return labels.with_level(orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "level")


@query
def q_infreq(spark, d):
    return labels.frequency_levels(views.table(spark, d, "orders"), "o_orderpriority")


@query
def q_left_join_fill(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id")
    known = views.table(spark, d, "labels").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("cls")
    )
    filled = docs.join(known, "doc_id", "left").na.fill("Discarded", subset=["cls"])
    return labels.order_by_frequency(filled, "cls").select("doc_id", "cls", "level")


@query
def q_crosstab(spark, d):
    return relational.crosstab(views.table(spark, d, "labels"), "quality", "toxic", [0, 1])


# --- reshape ----------------------------------------------------------------------------


@query
def q_pivot(spark, d):
    return ensemble.wide_scores(views.scores(spark, d), METHODS)


@query
def q_unpivot(spark, d):
    wide = ensemble.wide_scores(views.scores(spark, d), METHODS)
    picked = relational.column_range(wide, METHODS[0], METHODS[-1])
    return relational.to_long(wide, ["identifier", "comparison"], picked, "method", "score")


@query
def q_nest_unnest(spark, d):
    s = views.scores(spark, d).select("identifier", "comparison", "method", "score", "lfc")
    return relational.unnest(relational.nest(s, ["identifier", "comparison"]))


@query
def q_join_methods(spark, d):
    s = views.scores(spark, d)
    # a method has no score where the fold change is small
    parts = {
        m: s.where(F.col("method") == m).withColumn("score", F.when(F.col("lfc") > 100 * i, F.col("score")))
        for i, m in enumerate(METHODS)
    }
    return ensemble.join_method_tables(parts, METHODS[0])


@query
def q_group_value(spark, d):
    m = views.measurements(spark, d).select("identifier", "condition", "replicate")
    return relational.with_group_value(m, ["identifier"], {"n": F.count(F.lit(1))})


@query
def q_contrasts(spark, d):
    design = schema.design_table(views.measurements(spark, d))
    sizes = design.select(F.col("condition").alias("cond_a"), F.col("replicates").alias("n_a"))
    pairs = schema.contrast_table(design, ["R", "A", "N", "X"]).join(sizes, "cond_a")
    return pairs.join(sizes.toDF("cond_b", "n_b"), "cond_b").select(
        "comparison", "cond_a", "cond_b", "n_a", "n_b"
    )


@query
def q_design_matrix(spark, d):
    """Samples per condition as column sums of the one-hot design."""
    matrix = schema.design_matrix(views.measurements(spark, d), views.CONDITIONS)
    return matrix.agg(*[F.sum(f"is_{c}").alias(f"n_{c}") for c in views.CONDITIONS])


@query
def q_contrast_matrix(spark, d):
    design = schema.design_table(views.measurements(spark, d)).select("condition")
    return schema.contrast_matrix(design, CONTRASTS)


# --- moments, normalisation, tests --------------------------------------------------------


@query
def q_condition_moments(spark, d):
    cells = moments.cell_moments(views.measurements(spark, d, "light"))
    sd = F.sqrt(F.try_divide("ss", "n")).alias("sd")
    return rounded(cells.select("identifier", "condition", "n", "mean", sd), "mean", "sd")


@query
def q_row_stats(spark, d):
    return rounded(moments.row_stats(profile(spark, d, "light")), "mean", "sd", "sd_p")


@query
def q_lfc(spark, d):
    return rounded(moments.log_fold_changes(profile(spark, d, "heavy"), CONTRASTS), "lfc")


@query
def q_psrn(spark, d):
    out = normalize.pseudo_reference_normalise(views.balanced(spark, d), n_samples=3)
    return rounded(out.select("identifier", "sample", "y"), "y")


@query
def q_psrn_wide(spark, d):
    """The wide matrix normalised row by row, then made long."""
    return rounded(study.normalised(*views.matrix(spark, d)), "y")


@query
def q_psrn_human(spark, d):
    """A wide matrix in the shape of the human design: 3 conditions of 23 samples."""
    return rounded(study.normalised(*views.suppliers(spark, d)), "y")


@query
def q_ttest_ramus(spark, d):
    """The 36 contrasts of the nine conditions of the ramus design."""
    contrasts = study.preset("ramus").contrasts
    p = moments.direct_profiles(views.nine_conditions(spark, d), study.RAMUS_CONDITIONS)
    t = ttest.t_test(p, contrasts).where(F.col("p_val").isNotNull())
    return rounded(t, "p_val", "lfc")


@query
def q_tstat(spark, d):
    t = ttest.t_statistics(profile(spark, d), CONTRASTS).where(F.col("t").isNotNull())
    return rounded(t, "t", "lfc")


@query
def q_ttest_p(spark, d):
    t = ttest.t_test(profile(spark, d), CONTRASTS).where(F.col("p_val").isNotNull())
    return rounded(t, "p_val", "lfc")


@query
def q_ttest_fdr(spark, d):
    t = ttest.t_test(profile(spark, d), CONTRASTS, adjust=True).where(F.col("p_val").isNotNull())
    return rounded(t, "p_val", "lfc")


@query
def q_bh(spark, d):
    s = views.scores(spark, d).select("method", "identifier", "comparison", "score")
    q = multiplicity.benjamini_hochberg(s, ["method", "comparison"], "score", "q_val")
    return rounded(q.drop("score"), "q_val", digits=9)


@query
def q_binom_tail(spark, d):
    hits = views.measurements(spark, d).groupBy("identifier").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("condition") == "A").alias("k")
    )
    return hits.select(
        "identifier", "k", "n", F.round(binomial_upper("k", "n"), 9).alias("binom_p_value")
    )


# --- confusion, rates, areas ----------------------------------------------------------------

MC = ("method", "comparison")
CELLS = ("TP", "TN", "FP", "FN")
RATES = ("TPR", "FPR", "NPV", "precision", "accuracy", "MCC", "MCC2")


@query
def q_confusion_strict(spark, d):
    return roc.confusion(views.scores(spark, d), MC).select(*MC, "alpha", *CELLS)


@query
def q_confusion_inclusive(spark, d):
    s = views.scores(spark, d)
    return roc.confusion(s, MC, mode=roc.INCLUSIVE).select(*MC, "alpha", *CELLS)


@query
def q_rates_mcc(spark, d):
    return rounded(roc.roc(views.scores(spark, d), groups=MC), *RATES, digits=9)


@query
def q_pn_global(spark, d):
    table = roc.roc(views.scores(spark, d), groups=MC, mode=roc.INCLUSIVE, pn_scope="global")
    return rounded(table, *RATES, digits=9)


@query
def q_auroc(spark, d):
    """t-test scores of the planted effect, their strict ROC and its area."""
    t = ttest.t_statistics(profile(spark, d), CONTRASTS).where(F.col("t").isNotNull())
    scored = t.select(
        "identifier",
        "comparison",
        F.round(-F.abs("t"), 6).alias("score"),
        labels.truth_flag(TRUTH).alias("truth"),
    )
    return rounded(roc.auroc(roc.roc(scored)), "auROC", digits=9)


@query
def q_auroc_scores(spark, d):
    return rounded(roc.auroc_of_scores(views.scores(spark, d), MC), "auROC", digits=9)


@query
def q_auroc_label_pos(spark, d):
    areas = rounded(roc.auroc_of_scores(views.scores(spark, d), MC), "auROC", digits=9)
    return rounded(roc.label_positions(areas), "FPR", digits=9)


@query
def q_decomposed(spark, d):
    s = views.scores(spark, d)
    share = s.agg(F.avg(F.col("truth").cast("double"))).first()[0]
    names = {"pre": "Pre", "FPR": "False Positive Rate", "TPR": "True Positive Rate"}
    long = roc.decompose(roc.roc(s, groups=MC), ["TPR", "FPR", "precision"], share, names)
    return rounded(long, "value", "intercept", digits=9)


@query
def q_alpha_between(spark, d):
    table = roc.roc(views.scores(spark, d), groups=MC).where(F.col("alpha").between(0, 0.2))
    long = roc.decompose(table, ["TP", "FP", "precision"], 0.0, {})
    return rounded(long.drop("intercept", "slope"), "value", digits=9)


def both_rocs(spark, d):
    s = views.scores(spark, d)
    first = roc.roc(s, groups=MC).withColumn("dataset", F.lit("first"))
    second = roc.roc(s, groups=MC, mode=roc.INCLUSIVE).withColumn("dataset", F.lit("second"))
    return relational.union_all([first, second.drop("accuracy", "MCC2")]).drop(*CELLS)


@query
def q_union_fill(spark, d):
    return rounded(both_rocs(spark, d), *RATES, digits=9)


@query
def q_slice_max(spark, d):
    s = views.scores(spark, d).select("method", "identifier", "comparison", "score")
    return roc.largest_per_group(s, MC, "score")


@query
def q_method_summary(spark, d):
    named = both_rocs(spark, d).withColumn(
        "method", labels.unify_methods(F.col("method"), r"Single-Imputation\+", {"^s": "S"})
    )
    return rounded(roc.method_summary(named), "mean", digits=9)


@query
def q_thin(spark, d):
    alpha = ((F.col("o_totalprice") + 1) / 500001).alias("alpha")
    return rounded(roc.thin(views.table(spark, d, "orders").select(alpha), limit=1000), "alpha", digits=9)


# --- weights and ensemble ---------------------------------------------------------------------


@query
def q_spearman_weights(spark, d):
    weights = ensemble.method_weights(ensemble.rank_correlation(views.scores(spark, d)))
    return rounded(weights, "rho", "weight", digits=9)


@query
def q_weights_degenerate(spark, d):
    """A method on one plateau and one that is all zero have no rank correlation and no weight."""
    s = views.degenerate_scores(spark, d)
    return rounded(ensemble.method_weights(ensemble.rank_correlation(s)), "rho", "weight", digits=9)


@query
def q_zero_floor_degenerate(spark, d):
    """Zeros stay where a group has nothing else."""
    return ensemble.floor_zeros(views.degenerate_scores(spark, d)).select(
        "method", "identifier", "comparison", "score"
    )


@query
def q_zero_floor(spark, d):
    return ensemble.floor_zeros(views.scores(spark, d)).select(
        "method", "identifier", "comparison", "score"
    )


@query
def q_ensemble(spark, d):
    s = views.scores(spark, d)
    weights = ensemble.method_weights(ensemble.rank_correlation(s))
    absent = F.expr("(method = 'ttest' and lfc > 300) or (method = 'shrunk' and lfc < -100)")
    floored = ensemble.floor_zeros(s).withColumn("score", F.when(~absent, F.col("score")))
    combined = ensemble.ensemble(floored, weights, anchor="shrunk")
    return rounded(combined.withColumn("support", 1 - F.col("score")), "score", "support", digits=9)


# --- imputation -----------------------------------------------------------------------------------

IMPUTATIONS = 20


class Missing:
    """Measurements with gaps, their cells and the two numbers imputation needs."""

    def __init__(self, spark, d):
        self.rows = materialise(views.measurements(spark, d, "light"))
        self.cells = materialise(moments.cell_moments(self.rows))
        stats = moments.row_stats(moments.profiles(self.cells.where("n > 0")))
        self.trend = trend.fit_gamma_trend(materialise(stats), "sd_p")
        self.low = impute.low_tail(self.cells)

    def draws(self, m: int) -> DataFrame:
        return impute.imputation_draws(self.rows, self.cells, self.trend, self.low, m)

    def profiles(self, m: int, weighted: bool = False, expand: bool = True) -> DataFrame:
        weight = self.trend.precision_weight(F.col("y")) if weighted else None
        observed = moments.direct_profiles(self.rows, views.CONDITIONS, weight=weight)
        gaps = self.cells.agg(F.sum("gaps")).first()[0] or 0
        return impute.imputed_profiles(observed, self.draws(m), m, weight, expand, gaps * m)

    def tests(self, m: int, weighted: bool = False, **options) -> DataFrame:
        """Moderated tests of ``m`` imputations, one row per block of identifiers."""
        draws = vectors.draw_vectors(self.rows, self.cells, self.trend, self.low, m)
        weight = self.trend if weighted else None
        profiles = vectors.vector_profiles(self.rows, draws, m, views.CONDITIONS, weight)
        return vectors.vector_tests(profiles, CONTRASTS, m, weighted=weighted, **options)


@query
def q_impute_single(spark, d):
    g = Missing(spark, d)
    return rounded(impute.single_imputation(g.rows, g.cells, g.trend, g.low), "y")


@query
def q_impute_multi(spark, d):
    return rounded(Missing(spark, d).draws(IMPUTATIONS), "y")


@query
def q_imputed_cells(spark, d):
    p = Missing(spark, d).profiles(IMPUTATIONS, weighted=True)
    cells = p.select("imputation", "identifier", F.explode("cells").alias("condition", "m"))
    flat = cells.select(
        "imputation", "identifier", "condition", "m.n", "m.mean",
        F.sqrt(F.col("m.ss") / F.col("m.n")).alias("sd"), "m.w", "m.wmean", "m.wss",
    )
    return rounded(flat, "mean", "sd", "w", "wmean", "wss")


# --- moderated test ---------------------------------------------------------------------------------


def moderated_results(spark, d, weighted=False, m: int = IMPUTATIONS, **options) -> DataFrame:
    p = Missing(spark, d).profiles(m, weighted, expand=False)
    rows = materialise(moderated.residual_variance(p, weighted))
    return moderated.moderated_t(rows, CONTRASTS, weighted=weighted, m=m, **options)


def shown(tests: DataFrame) -> DataFrame:
    return rounded(rounded(tests, "t", "p_val", "lfc"), "df_total", digits=4)


@query
def q_moderated_plain(spark, d):
    return shown(moderated_results(spark, d))


@query
def q_moderated_trend(spark, d):
    return shown(moderated_results(spark, d, trend=True))


@query
def q_moderated_weighted(spark, d):
    return shown(moderated_results(spark, d, weighted=True))


@query
def q_moderated_robust(spark, d):
    return shown(moderated_results(spark, d, trend=True, robust=True))


@query
def q_moderated_full(spark, d):
    """Weighted, trended and robust: the combination that studies run."""
    return shown(moderated_results(spark, d, weighted=True, trend=True, robust=True))


@query
def q_variance_prior(spark, d):
    rows = materialise(
        moderated.residual_variance(Missing(spark, d).profiles(IMPUTATIONS, expand=False))
    )
    prior = moderated.variance_prior(rows, ["imputation"], trend=True, robust=True, m=IMPUTATIONS)
    return rounded(rounded(prior.drop("centre"), "b0", "b1", "b2"), "d0", digits=4)


# --- consensus -----------------------------------------------------------------------------------------


def trend_consensus(spark, d) -> tuple[DataFrame, DataFrame]:
    """Consensus of the trended test from vectors of imputations, and its thresholds."""
    tests = Missing(spark, d).tests(IMPUTATIONS, trend=True)
    thresholds = materialise(vectors.vector_thresholds(tests, IMPUTATIONS, COMPARISONS[0]))
    return materialise(vectors.vector_consensus(tests, IMPUTATIONS, last=True)), thresholds


@query
def q_consensus(spark, d):
    summary = trend_consensus(spark, d)[0].drop("critical")
    return rounded(rounded(summary, "median_p_val", "median_lfc"), "binom_p_value", digits=9)


@query
def q_consensus_methods(spark, d):
    """Two methods in one pass, keyed by method, with their critical thresholds."""
    needed = ["imputation", "identifier", "comparison", "p_val", "lfc"]

    def tests(name: str, **options) -> DataFrame:
        found = finished(spark, lambda: moderated_results(spark, d, **options).select(*needed))
        return found.withColumn("method", F.lit(name))

    def agreed() -> DataFrame:
        adjusted = consensus.adjust_within_imputation(both, ["method"])
        return consensus.consensus_table(adjusted, IMPUTATIONS, by=["method"])

    both = relational.union_all(
        [tests("trend", trend=True), tests("full", weighted=True, trend=True, robust=True)]
    )
    table = finished(spark, agreed)
    return rounded(
        rounded(table, "median_p_val", "median_lfc", "critical"), "binom_p_value", digits=9
    )


@query
def q_min_alpha(spark, d):
    return rounded(consensus.min_alpha(*trend_consensus(spark, d)), "min_alpha")


@query
def q_consensus_roc(spark, d):
    table, thresholds = trend_consensus(spark, d)
    labelled = table.withColumn("truth", labels.truth_flag(TRUTH))
    cells = consensus.consensus_roc(labelled, thresholds, COMPARISONS)
    return rounded(cells.select("comparison", "alpha", *CELLS), "alpha")


@query
def q_survivor_roc(spark, d):
    """ROC of the critical threshold; totals count only pairs that ever were significant."""
    found = consensus.min_alpha(*trend_consensus(spark, d)).select(
        "identifier",
        "comparison",
        F.round("min_alpha", 6).alias("score"),
        labels.truth_flag(TRUTH).alias("truth"),
    )
    return rounded(roc.roc(found), *RATES, digits=9)


# --- gamma regression, partition, posterior, forest ---------------------------------------------------


def labelled_stats(spark, d) -> DataFrame:
    """Row statistics with the planted label as the upper trend."""
    upper = F.when(labels.truth_flag(TRUTH), trend.UPPER).otherwise(trend.LOWER)
    return materialise(moments.row_stats(profile(spark, d)).withColumn("c", upper))


@query
def q_gamma_glm(spark, d):
    stats = labelled_stats(spark, d)
    fits = trend.fit_gamma_trends(stats, {terms: trend.Regression("sd", terms) for terms in trend.TERMS})
    rows = [(terms, *fit) for terms, fit in fits.items()]
    columns = "intercept slope upper_intercept upper_slope dispersion".split()
    table = spark.createDataFrame(rows, "terms string, " + ", ".join(f"{c} double" for c in columns))
    return rounded(table, *columns, digits=5)


def partition(spark, d) -> trend.Partition:
    stats = moments.row_stats(profile(spark, d))
    return trend.partition_trends(stats, 10, 10, (0.05, 0.4), (0.05, 0.4))


@query
def q_partition_grid(spark, d):
    grid = partition(spark, d).grid
    return rounded(rounded(grid.drop("rank"), "h1", "h2"), "score", digits=5)


@query
def q_partition(spark, d):
    return partition(spark, d).labelled.select("identifier", "c")


@query
def q_posterior_err(spark, d):
    prior = trend.fit_gamma_trend(labelled_stats(spark, d), "sd")
    rows = views.measurements(spark, d)
    weight = prior.precision_weight(F.col("y"))
    p = moments.direct_profiles(rows, views.CONDITIONS, weight=weight)
    return rounded(posterior.decision_error(p, prior, CONTRASTS).where("lfc is not null"), "z", "err", "lfc")


@query
def q_posterior_labelled(spark, d):
    prior = trend.fit_gamma_trend(labelled_stats(spark, d), "sd", "mean+c")
    upper = F.when(labels.truth_flag(TRUTH), trend.UPPER).otherwise(trend.LOWER)
    rows = views.measurements(spark, d).withColumn("c", upper)
    keys = ("identifier", "c")
    weight = prior.precision_weight(F.col("y"), F.col("c"))
    p = moments.direct_profiles(rows, views.CONDITIONS, keys, weight=weight)
    errors = posterior.decision_error(p, prior, CONTRASTS, "c").where("lfc is not null")
    return rounded(errors, "z", "err", "lfc")


@query
def q_filter_features(spark, d):
    features = classify.filter_features(profile(spark, d, "heavy"), CONTRASTS, TRUTH)
    return rounded(features, "mean", "sd", *classify.feature_names(CONTRASTS)[2:])


def forest(spark, d) -> tuple[DataFrame, DataFrame]:
    return study.identifiers_to_keep(views.measurements(spark, d, "light"), CONTRASTS, TRUTH)


@query
def q_forest_keep(spark, d):
    return classify.keep_list(forest(spark, d)[1])


@query
def q_forest_classes(spark, d):
    """How many rows of each class the forest has judged: all with complete features."""
    judged = forest(spark, d)[1].groupBy("class").agg(F.count(F.lit(1)).alias("judged"))
    return judged


@query
def q_forest_compiled(spark, d):
    """A small forest judges all rows twice, as a fitted model and as SQL made from its trees:
    how many rows of each class it has judged, and on how many both agree."""
    names = classify.feature_names(CONTRASTS)
    everything = materialise(
        classify.filter_features(profile(spark, d, "heavy"), CONTRASTS, TRUTH)
    )
    model = classify.fit_filter(everything, names, trees=8, depth=5)
    sql = classify.forest_sql(classify.forest_nodes(model, spark), names)
    full = everything.na.drop("any", subset=names)
    both = classify.predict_class(model, full, names).join(
        full.select("identifier", F.expr(sql).alias("by_sql")), "identifier"
    )
    return both.groupBy("class").agg(
        F.count(F.lit(1)).alias("judged"), F.count_if(F.col("pred") == F.col("by_sql")).alias("agreed")
    )


def by_rule(spark, d) -> tuple[DataFrame, DataFrame]:
    """Features and predictions of a fixed rule in place of the forest."""
    features = materialise(classify.filter_features(profile(spark, d, "heavy"), CONTRASTS, TRUTH))
    full = features.na.drop("any", subset=classify.feature_names(CONTRASTS))
    lifted = F.round("A_vs_N", 6) + F.round("A_vs_R", 6) > 0.8
    pred = F.when(lifted, "TP").otherwise("TN")
    return features, full.select("identifier", "class", F.concat_ws("-", "class", pred).alias("cls_prd"))


@query
def q_keep_rule(spark, d):
    return classify.keep_list(by_rule(spark, d)[1])


@query
def q_labels_rule(spark, d):
    return classify.with_predictions(*by_rule(spark, d)).select("identifier", "cls_prd", "level")


@query
def q_forest_labels(spark, d):
    everything, predicted = forest(spark, d)
    return classify.with_predictions(everything, predicted).select("identifier", "cls_prd", "level")


IMPUTATIONS_OF_STUDIES = 1000


def consensus_parts(spark, d, m: int) -> DataFrame:
    """Consensus of the weighted, trended and robust test over ``m`` imputations (part
    "pairs") and its ROC at all thresholds (part "roc")."""
    tests = Missing(spark, d).tests(m, weighted=True, trend=True, robust=True)
    thresholds = materialise(vectors.vector_thresholds(tests, m, COMPARISONS[0]))
    table = materialise(vectors.vector_consensus(tests, m, last=True))
    pairs = rounded(
        rounded(table, "median_p_val", "median_lfc", "critical"), "binom_p_value", digits=9
    )
    labelled = table.withColumn("truth", labels.truth_flag(TRUTH))
    cells = consensus.consensus_roc(labelled, thresholds, COMPARISONS)
    cells = rounded(cells.select("comparison", "alpha", *CELLS), "alpha")
    return pairs.withColumn("part", F.lit("pairs")).unionByName(
        cells.withColumn("part", F.lit("roc")), allowMissingColumns=True
    )


@query
def q_consensus_1000(spark, d):
    """Consensus and ROC over as many imputations as studies use; too many tests for the SQL,
    which follows :func:`q_consensus_vectors` for fewer."""
    return consensus_parts(spark, d, IMPUTATIONS_OF_STUDIES)


@query
def q_consensus_vectors(spark, d):
    """The tables of :func:`q_consensus_methods` from vectors of imputations."""
    gaps = Missing(spark, d)
    options = {"trend": {"trend": True}, "full": {"weighted": True, "trend": True, "robust": True}}
    tables = []
    for name, chosen in options.items():  # one after the other, as the tests of a method are large
        tests = gaps.tests(IMPUTATIONS, **chosen)
        tables.append(vectors.vector_consensus(tests, IMPUTATIONS, last=True).withColumn("method", F.lit(name)))
    table = relational.union_all(tables)
    return rounded(
        rounded(table, "median_p_val", "median_lfc", "critical"), "binom_p_value", digits=9
    )


@query
def q_consensus_spline(spark, d):
    """Consensus of the test whose prior follows a natural spline over the level."""
    tests = Missing(spark, d).tests(IMPUTATIONS, trend=vectors.SPLINE)
    table = vectors.vector_consensus(tests, IMPUTATIONS, last=True)
    return rounded(
        rounded(table, "median_p_val", "median_lfc", "critical"), "binom_p_value", digits=9
    )


# --- whole study ------------------------------------------------------------------------------------------


def study_options(**changes) -> study.StudyOptions:
    """Imputations and grids of all studies; the range of the partition is that of the fixture."""
    base = {"h1_prop": (0.01, 0.3), "h2_prop": (0.01, 0.3)}
    return study.StudyOptions(CONTRASTS, TRUTH, **(base | changes))


@query
def q_study(spark, d):
    """Area under ROC of every method, from the linear wide matrix."""
    wide, samples = views.matrix(spark, d)
    done = study.run_study(study.normalised(wide, samples), study_options())
    return rounded(done.areas, "auROC", digits=4)
