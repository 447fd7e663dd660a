"""Confusion counts and rates at every threshold, area under ROC, metric summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.operators.ordered import range_buckets, row_index, running_sums, trapezoid
from diffspark.stage import materialise

STRICT = "strict"
INCLUSIVE = "inclusive"

CELLS = ("TP", "TN", "FP", "FN")

# Thresholds appended to the observed scores, by mode and scope.
SENTINELS = {
    (STRICT, "group"): (1.1,),
    (STRICT, "global"): (1.1,),
    (INCLUSIVE, "group"): (-0.1,),
    (INCLUSIVE, "global"): (-0.1, 0.0),
}


def _rates() -> dict[str, Column]:
    c = F.col
    tp, tn, fp, fn = (c(x).cast("double") for x in CELLS)
    return {
        "TPR": F.try_divide(c("TP"), c("P")),
        "FPR": F.try_divide(c("FP"), c("N")),
        "NPV": F.try_divide(tn, tn + fn),
        "precision": F.try_divide(tp, tp + fp),
        "accuracy": F.try_divide(tp + tn, c("P") + c("N")),
        "MCC2": F.try_divide(
            tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        ),
    }


def add_rates(cells: DataFrame) -> DataFrame:
    """Rates from TP, TN, FP, FN and the fixed totals P and N; 0/0 is NULL."""
    c = F.col
    with_rates = cells.withColumns(_rates())
    good = F.sqrt("precision") * F.sqrt("TPR") * F.sqrt(1 - c("FPR")) * F.sqrt("NPV")
    bad = (
        F.sqrt(1 - c("precision"))
        * F.sqrt(1 - c("TPR"))
        * F.sqrt("FPR")
        * F.sqrt(1 - c("NPV"))
    )
    keep = [x for x in cells.columns if x not in ("P", "N")]
    return with_rates.withColumn("MCC", good - bad).select(
        *keep, "TPR", "FPR", "NPV", "precision", "accuracy", "MCC", "MCC2"
    )


def _score_counts(scores, groups, score, truth) -> DataFrame:
    """Positives and negatives per distinct score: the only rows that get shuffled."""
    return scores.groupBy(*groups, F.col(score).alias("alpha")).agg(
        F.count_if(F.col(truth)).alias("p_all"), F.count_if(~F.col(truth)).alias("n_all")
    )


def _scored(counts: DataFrame) -> DataFrame:
    """Unscored rows count towards P and N but are in no cell."""
    present = F.col("alpha").isNotNull()
    return counts.withColumns(
        {
            "pos": F.when(present, F.col("p_all")).otherwise(F.lit(0)),
            "neg": F.when(present, F.col("n_all")).otherwise(F.lit(0)),
        }
    )


def _cells(mode: str, below: tuple[Column, Column], at: tuple[Column, Column], total) -> list[Column]:
    """The four cells from counts below the threshold, at it and overall.

    strict: a score equal to the threshold is in no cell; inclusive: in two.
    """
    (pb, nb), (pa, na), (pt, nt) = below, at, total
    if mode == STRICT:
        tp, fp, fn, tn = pb, nb, pt - pb - pa, nt - nb - na
    elif mode == INCLUSIVE:
        tp, fp, fn, tn = pb + pa, nb + na, pt - pb, nt - nb
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return [tp.alias("TP"), tn.alias("TN"), fp.alias("FP"), fn.alias("FN")]


def confusion(
    scores: DataFrame,
    groups: Sequence[str] = ("comparison",),
    score: str = "score",
    truth: str = "truth",
    mode: str = STRICT,
    pn_scope: str = "group",
    identifier: str = "identifier",
    comparison: str = "comparison",
    sentinels: Sequence[float] | None = None,
) -> DataFrame:
    """Cells and totals P, N at every distinct score of each group plus the sentinels.

    ``pn_scope="global"`` takes P and N from the distinct identifiers over all
    comparisons instead of from the group's own rows.
    """
    groups = list(groups)
    if sentinels is None:
        sentinels = SENTINELS[(mode, pn_scope)]
    counts = _scored(_score_counts(scores, groups, score, truth))
    bucketed = range_buckets(counts, groups, ["alpha"])
    c = F.col
    at_scores = running_sums(
        bucketed, groups, ["alpha"], ["pos", "neg"], totals=["p_all", "n_all"]
    ).where(c("alpha").isNotNull())
    scored = at_scores.select(
        *groups,
        "alpha",
        *_cells(
            mode,
            (c("pos_before"), c("neg_before")),
            (c("pos"), c("neg")),
            (c("pos_total"), c("neg_total")),
        ),
        c("p_all_total").alias("P"),
        c("n_all_total").alias("N"),
    )
    parts = scored
    if sentinels:
        aggs = [F.sum(x).alias(x) for x in ("pos", "neg", "p_all", "n_all")]
        for i, s in enumerate(sentinels):
            for x in ("pos", "neg"):
                aggs.append(F.sum(F.when(c("alpha") < s, c(x)).otherwise(0)).alias(f"{x}_below{i}"))
                aggs.append(F.sum(F.when(c("alpha") == s, c(x)).otherwise(0)).alias(f"{x}_at{i}"))
            aggs.append(F.coalesce(F.bool_or(c("alpha") == s), F.lit(False)).alias(f"seen{i}"))
        summary = bucketed.groupBy(*groups).agg(*aggs)
        for i, s in enumerate(sentinels):
            parts = parts.unionByName(
                summary.where(~c(f"seen{i}")).select(
                    *groups,
                    F.lit(float(s)).alias("alpha"),
                    *_cells(
                        mode,
                        (c(f"pos_below{i}"), c(f"neg_below{i}")),
                        (c(f"pos_at{i}"), c(f"neg_at{i}")),
                        (c("pos"), c("neg")),
                    ),
                    c("p_all").alias("P"),
                    c("n_all").alias("N"),
                )
            )
    if pn_scope == "global":
        outer = [g for g in groups if g != comparison]
        parts = _with_global_totals(parts, scores, outer, identifier, truth)
    return parts


def _with_global_totals(parts, scores, outer, identifier, truth) -> DataFrame:
    ids = scores.select(*outer, identifier, truth).distinct()
    totals = ids.groupBy(*outer).agg(
        F.count_if(F.col(truth)).alias("P"), F.count_if(~F.col(truth)).alias("N")
    )
    bare = parts.drop("P", "N")
    if outer:
        return bare.join(materialise(totals), outer)
    row = totals.first()
    return bare.withColumns({"P": F.lit(row["P"]), "N": F.lit(row["N"])})


def confusion_at(
    scores: DataFrame,
    thresholds: DataFrame,
    comparisons: Sequence[str],
    score: str = "score",
    truth: str = "truth",
    by: Sequence[str] = (),
) -> DataFrame:
    """Cells of the decision ``score < alpha`` at given thresholds, shared by all comparisons.

    ``by`` are further keys, such as the method, that scores and thresholds both carry.
    Every row is decided one way or the other, so TN and FN are the complements. Rows
    without a score are never called. Thresholds and scores travel through one ordered
    pass; ``comparisons`` is the contrast list of the study.
    """
    groups = [*by, "comparison"]
    counts = _score_counts(scores, groups, score, truth).withColumn("wanted", F.lit(False))
    grid = thresholds.select(
        *by,
        F.explode(F.array(*[F.lit(x) for x in comparisons])).alias("comparison"),
        F.col("alpha").cast("double").alias("alpha"),
        F.lit(0).cast("long").alias("p_all"),
        F.lit(0).cast("long").alias("n_all"),
        F.lit(True).alias("wanted"),
    )
    merged = (
        counts.unionByName(grid)
        .groupBy(*groups, "alpha")
        .agg(
            F.sum("p_all").alias("p_all"),
            F.sum("n_all").alias("n_all"),
            F.bool_or("wanted").alias("wanted"),
        )
    )
    bucketed = range_buckets(_scored(merged), groups, ["alpha"])
    c = F.col
    walked = running_sums(
        bucketed, groups, ["alpha"], ["pos", "neg"], totals=["p_all", "n_all"]
    ).where(c("wanted") & c("alpha").isNotNull())
    return walked.select(
        *groups,
        "alpha",
        c("pos_before").alias("TP"),
        (c("n_all_total") - c("neg_before")).alias("TN"),
        c("neg_before").alias("FP"),
        (c("p_all_total") - c("pos_before")).alias("FN"),
        c("p_all_total").alias("P"),
        c("n_all_total").alias("N"),
    )


def roc(scores: DataFrame, **options) -> DataFrame:
    """:func:`confusion` with rates."""
    return add_rates(confusion(scores, **options))


def auroc(roc_table: DataFrame, groups: Sequence[str] = ("comparison",)) -> DataFrame:
    """Trapezoid area of a ROC table, points ordered by (FPR, TPR)."""
    return trapezoid(roc_table, list(groups), "FPR", "TPR", "auROC")


def auroc_of_scores(
    scores: DataFrame,
    groups: Sequence[str] = ("comparison",),
    score: str = "score",
    truth: str = "truth",
) -> DataFrame:
    """Area of the strict ROC straight from the scores, without building the ROC table.

    The step over a distinct score adds its negatives times the mean of the positives
    before and after it.
    """
    groups = list(groups)
    counts = _scored(_score_counts(scores, groups, score, truth))
    bucketed = range_buckets(counts, groups, ["alpha"])
    c = F.col
    walked = running_sums(bucketed, groups, ["alpha"], ["pos"], totals=["p_all", "n_all"])
    strip = c("neg") * (c("pos_before") + c("pos") / 2)
    return walked.groupBy(*groups).agg(
        F.try_divide(
            F.sum(strip), F.max(c("p_all_total").cast("double") * c("n_all_total"))
        ).alias("auROC")
    )


def label_positions(
    areas: DataFrame, groups: Sequence[str] = ("comparison",), low: float = 0.1, high: float = 0.98
) -> DataFrame:
    """Evenly spaced label positions by falling auROC; a lone row sits at ``low``."""
    groups = list(groups)
    ranked = areas.withColumns({"_down": -F.col("auROC")})
    placed = row_index(ranked, groups, ["_down", "method"])
    gap = F.try_divide(F.lit(high - low), F.col("size") - 1)
    return placed.select(
        *areas.columns,
        (F.lit(low) + F.coalesce((F.col("index") - 1) * gap, F.lit(0.0))).alias("FPR"),
        F.lit(0.0).alias("TPR"),
    )


def thin(
    values: DataFrame, value: str = "alpha", limit: int = 2000, groups: Sequence[str] = ()
) -> DataFrame:
    """Systematic thinning of the sorted distinct values to ``limit`` of them.

    Position i (1-based, of L) is kept when i = 1 + floor(k (L-1) / (limit-1)) for some
    k; lists of up to ``limit`` values are kept whole.
    """
    distinct = values.select(*groups, value).distinct()
    placed = row_index(distinct, list(groups), [value])
    k = f"((({limit - 1} * (index - 1)) + size - 2) div greatest(size - 1, 1))"
    hit = F.expr(f"{k} <= {limit - 1} and ({k} * (size - 1)) div {limit - 1} = index - 1")
    return placed.where((F.col("size") <= limit) | hit).select(*groups, value)


def decompose(
    roc_table: DataFrame, metrics: Sequence[str], baseline: Column | float, labels: dict[str, str]
) -> DataFrame:
    """Long table of metrics with the slope and intercept of each metric's chance line.

    Precision has a flat chance line at ``baseline`` (the share of positives), the other
    metrics the diagonal.
    """
    ids = [c for c in ("comparison", "method", "alpha") if c in roc_table.columns]
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    source = roc_table.select(
        *ids, base.alias("_base"), *[F.col(m).cast("double").alias(m) for m in metrics]
    )
    flat = F.col("name") == "precision"
    renamed = F.col("name")
    for old, new in labels.items():
        renamed = F.regexp_replace(renamed, old, new)
    return source.unpivot([*ids, "_base"], list(metrics), "name", "value").select(
        *ids,
        renamed.alias("name"),
        "value",
        F.when(flat, F.col("_base")).otherwise(0.0).alias("intercept"),
        F.when(flat, 0.0).otherwise(1.0).alias("slope"),
    )


def largest_per_group(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Rows holding the group's largest ``value``, ties kept, without sorting any group."""
    top = df.groupBy(*groups).agg(F.max(value).alias(value))
    return df.join(materialise(top), [*groups, value], "left_semi")


def method_summary(
    roc_tables: DataFrame, alpha: float = 0.05, metrics: Sequence[str] = ("TPR", "FPR", "precision", "accuracy", "MCC")
) -> DataFrame:
    """Mean of every metric at the largest threshold not above ``alpha``.

    Long form first, then the largest threshold per (comparison, method, dataset,
    metric), then the NULL-skipping mean over comparisons.
    """
    long = (
        roc_tables.where(F.col("alpha") <= alpha)
        .select("comparison", "method", "dataset", "alpha", *metrics)
        .unpivot(["comparison", "method", "dataset", "alpha"], list(metrics), "name", "value")
    )
    best = largest_per_group(long, ["comparison", "method", "dataset", "name"], "alpha")
    return best.groupBy("name", "dataset", "method").agg(F.avg("value").alias("mean"))
