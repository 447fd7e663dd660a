"""Condition moments, identifier profiles, row statistics, fold changes.

A *profile* is one row per identifier with a map condition -> (n, mean, ss), where ss is
the sum of squared deviations; weighted profiles also hold (w, wmean, wss). Every
statistic of a one-way design is a function of the profile, so contrasts, row statistics
and tests need no join and no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.schema import Contrast

PLAIN = ("n", "mean", "ss")
WEIGHTED = ("w", "wmean", "wss")


def cell_moments(
    measurements: DataFrame,
    keys: Sequence[str] = ("identifier",),
    value: str = "y",
    weight: Column | None = None,
) -> DataFrame:
    """n, mean and sum of squared deviations of each (keys, condition), NULLs skipped but
    counted as ``gaps``.

    Everything combines on the map side, so a hot identifier costs one row per task.
    """
    aggs = [
        F.count_if(F.col(value).isNull()).alias("gaps"),
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("ss"),
    ]
    if weight is None:
        return measurements.groupBy(*keys, "condition").agg(*aggs)
    w = F.when(F.col(value).isNotNull(), weight)
    y = F.col(value)
    sums = measurements.groupBy(*keys, "condition").agg(
        *aggs, F.sum(w).alias("w"), F.sum(w * y).alias("_wy"), F.sum(w * y * y).alias("_wyy")
    )
    return sums.select(
        *keys,
        "condition",
        "gaps",
        *PLAIN,
        *_weighted(F.col("w"), F.col("_wy"), F.col("_wyy"), F.col("n")),
    )


def _weighted(w: Column, wy: Column, wyy: Column, n: Column) -> list[Column]:
    """Weighted moments from the sums of w, w y and w y^2."""
    centred = wyy - F.try_divide(wy * wy, w)
    return [
        w.alias("w"),
        F.try_divide(wy, w).alias("wmean"),
        F.greatest(F.lit(0.0), F.when(n > 1, centred).otherwise(0.0)).alias("wss"),
    ]


def fields_of(columns: Sequence[str]) -> tuple[str, ...]:
    return (*PLAIN, *WEIGHTED) if "w" in columns else PLAIN


def profiles(cells: DataFrame, keys: Sequence[str] = ("identifier",)) -> DataFrame:
    """Cells of an identifier as one map; its size is the number of conditions."""
    entry = F.struct("condition", F.struct(*fields_of(cells.columns)).alias("m"))
    return cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("cells"))


def direct_profiles(
    measurements: DataFrame,
    conditions: Sequence[str],
    keys: Sequence[str] = ("identifier",),
    value: str = "y",
    weight: Column | None = None,
) -> DataFrame:
    """Profiles of the measured values in one shuffle, for a known, short list of conditions.

    The conditions are aggregated side by side, so rows combine to one per identifier
    before they are sent. Conditions without a value are left out.
    """
    aggs, entries = [], []
    for i, condition in enumerate(conditions):
        y = F.when(F.col("condition") == condition, F.col(value))
        aggs += [
            F.count(y).alias(f"n{i}"),
            F.avg(y).alias(f"mean{i}"),
            F.var_pop(y).alias(f"var{i}"),
        ]
        n = F.col(f"n{i}")
        cell = [n.alias("n"), F.col(f"mean{i}").alias("mean"), (F.col(f"var{i}") * n).alias("ss")]
        if weight is not None:
            w = F.when(y.isNotNull(), weight)
            aggs += [
                F.sum(w).alias(f"w{i}"),
                F.sum(w * y).alias(f"wy{i}"),
                F.sum(w * y * y).alias(f"wyy{i}"),
            ]
            cell += _weighted(F.col(f"w{i}"), F.col(f"wy{i}"), F.col(f"wyy{i}"), n)
        entries.append(F.struct(F.lit(condition).alias("condition"), F.struct(*cell).alias("m")))
    measured = F.filter(F.array(*entries), lambda e: e["m"]["n"] > 0)
    return (
        measurements.groupBy(*keys).agg(*aggs).select(*keys, F.map_from_entries(measured).alias("cells"))
    )


def over_cells(term) -> Column:
    """Sum of ``term(cell)`` over the profile, NULL terms skipped."""
    return F.aggregate(
        F.map_values("cells"),
        F.lit(0.0),
        lambda acc, c: acc + F.coalesce(term(c).cast("double"), F.lit(0.0)),
    )


def residual_df() -> Column:
    return over_cells(lambda c: F.greatest(c["n"] - 1, F.lit(0)))


def with_row_stats(profile: DataFrame) -> DataFrame:
    """Adds n, residual df, mean, sd (over all values) and sd_p (within conditions)."""
    c = F.col
    within = over_cells(lambda cell: cell["ss"])
    between = over_cells(lambda cell: cell["n"] * F.pow(cell["mean"] - c("mean"), F.lit(2)))
    return (
        profile.withColumns(
            {
                "n": over_cells(lambda cell: cell["n"]),
                "df": residual_df(),
                "_within": within,
                "_sum": over_cells(lambda cell: cell["n"] * cell["mean"]),
            }
        )
        .withColumn("mean", F.try_divide("_sum", "n"))
        .withColumn("_between", between)
        .withColumns(
            {
                "sd": F.sqrt(F.when(c("n") > 1, (c("_within") + c("_between")) / (c("n") - 1))),
                "sd_p": F.sqrt(F.when(c("df") > 0, c("_within") / c("df"))),
            }
        )
        .drop("_within", "_between", "_sum")
    )


def row_stats(profile: DataFrame, keys: Sequence[str] = ("identifier",)) -> DataFrame:
    """Trend columns per identifier: mean, sd, sd_p."""
    return with_row_stats(profile).select(*keys, "mean", "sd", "sd_p")


def per_contrast(profile: DataFrame, contrasts: Sequence[Contrast], keep: Sequence[str]) -> DataFrame:
    """One row per identifier and contrast with the two cells as ``a`` and ``b``.

    The pairs of cells are picked first, so a contrast carries its two cells and not the map.
    """
    cells = F.col("cells")
    pairs = [
        F.struct(F.lit(c.comparison).alias("comparison"), cells[c.cond_a].alias("a"), cells[c.cond_b].alias("b"))
        for c in contrasts
    ]
    return profile.select(*keep, F.inline(F.array(*pairs)))


def log_fold_changes(
    profile: DataFrame, contrasts: Sequence[Contrast], keys: Sequence[str] = ("identifier",)
) -> DataFrame:
    """Difference of condition means per contrast; NULL where a condition is empty."""
    return per_contrast(profile, contrasts, keys).select(
        *keys, "comparison", (F.col("a.mean") - F.col("b.mean")).alias("lfc")
    )


def wide_fold_changes(
    profile: DataFrame, contrasts: Sequence[Contrast], keep: Sequence[str]
) -> DataFrame:
    """Fold changes as one column per contrast, named ``<a>_vs_<b>``."""

    def mean_of(condition: str) -> Column:
        return F.col("cells")[condition]["mean"]

    return profile.select(
        *keep,
        *[
            (mean_of(c.cond_a) - mean_of(c.cond_b)).alias(f"{c.cond_a}_vs_{c.cond_b}")
            for c in contrasts
        ],
    )
