"""Moderated t-test: identifier variances shrunk towards a common or trended prior."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.functions.special import digamma, t_two_sided, trigamma, trigamma_inverse
from diffspark.operators.impute import every_imputation
from diffspark.operators.moments import PLAIN, WEIGHTED, over_cells, per_contrast, residual_df
from diffspark.operators.ordered import quantiles
from diffspark.schema import Contrast
from diffspark.stage import materialise

# Lower and upper tail shares winsorised by the robust variant.
WINSOR_TAILS = (0.05, 0.1)


def residual_variance(profile: DataFrame, weighted: bool = False) -> DataFrame:
    """Adds level (mean), residual df and pooled residual variance s2 of each profile row."""
    n, mean, ss = WEIGHTED if weighted else PLAIN
    return (
        profile.withColumns(
            {
                "df": residual_df(),
                "_ss": over_cells(lambda c: c[ss]),
                "_n": over_cells(lambda c: c["n"]),
                "_sum": over_cells(lambda c: c["n"] * c["mean"]),
            }
        )
        .withColumns(
            {
                "level": F.try_divide("_sum", "_n"),
                "s2": F.when(F.col("df") > 0, F.try_divide("_ss", "df")),
            }
        )
        .drop("_ss", "_n", "_sum")
    )


def log_variance_residual() -> Column:
    """ln s2 on a scale where its expectation is ln of the prior variance."""
    half = F.col("df") / 2
    return F.when(F.col("s2") > 0, F.ln("s2") - digamma(half) + F.ln(half))


def _winsorise(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    low, high = WINSOR_TAILS
    limits = materialise(quantiles(rows, groups, "e", {"_low": low, "_high": 1 - high}))
    return rows.join(limits, list(groups)).withColumn(
        "e", F.least(F.greatest("e", "_low"), "_high")
    ).drop("_low", "_high")


def variance_prior(
    rows: DataFrame,
    groups: Sequence[str],
    trend: bool = False,
    robust: bool = False,
    m: int | None = None,
) -> DataFrame:
    """Prior degrees of freedom d0 and ln prior variance, one row per group.

    With ``m``, a row whose imputation is NULL belongs to all ``m`` imputations. Its sums are
    made once and repeated as sums; the robust variant, which needs order statistics of each
    imputation, repeats its three numbers.

    The log prior variance is b0 + b1 u + b2 u^2 with u = level - centre (b1 = b2 = 0
    without a trend). ``rows`` comes from :func:`residual_variance` over a stage table: it
    is read once without a trend and twice with one, each time by a map-side combined
    aggregation; the rest is arithmetic on one row per group.
    """
    groups = list(groups)
    c = F.col
    usable = rows.withColumn("e", log_variance_residual()).where(c("e").isNotNull())
    data = usable.select(*groups, "e", "level", trigamma(c("df") / 2).alias("tri"))
    if robust:
        if m is not None:
            data = every_imputation(data, m)
        data = _winsorise(materialise(data), groups)
    centre = data.agg(F.avg("level")).first()[0] if trend else 0.0
    u = c("level") - F.lit(centre)
    sums = data.groupBy(*groups).agg(
        F.count("e").alias("n"),
        F.sum("e").alias("e0"),
        F.sum(c("e") * c("e")).alias("ee"),
        F.sum("tri").alias("tri"),
        *[F.sum(F.pow(u, F.lit(k))).alias(f"u{k}") for k in (1, 2, 3, 4) if trend],
        *[F.sum(c("e") * F.pow(u, F.lit(k))).alias(f"e{k}") for k in (1, 2) if trend],
    )
    if m is not None and not robust:
        added = [n for n in sums.columns if n not in groups]
        sums = every_imputation(sums, m).groupBy(*groups).agg(*[F.sum(n).alias(n) for n in added])
    sums = sums.withColumn("tri", c("tri") / c("n"))
    if trend:
        fit = _quadratic(sums)
    else:
        spread = F.try_divide(c("ee") - c("e0") * c("e0") / c("n"), c("n") - 1)
        fit = sums.withColumns(
            {"b0": c("e0") / c("n"), "excess": spread - c("tri"), "b1": F.lit(0.0), "b2": F.lit(0.0)}
        )
    fit = fit.withColumn("centre", F.lit(centre))
    d0 = F.when(c("excess") > 0, 2 * trigamma_inverse("excess"))
    return fit.withColumn("d0", F.coalesce(d0, F.lit(float("inf")))).select(
        *groups, "d0", "b0", "b1", "b2", "centre"
    )


def _quadratic(sums: DataFrame) -> DataFrame:
    """Least-squares parabola from power sums (Cramer's rule on the normal equations)."""
    c = F.col

    def det(rows) -> Column:
        (a, b, d), (e, f, g), (h, i, j) = rows
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    left = [
        [c("n"), c("u1"), c("u2")],
        [c("u1"), c("u2"), c("u3")],
        [c("u2"), c("u3"), c("u4")],
    ]
    right = [c("e0"), c("e1"), c("e2")]

    def solve(k: int) -> Column:
        swapped = [[right[r] if col == k else left[r][col] for col in range(3)] for r in range(3)]
        return F.try_divide(det(swapped), det(left))

    solved = sums.withColumns({f"b{k}": solve(k) for k in range(3)})
    rss = c("ee") - c("b0") * c("e0") - c("b1") * c("e1") - c("b2") * c("e2")
    return solved.withColumn("excess", F.try_divide(rss, c("n") - 3) - c("tri"))


def shrink(rows: DataFrame, prior: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds the shrunk variance ``s2_post`` and its degrees of freedom ``df_total``.

    ``prior`` has one row per group and is staged, so it is broadcast by its real size.
    """
    c = F.col
    joined = rows.join(materialise(prior), list(groups))
    infinite = c("d0") == float("inf")
    half = F.when(~infinite, c("d0") / 2)
    u = c("level") - c("centre")
    log_prior = c("b0") + c("b1") * u + c("b2") * u * u
    s02 = F.exp(log_prior + F.coalesce(digamma(half) - F.ln(half), F.lit(0.0)))
    blend = (c("d0") * c("s02") + c("df") * F.coalesce(c("s2"), F.lit(0.0))) / (c("d0") + c("df"))
    return joined.withColumn("s02", s02).withColumns(
        {
            "s2_post": F.when(infinite, c("s02")).otherwise(blend),
            "df_total": c("d0") + c("df"),
        }
    )


def moderated_t(
    profile: DataFrame,
    contrasts: Sequence[Contrast],
    groups: Sequence[str] = ("imputation",),
    trend: bool = False,
    weighted: bool = False,
    robust: bool = False,
    m: int | None = None,
) -> DataFrame:
    """Moderated t, df, p-value and fold change for every profile row and contrast.

    One prior per group (an imputation). ``weighted`` uses the weighted cell moments.
    A stage table of :func:`residual_variance` is the best input: the prior then reads its
    three numbers per row and not the cells. With ``m``, rows whose imputation is NULL stand
    for all ``m`` imputations and are repeated in the last projection only.
    """
    n, mean, _ = WEIGHTED if weighted else PLAIN
    groups = list(groups)
    rows = profile if "s2" in profile.columns else residual_variance(profile, weighted)
    prior = variance_prior(rows, groups, trend, robust, m)
    shrunk = shrink(rows if m is None else every_imputation(rows, m), prior, groups)
    a, b, c = F.col("a"), F.col("b"), F.col
    keep = [*groups, "identifier", "s2_post", "df_total", "df"]
    se2 = c("s2_post") * (F.try_divide(F.lit(1.0), a[n]) + F.try_divide(F.lit(1.0), b[n]))
    tests = per_contrast(shrunk, contrasts, keep).select(
        *groups,
        "identifier",
        "comparison",
        F.when((c("df") > 0) & (se2 > 0), (a[mean] - b[mean]) / F.sqrt(se2)).alias("t"),
        "df_total",
        (a[mean] - b[mean]).alias("lfc"),
    )
    return tests.select(
        *groups,
        "identifier",
        "comparison",
        "t",
        "df_total",
        t_two_sided("t", "df_total").alias("p_val"),
        "lfc",
    )
