"""Single and multiple imputation of missing measurements by keyed normal draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.functions.keyed import keyed_normal
from diffspark.operators.moments import PLAIN, WEIGHTED, cell_moments, fields_of
from diffspark.operators.ordered import lookup, quantiles
from diffspark.operators.trend import Trend

LOW_TAIL = 0.01

ROWS_A_TASK = 200_000  # draws that a task groups at a time, about


def low_tail(cells: DataFrame, prob: float = LOW_TAIL) -> float:
    """Low quantile of the condition means: the centre used for conditions without values."""
    return quantiles(cells, [], "mean", {"low": prob}).first()["low"]


def _draw(centre: Column, trend: Trend, seed: int, imputation: Column) -> Column:
    keys = [F.col("identifier"), F.col("condition"), F.col("replicate"), imputation]
    return centre + trend.predict(centre) * keyed_normal(seed, keys)


def missing_with_centre(measurements: DataFrame, cells: DataFrame, low: float) -> DataFrame:
    """Missing rows only, next to their condition mean; observed rows never move.

    A condition that holds a large share of the gaps is matched by broadcast, so that its
    rows stay spread out before they multiply.
    """
    missing = measurements.where(F.col("y").isNull())
    centres = cells.where(F.col("gaps") > 0).select(
        "identifier", "condition", F.coalesce("mean", F.lit(low)).alias("_centre"), "gaps"
    )
    return lookup(missing, centres, ["identifier", "condition"], "gaps")


def single_imputation(
    measurements: DataFrame, cells: DataFrame, trend: Trend, low: float, seed: int = 1
) -> DataFrame:
    """Measurements with every NULL replaced by one draw around its condition mean.

    ``cells`` are the condition moments of ``measurements``, ``trend`` the spread at a
    given level, ``low`` the centre for conditions without any value.
    """
    observed = measurements.where(F.col("y").isNotNull())
    filled = missing_with_centre(measurements, cells, low).withColumn(
        "y", _draw(F.col("_centre"), trend, seed, F.lit(0))
    )
    return observed.unionByName(filled.select(*measurements.columns))


def tasks_for(spark: SparkSession, draws: int) -> int:
    """Tasks for a number of draws: the number of shuffle partitions, more if tasks were too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-draws // ROWS_A_TASK))


def imputation_draws(
    measurements: DataFrame, cells: DataFrame, trend: Trend, low: float, m: int, seed: int = 1
) -> DataFrame:
    """Missing rows times ``m`` draws: (imputation, identifier, condition, replicate, y). The missing
    rows are dealt to tasks by the number of their draws."""
    gaps = cells.agg(F.sum("gaps")).first()[0] or 0
    parts = tasks_for(measurements.sparkSession, gaps * m)
    missing = missing_with_centre(measurements, cells, low)
    spread = missing.repartition(parts, "identifier", "condition", "replicate").withColumn(
        "imputation", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    )
    return spread.select(
        "imputation",
        "identifier",
        "condition",
        "replicate",
        _draw(F.col("_centre"), trend, seed, F.col("imputation")).alias("y"),
    )


def _merge(a: Column, b: Column, names: tuple[str, str, str]) -> list[Column]:
    """Moments of two disjoint sets of values from the moments of each."""
    n, mean, ss = names
    na, nb = F.coalesce(a[n], F.lit(0)), F.coalesce(b[n], F.lit(0))
    total = na + nb
    ma, mb = F.coalesce(a[mean], b[mean]), F.coalesce(b[mean], a[mean])
    share = F.coalesce(F.try_divide(nb, total), F.lit(0.0))
    spread = na * share * (mb - ma) * (mb - ma)
    return [
        total.alias(n),
        (ma + share * (mb - ma)).alias(mean),
        (F.coalesce(a[ss], F.lit(0.0)) + F.coalesce(b[ss], F.lit(0.0)) + spread).alias(ss),
    ]


def imputed_profiles(
    observed: DataFrame,
    draws: DataFrame,
    m: int,
    weight: Column | None = None,
    expand: bool = True,
    n_draws: int | None = None,
) -> DataFrame:
    """Profile of every identifier in every imputation.

    ``observed`` is the profile of the measured values. Only the draws (``n_draws``, counted if not
    given) are shuffled per imputation and reduced to one row per (imputation, empty cell). They meet the observed
    profile once per identifier, as a list of (imputation, filled cells) that is unfolded
    behind that join entry by entry, so the work is linear in ``m``. An identifier without
    draws has one profile for all imputations: with ``expand`` it is repeated, otherwise it is one row
    whose imputation is NULL.
    Rows multiply there, so both sides keep the full number of shuffle partitions instead
    of being merged by their size, and more partitions for more draws, so that a task does not grow
    with the data; grouping and join reuse that one partitioning.
    """
    parts = tasks_for(observed.sparkSession, draws.count() if n_draws is None else n_draws)
    dealt = draws.repartition(parts, "imputation", "identifier", "condition")
    drawn = cell_moments(dealt, ("imputation", "identifier"), "y", weight)
    fields = fields_of(drawn.columns)
    pieces = (
        drawn.repartition(parts, "identifier")
        .groupBy("identifier", "imputation")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("condition", F.struct(*fields).alias("m")))
            ).alias("filled")
        )
        .groupBy("identifier")
        .agg(F.collect_list(F.struct("imputation", "filled")).alias("pieces"))
    )
    joined = observed.select("identifier", "cells").join(pieces, "identifier", "full")
    every = F.sequence(F.lit(0), F.lit(m - 1)) if expand else F.array(F.lit(None).cast("int"))
    kind = pieces.schema["pieces"].dataType.elementType["filled"].dataType
    same = F.transform(
        every, lambda i: F.struct(i.alias("imputation"), F.lit(None).cast(kind).alias("filled"))
    )
    entry = F.explode(F.coalesce("pieces", same)).alias("piece")
    unfolded = joined.select("identifier", "cells", entry).select(
        "identifier", "cells", "piece.imputation", "piece.filled"
    )
    filled = F.col("filled")

    def combine(_, seen, new):
        parts = _merge(seen, new, PLAIN)
        if fields != PLAIN:
            parts += _merge(seen, new, WEIGHTED)
        return F.when(new.isNull(), seen).otherwise(F.struct(*parts))

    merged = F.when(filled.isNull(), F.col("cells")).when(F.col("cells").isNull(), filled)
    return unfolded.select(
        "imputation",
        "identifier",
        merged.otherwise(F.map_zip_with("cells", filled, combine)).alias("cells"),
    )


def every_imputation(rows: DataFrame, m: int) -> DataFrame:
    """Rows whose imputation is NULL, once for each of the ``m`` imputations."""
    every = F.sequence(F.lit(0), F.lit(m - 1))
    own = F.when(F.col("imputation").isNull(), every).otherwise(F.array("imputation"))
    return rows.withColumn("imputation", F.explode(own))
