"""Ordered computations over groups of any size.

A window partitioned by a handful of comparisons puts each comparison on one task.
Here the distinct keys are range-partitioned over ``(groups, order)`` instead, so a
group is spread over as many buckets as its share of the rows; every bucket is a
contiguous run of the order. Running values are then "value up to the bucket" (a table
of at most buckets + groups rows) plus "value inside the bucket" (a local window).
Group keys must not be NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffspark.stage import materialise

BUCKET = "_bucket"

# A key is hot when it holds more than this share of the rows, so that there are
# never more than HOT_KEYS of them.
HOT_KEYS = 64

ROWS_A_BUCKET = 1_000_000  # rows that a task sorts at a time where their number is known

def range_buckets(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stage ``df`` with a bucket number that increases along ``(groups, order)``.

    ``(groups, order)`` should be unique, or nearly: pre-aggregate, or let the last column
    break ties, so that no heavily tied key fills a bucket. The bucket ids come from sampled range bounds and are
    therefore written down before they are used twice. No bucket count is given, so
    adaptive execution merges neighbouring ranges of small data; merging keeps the order.
    """
    ranged = df.repartitionByRange(*groups, *order)
    return materialise(ranged.withColumn(BUCKET, F.spark_partition_id()))


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def running_sums(
    bucketed: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    totals: Sequence[str] = (),
) -> DataFrame:
    """Add ``<c>_before`` (sum over strictly smaller keys) and ``<c>_total`` per group.

    Columns in ``totals`` get only their ``<c>_total``. The offset join and the local
    window both need ``(groups, bucket)``, so they share one exchange.
    """
    everything = Window.partitionBy(*groups)
    earlier = _before(everything.orderBy(BUCKET))
    offsets = bucketed.groupBy(*groups, BUCKET).agg(
        *[F.sum(c).alias(c) for c in (*sums, *totals)]
    ).select(
        *groups,
        BUCKET,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_offset") for c in sums],
        *[F.sum(c).over(everything).alias(f"{c}_total") for c in (*sums, *totals)],
    )
    local = _before(Window.partitionBy(*groups, BUCKET).orderBy(*order))
    joined = bucketed.join(offsets, [*groups, BUCKET])
    for c in sums:
        inside = F.coalesce(F.sum(c).over(local), F.lit(0))
        joined = joined.withColumn(f"{c}_before", F.col(f"{c}_offset") + inside)
    return joined.drop(*[f"{c}_offset" for c in sums])


def suffix_min(
    bucketed: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Smallest ``value`` over the keys from the current one (or the next one) onwards."""
    later = _before(Window.partitionBy(*groups).orderBy(F.desc(BUCKET)))
    tails = bucketed.groupBy(*groups, BUCKET).agg(F.min(value).alias("_low")).select(
        *groups, BUCKET, F.min("_low").over(later).alias("_tail")
    )
    down = Window.partitionBy(*groups, BUCKET).orderBy(*[F.desc(c) for c in order])
    frame = down.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        bucketed.join(tails, [*groups, BUCKET])
        .withColumn(out, F.least(F.min(value).over(frame), "_tail"))
        .drop("_tail")
    )


def row_index(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    valid: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Adds the 1-based position ``index`` in the group's order, the group's ``size`` and
    the bucket.

    Sorted ranges number their own rows (the low bits of the monotonic id); a table of at
    most buckets + groups rows turns that into positions, so no window and no second
    shuffle touch the rows. With ``valid``, rows where it is NULL are not counted; they
    must come first in the order and get positions below 1. With ``rows``, the number of rows, there
    are as many buckets as keep a bucket at ROWS_A_BUCKET.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = -(-(rows or 0) // ROWS_A_BUCKET)
    parts = [buckets] if buckets > least else []
    ranged = df.repartitionByRange(*parts, *groups, *order).sortWithinPartitions(*groups, *order)
    numbered = ranged.withColumn("_id", F.monotonically_increasing_id())
    staged = materialise(
        numbered.withColumns(
            {BUCKET: F.shiftright("_id", 33), "_pos": F.col("_id").bitwiseAND((1 << 33) - 1)}
        ).drop("_id")
    )
    everything = Window.partitionBy(*groups)
    skipped = F.lit(0) if valid is None else F.count_if(F.col(valid).isNull())
    spans = staged.groupBy(*groups, BUCKET).agg(
        F.min("_pos").alias("_lo"), F.count(F.lit(1)).alias("_n"), skipped.alias("_skip")
    )
    earlier = F.coalesce(F.sum("_n").over(_before(everything.orderBy(BUCKET))), F.lit(0))
    ignored = F.sum("_skip").over(everything)
    starts = spans.select(
        *groups,
        BUCKET,
        (earlier - F.col("_lo") + 1 - ignored).alias("_start"),
        (F.sum("_n").over(everything) - ignored).alias("size"),
    )
    return (
        staged.join(materialise(starts), [*groups, BUCKET])
        .withColumn("index", F.col("_start") + F.col("_pos"))
        .drop("_start", "_pos")
    )


def quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles per group, linearly interpolated; one output column per entry of
    ``probs``. Rows are numbered in order, in buckets that do not grow with the data; equal values
    are dealt by a tie-breaker. ``df`` should be a stage table."""
    some = df.where(F.col(value).isNotNull()).select(
        *groups, F.col(value).alias("_v"), F.monotonically_increasing_id().alias("_tie")
    )
    inside = row_index(some, groups, ["_v", "_tie"], rows=some.count())

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("size") - 1)

    aggs = []
    for name, p in probs.items():
        lo, hi = F.floor(position(p)), F.ceil(position(p))
        aggs += [
            F.max(F.when(F.col("index") - 1 == lo, F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when(F.col("index") - 1 == hi, F.col("_v"))).alias(f"_hi_{name}"),
            F.max(position(p) - lo).alias(f"_w_{name}"),
        ]
    picked = inside.groupBy(*groups).agg(*aggs) if groups else inside.agg(*aggs)
    return picked.select(
        *groups,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
    )


def quantile_list(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Exact quantiles of a column, linearly interpolated, for a list of any length; NaN if the
    column has no values. Rows are numbered in order, ties by hash, and the wanted ones, two per
    quantile, are taken. ``df`` should be a stage table."""
    some = df.where(F.col(value).isNotNull())
    keyed = some.select(F.col(value).cast("double").alias("_v"), F.xxhash64(*df.columns).alias("_tie"))
    indexed = row_index(keyed, [], ["_v", "_tie"])
    n = some.count()
    if not n:
        return [float("nan")] * len(probs)
    position = [float(p) * (n - 1) for p in probs]
    wanted = sorted({k for x in position for k in (math.floor(x), math.ceil(x))})
    rows = indexed.where(F.col("index").isin([k + 1 for k in wanted])).select("index", "_v").collect()
    at = {r["index"] - 1: r["_v"] for r in rows}
    return [at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for x in position]


def trapezoid(
    points: DataFrame, groups: Sequence[str], x: str, y: str, out: str
) -> DataFrame:
    """Area under ``y`` over ``x`` per group, points taken in ``(x, y)`` order.

    Pairs with a NULL are left out; one point gives 0 and none gives NULL. Every bucket
    yields its own area and its end points; neighbouring buckets are then stitched.
    The distinct points are staged, as they are read for the sampled bounds, for the ranges
    and for the groups.
    """
    usable = F.col(x).isNotNull() & F.col(y).isNotNull()
    points = materialise(points.select(*groups, x, y).distinct())
    piece = range_buckets(points.where(usable), groups, [x, y])
    step = Window.partitionBy(*groups, BUCKET).orderBy(x, y)
    inner = piece.select(
        *groups,
        BUCKET,
        x,
        y,
        ((F.col(x) - F.lag(x).over(step)) * (F.col(y) + F.lag(y).over(step)) / 2).alias("_area"),
    )
    ends = inner.groupBy(*groups, BUCKET).agg(
        F.coalesce(F.sum("_area"), F.lit(0.0)).alias("_area"),
        F.min(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("_first"),
        F.max(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("_last"),
    )
    prev = F.lag("_last").over(Window.partitionBy(*groups).orderBy(BUCKET))
    stitched = ends.withColumn(
        "_joint",
        F.coalesce(
            (F.col("_first.x") - prev["x"]) * (F.col("_first.y") + prev["y"]) / 2, F.lit(0.0)
        ),
    )
    area = F.sum(F.col("_area") + F.col("_joint")).alias(out)
    areas = stitched.groupBy(*groups).agg(area)
    return points.select(*groups).distinct().join(areas, list(groups), "left")


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per key, ``weight`` = rows per key).

    Keys holding more than 1/HOT_KEYS of all rows, of which there are fewer than HOT_KEYS (and
    often none), are matched by broadcast and the others by an ordinary join that is then free
    of hot keys and left to adaptive execution. Where no key is hot that is all. With hot keys
    both inputs are read twice, so pass stage tables.
    """
    names = list(keys)
    total, most = table.agg(F.sum(weight), F.max(weight)).first()
    if most is None or most * HOT_KEYS <= total:
        return rows.join(table.drop(weight), names, "left")
    hot = F.broadcast(table.where(F.col(weight) * HOT_KEYS > total).drop(weight))
    cold = rows.join(hot.select(*names), names, "left_anti").join(table.drop(weight), names, "left")
    return rows.join(hot, names).unionByName(cold)
