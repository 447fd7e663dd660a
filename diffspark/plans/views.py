"""Measurement and result views over the given tables, in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diffspark.functions.labels import truth_flag
from diffspark.schema import pairwise_contrasts

CONDITIONS = ["A", "N", "R"]
CONTRASTS = pairwise_contrasts(CONDITIONS)
COMPARISONS = [c.comparison for c in CONTRASTS]

# Identifiers carry their brand; these brands are the planted positives.
TRUTH = ":Brand#[123]$"
ORDER_TRUTH = ":F$"

METHODS = ["shrunk", "ttest", "posterior"]

LINES_A_TASK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(
    spark: SparkSession, sf_dir: str, missing: str | None = None, log: bool = True
) -> DataFrame:
    """Line prices as measurements of parts under the return flags; positives doubled in A.

    ``missing`` removes values by discount: "light" about 5 %, "heavy" about half.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        "l_returnflag",
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn(
        "identifier", F.concat_ws(":", F.col("l_partkey").cast("string"), "p_brand")
    )
    lifted = truth_flag(TRUTH) & (F.col("l_returnflag") == "A")
    y = F.when(lifted, 2 * F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    if log:
        y = F.log2(y)
    if missing == "light":
        y = F.when(F.col("l_discount") != 0, y)
    elif missing == "heavy":
        y = F.when(F.col("l_discount") > 0.05, y)
    # a task sorts the lines of a number of parts that does not grow with the data
    tasks = lines.count() // LINES_A_TASK
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        joined = joined.repartition(tasks, "l_partkey", "l_returnflag")
    # unique within (identifier, condition), of which each has a bounded number of lines
    replicate = F.row_number().over(
        Window.partitionBy("l_partkey", "l_returnflag").orderBy(
            "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"
        )
    )
    return joined.select(
        "identifier",
        F.col("l_returnflag").alias("condition"),
        replicate.cast("long").alias("replicate"),
        y.alias("y"),
    )


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One linear value per identifier and condition; the condition is the sample."""
    return (
        measurements(spark, sf_dir, log=False)
        .groupBy("identifier", F.col("condition").alias("sample"))
        .agg(F.avg("y").alias("y"))
    )


def matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Linear wide matrix of three conditions with three samples each, and its sample names.

    A sample averages a part's lines with the same flag and replicate number modulo 3; a part
    without such a line has a missing value there.
    """
    long = measurements(spark, sf_dir, log=False)
    sample = F.concat_ws("_", "condition", ((F.col("replicate") - 1) % 3 + 1).cast("string"))
    names = [f"{c}_{r}" for c in CONDITIONS for r in (1, 2, 3)]
    wide = long.groupBy("identifier").agg(
        *[F.avg(F.when(sample == n, F.col("y"))).alias(n) for n in names]
    )
    return wide, names


def suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Linear wide matrix of suppliers, three conditions with 23 samples each: mean prices of
    the lines with a flag, dealt to the samples by order number."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_orderkey", F.col("l_extendedprice").alias("y")
    )
    sample = F.concat_ws("_", "l_returnflag", (F.col("l_orderkey") % 23 + 1).cast("string"))
    names = [f"{c}_{r}" for c in CONDITIONS for r in range(1, 24)]
    wide = lines.groupBy(F.col("l_suppkey").cast("string").alias("identifier")).agg(
        *[F.avg(F.when(sample == n, F.col("y"))).alias(n) for n in names]
    )
    return wide, names


def nine_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of line prices as measurements of suppliers under nine conditions."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("identifier"),
        F.concat(F.lit("condi"), (F.col("l_orderkey") % 9 + 1).cast("string")).alias("condition"),
        F.log2("l_extendedprice").alias("y"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, heavily tied scores of three methods for every order."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    step = F.posexplode(F.array(*[F.lit(m) for m in METHODS])).alias("k", "method")
    price = F.col("o_totalprice")
    return (
        orders.select("*", step)
        .select(
            "method",
            F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus").alias(
                "identifier"
            ),
            F.col("o_orderpriority").alias("comparison"),
            (F.floor(price / (5000 + 1000 * F.col("k"))) / 100).alias("score"),
            (500 - price / 1000 + (F.col("o_custkey") % 100) * F.col("k")).alias("lfc"),
        )
        .withColumn("truth", truth_flag(ORDER_TRUTH))
    )


def degenerate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of which one method is on one plateau in a comparison, another all zero in one."""
    plateau = (F.col("method") == "shrunk") & (F.col("comparison") == "1-URGENT")
    zero = (F.col("method") == "ttest") & (F.col("comparison") == "2-HIGH")
    score = F.when(plateau, 1.0).when(zero, 0.0).otherwise(F.col("score"))
    return scores(spark, sf_dir).withColumn("score", score)
