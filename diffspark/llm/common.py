"""Inputs of the corpus operators and small shared helpers."""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from diffspark.stage import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark only (the folder may be in a store that nothing else
    can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Send the functions of a module to executors by value, so that they need not have
    the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Plan nodes that leave rows in the order and partitions of a file scan.
ROW_LOCAL = re.compile(r"^[\s:+-]*(Project|Filter|Relation)\b")


def settled(docs: DataFrame) -> DataFrame:
    """``docs`` such that row numbers are the same whenever they are computed: a plain scan of
    files is (files are split alike each time), anything else is written as a stage table."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    if all(ROW_LOCAL.match(line) for line in plan.splitlines() if line.strip()):
        return docs
    return materialise(docs)
