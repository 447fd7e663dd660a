"""Filters and reshapes of measurement and result tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffspark.schema import Contrast
from diffspark.stage import materialise


def drop_all_missing(
    measurements: DataFrame, keys: Sequence[str] = ("identifier",), value: str = "y"
) -> DataFrame:
    """Removes keys without any value. Only the keys to remove are joined."""
    empty = measurements.groupBy(*keys).agg(F.count(value).alias("_n")).where("_n = 0")
    return measurements.join(materialise(empty.select(*keys)), list(keys), "left_anti")


def complete_cases(
    measurements: DataFrame, keys: Sequence[str] = ("identifier",), value: str = "y"
) -> DataFrame:
    """Keeps keys none of whose values is missing."""
    gaps = measurements.where(F.col(value).isNull()).select(*keys).distinct()
    return measurements.join(materialise(gaps), list(keys), "left_anti")


def members(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids``."""
    return rows.join(ids.select(key), key, "left_semi")


def zero_as_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Zero becomes NULL in the given columns, by default in all floating-point ones."""
    names = columns or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.nullif(F.col(n), F.lit(0.0)) for n in names})


def unlog(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """2^x in the given columns."""
    return df.withColumns({n: F.pow(F.lit(2.0), F.col(n)) for n in columns})


def columns_like(df: DataFrame, pattern: str, exclude: bool = False) -> list[str]:
    """Column names that match (or do not match) a regular expression."""
    return [c for c in df.columns if bool(re.search(pattern, c)) != exclude]


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Column names from ``first`` to ``last`` in table order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """Wide to long; missing values stay as rows."""
    return df.unpivot(list(ids), list(columns), name, value)



def nest(df: DataFrame, keys: Sequence[str], out: str = "data") -> DataFrame:
    """Rows of a key as a list column. For keys whose groups are bounded, such as the
    contrasts of an identifier; large groups stay flat rows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias(out))


def unnest(df: DataFrame, column: str = "data") -> DataFrame:
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.inline(column))


def first_comparison(results: DataFrame, contrasts: Sequence[Contrast]) -> DataFrame:
    """Rows of the first contrast of the study."""
    return results.where(F.col("comparison") == contrasts[0].comparison)


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a table lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of row by column value; absent combinations are 0."""
    counts = df.groupBy(row).pivot(column, list(values)).count()
    return counts.na.fill(0)


def with_group_value(df: DataFrame, keys: Sequence[str], aggregates: dict) -> DataFrame:
    """Group aggregates repeated on each row of the group."""
    table = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return df.join(materialise(table), list(keys))
