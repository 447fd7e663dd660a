"""Truth flags, label clean-up and category order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.operators.ordered import row_index
from diffspark.schema import Contrast
from diffspark.stage import materialise


def truth_flag(pattern: str, identifier: str = "identifier") -> Column:
    """True for identifiers that are known positives."""
    return F.col(identifier).rlike(pattern)


def truth_class(pattern: str, identifier: str = "identifier") -> Column:
    return F.when(truth_flag(pattern, identifier), "TP").otherwise("TN")


def replace_all(column: Column, replacements: dict[str, str]) -> Column:
    """Each pattern in turn, every match."""
    for pattern, new in replacements.items():
        column = F.regexp_replace(column, pattern, new)
    return column


def replace_first(column: Column, pattern: str, new: str) -> Column:
    """Only the first match of ``pattern``."""
    return F.regexp_replace(column, f"(?s)^(.*?)(?:{pattern})", f"$1{new}")


def remove(column: Column, pattern: str) -> Column:
    return F.regexp_replace(column, pattern, "")


def orient_results(
    results: DataFrame, contrasts: Sequence[Contrast], written: str = r"(?i)\s+vs\s+"
) -> DataFrame:
    """Results labelled as in the list of contrasts; the fold change follows the direction.

    ``written`` matches the separator as it occurs in the data. Labels that are no contrast
    in either direction keep their text and fold change.
    """
    label = F.regexp_replace("comparison", written, " vs ")
    turned = [(Contrast(c.cond_b, c.cond_a).comparison, c.comparison) for c in contrasts]
    names = F.create_map(*[F.lit(x) for pair in turned for x in pair])
    other = F.try_element_at(names, label)
    flip = F.when(other.isNull(), 1.0).otherwise(-1.0)
    return results.withColumns(
        {"comparison": F.coalesce(other, label), "lfc": F.col("lfc") * flip}
    )


def relabel_comparisons(
    df: DataFrame, contrasts: Sequence[Contrast], names: dict[str, str]
) -> DataFrame:
    """Comparisons under the reported names of their conditions, with ``position``, their place
    in the list of contrasts. Other comparisons stay as they are, without a position."""
    known, label = F.array(*[F.lit(c.comparison) for c in contrasts]), F.col("comparison")
    new = [Contrast(names.get(c.cond_a, c.cond_a), names.get(c.cond_b, c.cond_b)) for c in contrasts]
    place = F.nullif(F.array_position(known, label), F.lit(0))
    text = F.get(F.array(*[F.lit(c.comparison) for c in new]), (place - 1).cast("int"))
    return df.withColumns({"position": place, "comparison": F.coalesce(text, label)})


def unify_methods(column: Column, prefix: str, renames: dict[str, str]) -> Column:
    """Drops the imputation prefix and applies the renames in order."""
    return replace_all(remove(column, prefix), renames)


def with_level(df: DataFrame, column: str, levels: Sequence[str], out: str) -> DataFrame:
    """Position of a value among fixed levels; NULL for an unknown value."""
    found = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(column))
    return df.withColumn(out, F.nullif(found, F.lit(0)))


def frequency_levels(df: DataFrame, column: str, out: str = "level") -> DataFrame:
    """Values by falling count, then by name, with their position."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("_down", -F.col("n"))
    placed = row_index(counts, [], ["_down", column])
    return placed.select(column, "n", F.col("index").alias(out))


def order_by_frequency(df: DataFrame, column: str, out: str = "level") -> DataFrame:
    """Adds to each row the frequency position of its value."""
    return df.join(materialise(frequency_levels(df, column, out).drop("n")), column, "left")
