"""Table shapes shared by all operators, and the design and contrast builders."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

class Contrast(NamedTuple):
    """One comparison: mean of ``cond_a`` minus mean of ``cond_b``."""

    cond_a: str
    cond_b: str

    @property
    def comparison(self) -> str:
        return f"{self.cond_a} vs {self.cond_b}"


def pairwise_contrasts(conditions: Sequence[str]) -> list[Contrast]:
    """All pairs of conditions, in the order the conditions are given."""
    return [Contrast(a, b) for a, b in combinations(conditions, 2)]


def parse_contrast(text: str, sep: str = "-") -> Contrast:
    """``"a-b"`` as a contrast."""
    a, b = text.split(sep)
    return Contrast(a, b)


def conditions_of(contrasts: Sequence[Contrast]) -> list[str]:
    """Conditions that the contrasts mention, in order of appearance."""
    return list(dict.fromkeys(name for c in contrasts for name in c))


def design_table(df: DataFrame, sample: str = "replicate") -> DataFrame:
    """Conditions found in the data with their number of distinct samples."""
    return df.groupBy("condition").agg(F.count_distinct(sample).alias("replicates"))


def contrast_table(design: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Every pair of conditions of a design, in the order of ``levels``.

    ``levels`` names the conditions in the order of the experiment, as names with numbers do
    not sort by themselves. Pairs are made from that list and kept where the design has
    both conditions.
    """
    pairs = design.sparkSession.createDataFrame(
        [(c.comparison, *c) for c in pairwise_contrasts(levels)],
        "comparison string, cond_a string, cond_b string",
    )
    for side in ("cond_a", "cond_b"):
        found = design.select(F.col("condition").alias(side)).distinct()
        pairs = pairs.join(found, side, "left_semi")
    return pairs.select("comparison", "cond_a", "cond_b")


def design_matrix(df: DataFrame, conditions: Sequence[str], sample: str = "replicate") -> DataFrame:
    """One row per (condition, sample) found in the data, one 0/1 column per condition."""
    samples = df.select("condition", sample).distinct()
    return samples.select(
        "condition",
        sample,
        *[(F.col("condition") == c).cast("int").alias(f"is_{c}") for c in conditions],
    )


def contrast_matrix(design: DataFrame, contrasts: Sequence[Contrast]) -> DataFrame:
    """One row per condition of the design, one column per comparison with +1, -1 or 0."""
    name = F.col("condition")
    return design.select(
        "condition",
        *[
            F.when(name == c.cond_a, 1).when(name == c.cond_b, -1).otherwise(0).alias(c.comparison)
            for c in contrasts
        ],
    )
