"""Random draws that depend on row keys only, never on partitioning or retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(2**48)


def keyed_uniform(seed: int, keys: list[Column], stream: str) -> Column:
    """Uniform on (0, 1): the first 12 hex digits of md5 over ``seed|keys|stream``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys], F.lit(stream))
    whole = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return (whole + 0.5) / SCALE


def keyed_normal(seed: int, keys: list[Column]) -> Column:
    """Standard normal from two keyed uniforms (polar form of two independent draws)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(keyed_uniform(seed, keys, "a")))
    return radius * F.cos(F.lit(2 * math.pi) * keyed_uniform(seed, keys, "b"))
