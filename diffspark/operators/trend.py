"""Mean-variance trends: spread of an identifier as a function of its level."""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.functions import lines
from diffspark.operators.ordered import quantile_list
from diffspark.stage import materialise

UPPER, LOWER = "U", "L"


class Trend(NamedTuple):
    """ln(spread) = intercept + slope * mean, with shifts for rows labelled UPPER."""

    intercept: float
    slope: float
    upper_intercept: float = 0.0
    upper_slope: float = 0.0
    dispersion: float | None = None

    def log_predict(self, mean: Column, label: Column | None = None) -> Column:
        line = F.lit(self.intercept) + F.lit(self.slope) * mean
        if label is None:
            return line
        shift = F.lit(self.upper_intercept) + F.lit(self.upper_slope) * mean
        return line + F.when(label == UPPER, shift).otherwise(0.0)

    def predict(self, mean: Column, label: Column | None = None) -> Column:
        return F.exp(self.log_predict(mean, label))

    def precision_weight(self, value: Column, label: Column | None = None) -> Column:
        return F.exp(F.lit(-2.0) * self.log_predict(value, label))


def _usable(rows: DataFrame, spread: str) -> DataFrame:
    return rows.where((F.col(spread) > 0) & F.col("mean").isNotNull())


def fit_log_trend(rows: DataFrame, spread: str = "sd") -> Trend:
    """Least squares of ln(spread) on mean; one aggregation, two numbers."""
    y = F.ln(spread)
    fit = _usable(rows, spread).agg(
        F.regr_intercept(y, F.col("mean")).alias("b0"), F.regr_slope(y, F.col("mean")).alias("b1")
    ).first()
    return Trend(fit["b0"], fit["b1"])


#: Features beside the constant of each set of terms.
TERMS = {"mean": ("mean",), "mean+c": ("mean", "up"), "mean*c": ("mean", "up", "both")}
TOLERANCE, STEPS = 1e-10, 50


class Regression(NamedTuple):
    """What a gamma regression is of: spread column, terms (``mean``, ``mean+c`` or ``mean*c``)
    and the column of labels that the terms with c use."""

    spread: str = "sd"
    terms: str = "mean"
    label: str = "c"

    def features(self) -> list[Column]:
        up = (F.col(self.label) == UPPER).cast("double")
        mean = F.col("mean").cast("double")
        named = {"mean": mean, "up": up, "both": up * mean}
        return [F.lit(1.0), *(named[t] for t in TERMS[self.terms])]

    def usable(self) -> Column:
        ok = (F.col(self.spread) > 0) & F.col("mean").isNotNull()
        return ok if self.terms == "mean" else ok & F.col(self.label).isNotNull()


def _one_row(rows: DataFrame, sums: list[Column]) -> np.ndarray:
    """Many sums over ``rows`` by one aggregation; no rows give zeros."""
    found = rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
    return np.array([0.0 if v is None else float(v) for v in found])


def fit_gamma_trends(rows: DataFrame, models: dict[str, Regression]) -> dict[str, Trend]:
    """Gamma regressions with log link of several models at once.

    Newton's steps from the least squares of ln y: a step needs X'(y / mu - 1) and
    X' diag(y / mu) X, and with this link the likelihood has one maximum. Every step is one
    aggregation for all models, a few sums for each. ``rows`` is read once per step: pass a stage
    table.
    """
    x = {k: m.features() for k, m in models.items()}
    y = {k: F.col(m.spread).cast("double") for k, m in models.items()}

    def totals(terms: dict[str, list[Column]]) -> dict[str, np.ndarray]:
        """Sums of the terms of each model over its usable rows."""
        flat = [F.sum(F.when(models[k].usable(), t)) for k, ts in terms.items() for t in ts]
        out, at = _one_row(rows, flat), 0
        parts = {}
        for k, ts in terms.items():
            parts[k] = out[at : at + len(ts)]
            at += len(ts)
        return parts

    half = {k: [(i, j) for i in range(len(x[k])) for j in range(i + 1)] for k in models}

    def square(k: str, sums: np.ndarray) -> np.ndarray:
        """A symmetric matrix from the sums of its lower half."""
        out = np.zeros((len(x[k]), len(x[k])))
        for (i, j), v in zip(half[k], sums, strict=True):
            out[i, j] = out[j, i] = v
        return out

    def products(k: str, weight: Column | float = 1.0) -> list[Column]:
        return [weight * x[k][i] * x[k][j] for i, j in half[k]]

    beta, n, spread = {}, {}, {}
    for k, sums in totals({k: [a * F.ln(y[k]) for a in x[k]] + products(k) for k in models}).items():
        size = len(x[k])
        n[k] = sums[size]
        if not n[k]:
            raise ValueError(f"no usable rows for {models[k]}")
        beta[k] = np.linalg.pinv(square(k, sums[size:]), hermitian=True) @ sums[:size]
    open_ = set(models)
    for _ in range(STEPS):
        excess = {
            k: y[k] * F.exp(-sum(F.lit(float(b)) * c for b, c in zip(beta[k], x[k], strict=True))) - 1.0
            for k in open_
        }
        terms = {k: [e * e] + [e * c for c in x[k]] + products(k, e + 1.0) for k, e in excess.items()}
        for k, sums in totals(terms).items():
            size = len(x[k])
            spread[k] = sums[0]
            step = np.linalg.pinv(square(k, sums[1 + size :]), hermitian=True) @ sums[1 : 1 + size]
            beta[k] = beta[k] + step
            if np.abs(step).max() <= TOLERANCE * (1 + np.abs(beta[k]).max()):
                open_ = open_ - {k}
        if not open_:
            break

    def trend(k: str) -> Trend:
        padded = [*(float(b) for b in beta[k]), 0.0, 0.0]
        free = n[k] - len(x[k])
        return Trend(*padded[:4], float(spread[k] / free) if free > 0 else None)

    return {k: trend(k) for k in models}


def fit_gamma_trend(
    rows: DataFrame, spread: str = "sd", terms: str = "mean", label: str = "c"
) -> Trend:
    """One gamma regression, see :func:`fit_gamma_trends`."""
    return fit_gamma_trends(rows, {"": Regression(spread, terms, label)})[""]


# --- partition of identifiers into two trends -------------------------------------


def _grid(span: tuple[float, float], n: int) -> list[float]:
    lo, hi = span
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)] if n > 1 else [lo]


class Partition(NamedTuple):
    """Scored configurations (best first by ``rank``) and the labelled rows of the best."""

    grid: DataFrame
    labelled: DataFrame


def partition_trends(
    rows: DataFrame,
    n_h1: int,
    n_h2: int,
    h1_prop: tuple[float, float] = (1e-3, 0.05),
    h2_prop: tuple[float, float] = (1e-3, 0.05),
    spread: str = "sd",
    rounds: int = 5,
    label: str = "c",
) -> Partition:
    """Split identifiers into an upper and a lower trend, over a grid of start margins.

    A configuration (h1, h2) starts from the rows below the h1 quantile and above the
    1 - h2 quantile of the one-trend residuals; then lines are fitted and all rows moved
    to the closer line, ``rounds`` times. The best configuration has the largest gamma
    log-likelihood kernel -sum(ln mu + s/mu); one that has no line for a label has no score and ranks
    last, and if none has two lines all rows are LOWER. Every identifier is used in every
    configuration. A round is one pass in which tasks hold blocks of rows against all
    configurations; what is shuffled, and collected in the end, is one row of sums per
    configuration and task.
    """
    usable = _usable(rows, spread).withColumn("_y", F.ln(spread))
    x, y = F.col("mean"), F.col("_y")
    one = usable.agg(F.regr_intercept(y, x), F.regr_slope(y, x), F.avg(x), F.avg(y)).first()
    trend = Trend(*one[:2])
    centre = (one[2] or 0.0, one[3] or 0.0)
    base = materialise(usable.withColumn("_r", y - trend.log_predict(x)))
    points = base.select(*[F.col(c).cast("double") for c in ("mean", "_y", "_r")]).na.drop()
    h1s, h2s = _grid(h1_prop, n_h1), _grid(h2_prop, n_h2)
    cuts = quantile_list(base, "_r", [*h1s, *(1 - h for h in h2s)])
    low, high = np.array(cuts[:n_h1]), np.array(cuts[n_h1:])
    configs = n_h1 * n_h2
    members: lines.Start | lines.Lines = lines.Start(np.repeat(low, n_h2), np.tile(high, n_h1))
    for _ in range(rounds):
        run = partial(lines.line_sums, members=members, configs=configs, centre=centre)
        members = lines.fitted(_merged(points, run, LINE_SUMS, configs), centre)
    run = partial(lines.scores, lines=members, configs=configs)
    score = _merged(points, run, {"score": "sum"}, configs)["score"]
    found = np.isfinite(np.vstack(members)).all(axis=0)
    h = [(h1, h2) for h1 in h1s for h2 in h2s]
    order = sorted(range(configs), key=lambda k: (not found[k], -score[k] if found[k] else 0.0, *h[k]))
    grid = rows.sparkSession.createDataFrame(
        [(*h[k], float(score[k]) if found[k] else None, rank + 1) for rank, k in enumerate(order)],
        "h1 double, h2 double, score double, rank int",
    )
    best = order[0]
    if not found[best]:  # no configuration has two lines
        return Partition(grid, base.select(*rows.columns).withColumn(label, F.lit(LOWER)))
    b0_l, b1_l, b0_u, b1_u = (F.lit(float(m[best])) for m in members)
    upper = F.abs(y - b0_u - b1_u * x) < F.abs(y - b0_l - b1_l * x)
    labelled = base.withColumn(label, F.when(upper, UPPER).otherwise(LOWER))
    return Partition(grid, labelled.select(*rows.columns, label))


#: How the sums of tasks are merged.
LINE_SUMS = {
    f"{name}_{side}": how
    for side in lines.SIDES
    for name, how in {**dict.fromkeys(lines.POWERS, "sum"), "least": "min", "most": "max"}.items()
}


def _merged(points: DataFrame, run, how: dict[str, str], configs: int) -> dict[str, np.ndarray]:
    """Sums of all tasks: ``configs`` rows, an argument of the call."""
    schema = "config int, " + ", ".join(f"{c} double" for c in how)
    parts = points.mapInArrow(run, schema)
    out = {c: np.full(configs, {"sum": 0.0, "min": np.inf, "max": -np.inf}[h]) for c, h in how.items()}
    for row in parts.groupBy("config").agg(*[getattr(F, h)(c).alias(c) for c, h in how.items()]).collect():
        for c in how:
            out[c][row["config"]] = row[c]
    return out
