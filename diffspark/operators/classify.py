"""Forest filter: identifiers whose measurements contradict their label are set aside."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.functions import trees as trees_of
from diffspark.functions.labels import order_by_frequency, truth_class
from diffspark.operators.moments import wide_fold_changes, with_row_stats
from diffspark.operators.ordered import quantile_list
from diffspark.schema import Contrast
from diffspark.stage import materialise

DISCARDED = "Discarded"

ROWS_AT_ONCE = 250_000  # drawn rows of a node below which one task grows its subtree
ROWS_A_SHARE = 2_000_000  # rows that a group of trees judges in a task, about
TREES_A_GROUP = 4


def filter_features(
    profile: DataFrame, contrasts: Sequence[Contrast], truth_pattern: str
) -> DataFrame:
    """identifier, n, mean, sd, one fold change per contrast, class (TP or TN); identifiers without
    any value have no features and are dropped."""
    stats = with_row_stats(profile).where("n > 0")
    return wide_fold_changes(stats, contrasts, ["identifier", "n", "mean", "sd"]).withColumn(
        "class", truth_class(truth_pattern)
    )


def feature_names(contrasts: Sequence[Contrast]) -> list[str]:
    return ["mean", "sd", *[f"{c.cond_a}_vs_{c.cond_b}" for c in contrasts]]


class Forest(NamedTuple):
    """A fitted filter: cuts of each feature, weights of negatives and positives, and the nodes as
    packed rows (see :mod:`diffspark.functions.trees`) of a stage table."""

    features: list[str]
    cuts: list[list[float]]
    weights: tuple[float, float]
    trees: int
    nodes: DataFrame


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _blocks(rows: DataFrame, features: Sequence[str], cuts: list[list[float]]) -> DataFrame:
    """Rows as staged blocks of bins, dealt to all tasks as a block costs far more than its bytes."""
    keyed = rows.select(F.xxhash64("identifier").alias("key"), "identifier", "class", *features)
    packed = keyed.mapInArrow(partial(trees_of.to_blocks, features=list(features), cuts=cuts), trees_of.BLOCKS)
    blocks = materialise(packed.withColumn("block", F.monotonically_increasing_id()))
    return blocks.repartition(_tasks(rows.sparkSession), "block")


def fit_filter(
    complete: DataFrame,
    features: Sequence[str],
    trees: int = 100,
    seed: int = 1,
    depth: int = 20,
    least_in_node: int = 1,
    tried: int | None = None,
    at_once: int = ROWS_AT_ONCE,
) -> Forest:
    """Class-weighted forest on rows with complete features.

    With w the share of positives, negatives weigh w and positives 1 - w. Trees grow to ``depth``
    with ``tried`` of the features (their square root, rounded up) tried at a split, between cuts at
    quantiles. All rows are learned from and judged.

    A node that more than ``at_once`` rows reach is split from the counts of all tasks, the subtree
    below a smaller one is grown where its rows meet. The driver holds the splits of the
    former only; the trees are rows of a stage table.
    """
    features = list(features)
    data = complete.na.drop("any", subset=features)
    share = data.agg(F.avg((F.col("class") == "TP").cast("double"))).first()[0]
    if share is None:
        raise ValueError("no rows with complete features to learn from")
    staged = materialise(data.select("identifier", "class", *features))
    steps = [k / trees_of.BINS for k in range(1, trees_of.BINS)]
    cuts = [sorted(set(quantile_list(staged.select("identifier", f), f, steps))) for f in features]
    growth = trees_of.Growth(
        depth, least_in_node, tried or math.ceil(math.sqrt(len(features))), (share, 1 - share), seed
    )
    blocks = _blocks(staged, features, cuts).select("keys", "bins", "positive")
    tops, closed = _tops(blocks, len(features), trees, growth, at_once)
    cut_off = partial(trees_of.pieces, tops=tops, seed=seed)
    kernel = trees_of.grower(len(features), growth)
    parts = max(_tasks(complete.sparkSession), sum(len(open_) for _, open_ in tops.values()))
    below = materialise(
        blocks.mapInArrow(cut_off, trees_of.PIECES)
        .repartition(parts, "tree", "node")
        .groupBy("tree", "node")
        .applyInPandas(kernel, trees_of.NODES)
    )
    return Forest(features, cuts, growth.weights, trees, _joined(below, closed, growth))


def _tops(
    blocks: DataFrame, features: int, trees: int, growth: trees_of.Growth, at_once: int
) -> tuple[dict, dict]:
    """Splits and open nodes of each tree, and the nodes above the open ones by (tree, node): a
    round splits all open nodes that too many rows reach."""
    splits: dict[int, dict[int, tuple[int, int]]] = {t: {} for t in range(trees)}
    open_: dict[int, list[int]] = {t: [1] for t in range(trees)}
    closed: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    if blocks.agg(F.sum(F.octet_length("positive"))).first()[0] <= at_once:
        return {t: (splits[t], open_[t]) for t in splits}, closed
    look = {t: [1] for t in splits}
    kernel = trees_of.splitter(features, growth)
    schema = "tree int, node long, rows long, feature int, cut int, positives int, negatives int"
    while look:
        counted = blocks.mapInArrow(
            partial(trees_of.top_counts, trees={t: (splits[t], look[t]) for t in look}, seed=growth.seed),
            trees_of.COUNTS,
        )
        rows = counted.groupBy("tree", "node").applyInPandas(kernel, schema).collect()
        look = {}
        for r in rows:
            if r["rows"] <= at_once:
                continue
            open_[r["tree"]].remove(r["node"])
            closed[r["tree"], r["node"]] = (r["feature"], r["cut"], r["positives"], r["negatives"])
            if r["feature"] != trees_of.LEAF:
                splits[r["tree"]][r["node"]] = (r["feature"], r["cut"])
                children = [2 * r["node"], 2 * r["node"] + 1]
                open_[r["tree"]] += children
                look.setdefault(r["tree"], []).extend(children)
    return {t: (splits[t], open_[t]) for t in splits}, closed


def _joined(below: DataFrame, closed: dict, growth: trees_of.Growth) -> DataFrame:
    """Tops and subtrees as one table; leaves of both that lean alike and share a parent are merged."""
    if not closed:
        return below
    nodes = dict(closed)
    single = below.where(F.octet_length("feature") == 1).collect()
    for r in single:
        level = trees_of.unpacked(r)
        nodes[r["tree"], r["node"]] = tuple(int(x[0]) for x in level[1:])
    gone = set()
    for tree, node in sorted(closed, reverse=True):
        feature, cut, p, n = nodes[tree, node]
        children = [nodes.get((tree, 2 * node + k)) for k in (0, 1)]
        if feature == trees_of.LEAF or any(c is None or c[0] != trees_of.LEAF for c in children):
            continue
        if len({trees_of.leans(c[2], c[3], growth.weights) for c in children}) == 1:
            nodes[tree, node] = (trees_of.LEAF, cut, p, n)
            gone |= {(tree, 2 * node), (tree, 2 * node + 1)}
    spark = below.sparkSession
    rows = []
    for tree, node in closed:
        if (tree, node) not in gone:
            level = trees_of.Level(np.array([node]), *(np.array([x]) for x in nodes[tree, node]))
            rows.append((tree, node, *trees_of.packed(level).values()))
    absent = spark.createDataFrame([*gone, (-1, 0)], "tree int, node long")
    kept = below.join(F.broadcast(absent), ["tree", "node"], "left_anti")
    return materialise(kept.unionByName(spark.createDataFrame(rows, trees_of.NODES)))


def predict_class(model: Forest, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """identifier, class, pred and ``cls_prd`` = class-pred for rows with complete features.

    A task holds a group of trees and a share of the rows; the votes of all groups on a block of rows
    are added exactly."""
    full = rows.na.drop("any", subset=list(features))
    blocks = _blocks(full, features, model.cuts)
    total = blocks.agg(F.sum(F.octet_length("positive"))).first()[0] or 0
    shares = 1 + total // ROWS_A_SHARE
    groups = F.sequence(F.lit(0), F.lit((model.trees - 1) // TREES_A_GROUP))
    asked = blocks.select(
        "block", "bins", F.lit(len(features)).alias("width"),
        F.pmod(F.xxhash64("block"), F.lit(shares)).alias("share"), F.explode(groups).alias("group"),
    )
    held = model.nodes.select(
        "*", F.floor(F.col("tree") / TREES_A_GROUP).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<long>")).alias("share"),
    )
    parts = max(_tasks(rows.sparkSession), shares * ((model.trees - 1) // TREES_A_GROUP + 1))
    kernel = trees_of.voter(model.weights)

    def dealt(df: DataFrame):
        return df.repartition(parts, "group", "share").groupBy("group", "share")

    given = materialise(
        dealt(asked).cogroup(dealt(held)).applyInPandas(kernel, trees_of.VOTES)
    )
    named = blocks.select("block", "identifier", "class")
    scored = named.groupBy("block").cogroup(given.groupBy("block")).applyInPandas(
        trees_of.judged, "identifier string, class string, pred string"
    )
    return scored.select("identifier", "class", "pred", F.concat_ws("-", "class", "pred").alias("cls_prd"))


class Node(NamedTuple):
    """A node of a fitted tree: a leaf's shares of the classes, or a split at ``value``."""

    shares: tuple[float, float]
    feature: int
    value: float
    left: int
    right: int


def forest_nodes(model: Forest, spark: SparkSession) -> list[dict[int, Node]]:
    """The trees of a fitted filter as tables of nodes (0 is the root), for forests that the driver
    can hold."""
    trees: dict[int, dict[int, Node]] = {}
    for row in model.nodes.collect():
        level = trees_of.unpacked(row)
        positive = trees_of.shares(level.positives.astype(float), level.negatives.astype(float), model.weights)
        for k, f, c, p in zip(*(x.tolist() for x in (level.ids, level.feature, level.cut, positive))):
            inner = f != trees_of.LEAF
            at = model.cuts[f][c] if inner else 0.0
            share = p / trees_of.SCALE
            low, high = (2 * k - 1, 2 * k) if inner else (-1, -1)
            trees.setdefault(row["tree"], {})[k - 1] = Node((1 - share, share), f, at, low, high)
    return [trees[k] for k in sorted(trees)]


def tree_sql(nodes: dict[int, Node], features: Sequence[str], at: int = 0) -> str:
    """A tree as a nested CASE that gives the share of positives less that of negatives."""
    n = nodes[at]
    if n.left < 0:
        return repr(n.shares[1] - n.shares[0])
    low, high = (tree_sql(nodes, features, k) for k in (n.left, n.right))
    return f"CASE WHEN {features[n.feature]} <= CAST({n.value!r} AS DOUBLE) THEN {low} ELSE {high} END"


def forest_sql(trees: Sequence[dict[int, Node]], features: Sequence[str]) -> str:
    """The forest as standard SQL over the feature columns: TP where the trees together lean to
    positives, else TN. Any engine can judge with it."""
    votes = " + ".join(f"CAST({tree_sql(t, features)} AS DOUBLE)" for t in trees)
    return f"CASE WHEN {votes} > 0 THEN 'TP' ELSE 'TN' END"


def keep_list(predicted: DataFrame) -> DataFrame:
    """Identifiers to keep: all but the true positives that look negative."""
    return predicted.where(F.col("cls_prd") != "TP-TN").select("identifier")


def with_predictions(rows: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predictions joined back, "Discarded" where there are none, with frequency order."""
    joined = rows.join(predicted.select("identifier", "cls_prd"), "identifier", "left")
    filled = joined.withColumn("cls_prd", F.coalesce("cls_prd", F.lit(DISCARDED)))
    return order_by_frequency(filled, "cls_prd")
