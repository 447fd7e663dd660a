"""Kernels of the forest: rows as blocks of bins, counts by class and bin, growth of a subtree, votes.

Nodes are numbered as in a heap: the root is 1, the children of k are 2k (at most the cut) and 2k + 1.
A feature's bin is the number of its cuts below the value, so a value is at most cut c exactly if its
bin is at most c. Counts are whole numbers, class weights multiply them last: no result depends on the
order or the partitions of the rows. Draws are hashes of row, tree, node and seed.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCKS = "keys binary, bins binary, positive binary, identifier array<string>, class array<string>"
COUNTS = "tree int, node long, rows long, counts binary"
PIECES = "tree int, node long, rows binary"
NODES = "tree int, node long, ids binary, feature binary, cut binary, positives binary, negatives binary"
VOTES = "block long, votes binary"

LEAF = -1
BINS = 32
STEP = 2048  # nodes whose counts are looked at together
SCALE = 1 << 40  # shares are multiples of 1 / SCALE, so that sums of votes are exact


class Growth(NamedTuple):
    """What a node may do. ``weights`` are those of negatives and positives."""

    depth: int
    least_in_node: int
    tried: int
    weights: tuple[float, float]
    seed: int


class Level(NamedTuple):
    """Nodes of a tree: feature is LEAF for a leaf; the counts are those of the drawn rows."""

    ids: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    positives: np.ndarray
    negatives: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        z = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def times_drawn(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson numbers of mean 1."""
    salt = mixed(np.array([seed, tree], dtype=np.int64))
    u = (mixed(keys ^ mixed(salt[:1] ^ salt[1:] << np.uint64(1))) >> np.uint64(11)) * 2.0**-53
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
    return np.searchsorted(below, u, side="right").astype(np.uint8)


def tried_features(ids: np.ndarray, tree: int, features: int, growth: Growth) -> np.ndarray:
    """Which features a node may split: ``tried`` of them, by hash."""
    salt = mixed(ids.astype(np.uint64) ^ mixed(np.array([growth.seed + (tree << 20)])))
    draw = mixed(salt[:, None] ^ mixed(np.arange(1, features + 1))[None, :])
    return np.argsort(np.argsort(draw, axis=1), axis=1) < growth.tried


def to_blocks(
    batches: Iterator[pa.RecordBatch], features: Sequence[str], cuts: Sequence[Sequence[float]]
) -> Iterator[pa.RecordBatch]:
    """One row per batch of (key, identifier, class, features)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(f).to_numpy(zero_copy_only=False) for f in features]
        bins = np.stack([np.searchsorted(c, x) for c, x in zip(cuts, columns)], axis=1).astype(np.uint8)
        classes = batch.column("class").to_pylist()
        positive = np.array([c == "TP" for c in classes], dtype=np.uint8)
        keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
        row = [keys.tobytes(), bins.tobytes(), positive.tobytes(), batch.column("identifier").to_pylist(), classes]
        names = ["keys", "bins", "positive", "identifier", "class"]
        yield pa.RecordBatch.from_pydict({n: [x] for n, x in zip(names, row)})


def rows_of_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.frombuffer(row["keys"], dtype=np.int64).view(np.uint64)
    bins = np.frombuffer(row["bins"], dtype=np.uint8).reshape(len(keys), -1)
    return keys, bins, np.frombuffer(row["positive"], dtype=np.uint8)


def walk(bins: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    """Node that each row reaches by the splits (node: feature, cut) of the top of a tree."""
    at = np.ones(len(bins), dtype=np.int64)
    for node in sorted(splits):
        here = np.flatnonzero(at == node)
        feature, cut = splits[node]
        at[here] = 2 * node + (bins[here, feature] > cut)
    return at


def class_counts(slot, bins, positive, drawn, nodes: int) -> np.ndarray:
    """Drawn rows as (node, feature, bin, class)."""
    out = np.empty((nodes, bins.shape[1], BINS, 2))
    base = slot.astype(np.int64) * (2 * BINS) + positive
    for f in range(bins.shape[1]):
        found = np.bincount(base + 2 * bins[:, f].astype(np.int64), drawn, nodes * 2 * BINS)
        out[:, f] = found.reshape(nodes, BINS, 2)
    return out


def top_counts(batches: Iterator[pa.RecordBatch], trees: dict, seed: int) -> Iterator[pa.RecordBatch]:
    """Counts of a task's rows in the open nodes of the tops: ``trees`` has (splits, open nodes)."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    sizes: dict[tuple[int, int], int] = {}
    for batch in batches:
        for row in batch.to_pylist():
            keys, bins, positive = rows_of_block(row)
            for tree, (splits, wanted) in trees.items():
                drawn = times_drawn(keys, tree, seed)
                at = walk(bins, splits)
                for node in wanted:
                    here = np.flatnonzero((at == node) & (drawn > 0))
                    counts = class_counts(np.zeros(len(here)), bins[here], positive[here], drawn[here], 1)[0]
                    sums[tree, node] = sums.get((tree, node), 0) + counts
                    sizes[tree, node] = sizes.get((tree, node), 0) + len(here)
    if sums:
        yield pa.RecordBatch.from_pydict(
            {
                "tree": pa.array([t for t, _ in sums], pa.int32()),
                "node": pa.array([n for _, n in sums], pa.int64()),
                "rows": pa.array([sizes[k] for k in sums], pa.int64()),
                "counts": [c.tobytes() for c in sums.values()],
            }
        )


def splitter(features: int, growth: Growth):
    return lambda group: top_splits(group, features, growth)


def grower(features: int, growth: Growth):
    return lambda group: subtrees(group, features, growth)


def voter(weights: tuple[float, float]):
    return lambda blocks, nodes: votes(blocks, nodes, weights)


def top_splits(group, features: int, growth: Growth):
    """The split of one open node from the counts of all tasks."""
    import pandas as pd

    tree, node = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
    shape = (1, features, BINS, 2)
    counts = sum(np.frombuffer(x).reshape(shape) for x in group["counts"])
    ids = np.array([node])
    feature, cut, n, p = best_splits(counts, ids, tree, growth)
    rows = int(group["rows"].sum())
    values = [tree, node, rows, int(feature[0]), int(cut[0]), int(p[0]), int(n[0])]
    return pd.DataFrame([values], columns=["tree", "node", "rows", "feature", "cut", "positives", "negatives"])


def best_splits(counts: np.ndarray, ids: np.ndarray, tree: int, growth: Growth):
    """Feature (LEAF: none gains) and cut of each node by the weighted Gini impurity, and its
    drawn negatives and positives. Ties go to the first feature and cut."""
    left = np.cumsum(counts, axis=2)[:, :, :-1]
    total = counts[:, :1].sum(axis=2, keepdims=True)
    right = total - left

    def impure(c: np.ndarray) -> np.ndarray:
        """Weight times Gini impurity: 2 w0 w1 / (w0 + w1)."""
        a, b = c[..., 0] * growth.weights[0], c[..., 1] * growth.weights[1]
        return np.divide(2 * a * b, a + b, out=np.zeros_like(a), where=a + b > 0)

    whole = impure(total)
    gain = whole - impure(left) - impure(right)
    enough = np.minimum(left.sum(-1), right.sum(-1)) >= max(1, growth.least_in_node)
    may = tried_features(ids, tree, counts.shape[1], growth)[:, :, None]
    gain = np.where(enough & may, gain, -1.0).reshape(len(ids), -1)
    best = gain.argmax(axis=1)
    gains = gain[np.arange(len(ids)), best] > 1e-12 * np.maximum(1.0, whole.reshape(-1))
    open_ = ids < 1 << growth.depth  # a node of depth k has a number from 2 ** k
    feature = np.where(gains & open_, best // (BINS - 1), LEAF)
    n, p = total.reshape(len(ids), 2).T
    return feature, best % (BINS - 1), n, p


def grow(bins, positive, drawn, root: int, tree: int, growth: Growth) -> Level:
    """The subtree below ``root``, level by level, for the rows that reach it. Rows are kept in the
    order of their nodes, so that a step of nodes is a run of rows."""
    levels: list[Level] = []
    ids, slot = np.array([root], dtype=np.int64), np.zeros(len(bins), dtype=np.int64)
    while len(ids):
        feature, cut = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        n, p = np.empty(len(ids)), np.empty(len(ids))
        for a in range(0, len(ids), STEP):
            b = min(a + STEP, len(ids))
            i, j = np.searchsorted(slot, (a, b))
            counts = class_counts(slot[i:j] - a, bins[i:j], positive[i:j], drawn[i:j], b - a)
            feature[a:b], cut[a:b], n[a:b], p[a:b] = best_splits(counts, ids[a:b], tree, growth)
        levels.append(Level(ids, feature, cut, p, n))
        split = np.flatnonzero(feature != LEAF)
        place = np.full(len(ids), -1, dtype=np.int64)
        place[split] = np.arange(len(split))
        goes = np.flatnonzero(place[slot] >= 0)
        at = slot[goes]
        child = 2 * place[at] + (bins[goes, feature[at]] > cut[at])
        order = np.argsort(child, kind="stable")
        goes, slot = goes[order], child[order]
        bins, positive, drawn = bins[goes], positive[goes], drawn[goes]
        ids = (2 * ids[split][:, None] + np.arange(2)).reshape(-1)
    return pruned(Level(*(np.concatenate(x) for x in zip(*levels))), growth.weights)


def leans(positives, negatives, weights):
    return positives * weights[1] > negatives * weights[0]


def pruned(nodes: Level, weights: tuple[float, float]) -> Level:
    """Without splits between leaves that lean to the same class, from the bottom up."""
    order = np.argsort(nodes.ids)
    ids, feature, cut, p, n = (x[order] for x in nodes)
    alive = np.ones(len(ids), dtype=bool)
    side = leans(p, n, weights)
    depth = np.floor(np.log2(ids)).astype(int)
    for d in range(depth.max(), -1, -1):
        inner = np.flatnonzero((depth == d) & (feature != LEAF))
        if not len(inner):
            continue
        low = np.searchsorted(ids, 2 * ids[inner])  # its sibling is the next
        same = (feature[low] == LEAF) & (feature[low + 1] == LEAF) & (side[low] == side[low + 1])
        feature[inner[same]] = LEAF
        alive[low[same]] = alive[low[same] + 1] = False
    return Level(*(x[alive] for x in (ids, feature, cut, p, n)))


def packed(nodes: Level) -> dict[str, bytes]:
    kinds = (np.int64, np.int8, np.int8, np.int32, np.int32)
    return {k: x.astype(t).tobytes() for k, x, t in zip(Level._fields, nodes, kinds)}


def unpacked(row) -> Level:
    kinds = (np.int64, np.int8, np.int8, np.int32, np.int32)
    return Level(*(np.frombuffer(row[k], dtype=t) for k, t in zip(Level._fields, kinds)))


def pieces(
    batches: Iterator[pa.RecordBatch], tops: dict[int, tuple[dict, list[int]]], seed: int
) -> Iterator[pa.RecordBatch]:
    """Drawn rows of each block by tree and the open node they reach: bins, class, times drawn."""
    for batch in batches:
        for row in batch.to_pylist():
            keys, bins, positive = rows_of_block(row)
            for tree, (splits, open_) in tops.items():
                drawn = times_drawn(keys, tree, seed)
                rows = np.column_stack([bins, positive, drawn])[drawn > 0]
                at = walk(rows, splits)
                found = {node: rows[at == node].tobytes() for node in open_}
                found = {node: x for node, x in found.items() if x}
                if found:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "tree": pa.array([tree] * len(found), pa.int32()),
                            "node": pa.array(list(found), pa.int64()),
                            "rows": list(found.values()),
                        }
                    )


def subtrees(group, features: int, growth: Growth):
    """The subtree of one open node from the rows that reach it."""
    import pandas as pd

    tree, node = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
    rows = np.frombuffer(b"".join(group["rows"]), dtype=np.uint8).reshape(-1, features + 2)
    nodes = grow(rows[:, :features], rows[:, -2], rows[:, -1], node, tree, growth)
    return pd.DataFrame([{"tree": tree, "node": node, **packed(nodes)}])


def shares(positives, negatives, weights) -> np.ndarray:
    """Share of positives in leaves, as multiples of 1 / SCALE. Where only one class is learned from,
    it weighs nothing and is the answer."""
    p, n = positives * weights[1], negatives * weights[0]
    share = np.divide(p, p + n, out=(positives > 0).astype(float), where=p + n > 0)
    return np.rint(SCALE * share).astype(np.int64)


def votes(blocks, nodes, weights: tuple[float, float]):
    """Votes of a group of trees on the rows of blocks: share of positives less that of negatives,
    summed over the trees, in units of 1 / SCALE."""
    import pandas as pd

    found = {}
    for _, block in blocks.iterrows():
        features = block["width"]
        found[block["block"]] = (np.frombuffer(block["bins"], dtype=np.uint8).reshape(-1, features), [])
    for _, parts in nodes.groupby("tree"):
        every = Level(*(np.concatenate(x) for x in zip(*(unpacked(r) for _, r in parts.iterrows()))))
        order = np.argsort(every.ids)
        ids, feature, cut, p, n = (x[order] for x in every)
        inner = feature != LEAF
        low = np.where(inner, np.searchsorted(ids, 2 * ids), 0)  # its sibling is the next
        vote = 2 * shares(p.astype(float), n.astype(float), weights) - SCALE
        for bins, got in found.values():
            at = np.zeros(len(bins), dtype=np.int64)
            going = np.flatnonzero(inner[at])
            while len(going):
                here = at[going]
                at[going] = low[here] + (bins[going, feature[here]] > cut[here])
                going = going[inner[at[going]]]
            got.append(vote[at])
    rows = [(k, sum(got).astype(np.int64).tobytes()) for k, (_, got) in found.items() if got]
    return pd.DataFrame(rows, columns=["block", "votes"])


def judged(blocks, given):
    """(identifier, class, pred) of the rows of a block from the votes of all groups of trees."""
    import pandas as pd

    out = []
    for _, block in blocks.iterrows():
        total = sum(np.frombuffer(v, dtype=np.int64) for v in given["votes"])
        pred = np.where(np.broadcast_to(total > 0, len(block["identifier"])), "TP", "TN")
        out.append(pd.DataFrame({"identifier": block["identifier"], "class": block["class"], "pred": pred}))
    return pd.concat(out) if out else pd.DataFrame(columns=["identifier", "class", "pred"])
