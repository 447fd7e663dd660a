"""Exact top-k search by inner product over norm-sorted vectors.

1. Components become integers, floor(1024 * x). One pass sums the matrix of second moments (of the
   dimension's size, whatever the rows); its eigenvectors are the right singular
   vectors of the data. Vectors are rotated by them, so that the first coordinates hold most of
   every inner product.
2. Candidates are dealt to groups by descending length, in ranges; queries to blocks by hash.
3. Every block of queries first meets the group of the longest vectors. Its k-th best score so far is a
   lower bound that it takes along to all other groups.
4. Inside a group vectors come in tiles by descending length. A tile is left out for a query
   if the product of the lengths is below the bound; then the partial product over the
   first coordinates plus the product of the lengths of what remains (Cauchy-Schwarz) must
   reach it; only what is left gets its exact integer product.
5. The bests of all groups are ranked per query: k rows per query and group at most.

Queries are stated by a condition and meet the candidates in blocks: a task holds one block
and one group of bounded size; nothing is broadcast.

Cases: vectors that are null, or hold a null or non-finite component, take no part. Vectors
of different sizes are compared as if the shorter were filled with zeros; an empty vector has score
0 with all. Rows that repeat are different candidates (and queries). Ties go to the
smaller ``vec_id``, null last, then to the earlier row. An empty table gives no rows.
Scores must fit a 64-bit integer. Columns beside the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.llm.common import ship, table
from diffspark.stage import materialise

ship(__name__)

SCALE = 1024
GROUP, BLOCK, TILE = 16_384, 4_096, 512  # vectors a group, queries a block, vectors a tile
HEAD = 0.5  # share of the coordinates in the partial product
EXACT = float(1 << 53)


def integers(vectors: DataFrame, id_col: str, vector_col: str, query: Column) -> DataFrame:
    """(row, vec_id, query, v array<long>, norm2) of the vectors that take part."""
    x = F.col("_x")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    finite = x.isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    )
    return (
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("vec_id"),
            F.coalesce(query, F.lit(False)).alias("query"),
            F.col(vector_col).alias("_x"),
        )
        .where(F.coalesce(finite, F.lit(False)))
        .select("row", "vec_id", "query", whole.alias("v"))
        .withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    )


def matrix(column, width: int) -> np.ndarray:
    """Vectors of up to ``width`` components as rows."""
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column("v").to_pylist(), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "total"]
        )

    return run


class Best:
    """The k best candidates of each query so far, with their scores and tie-breakers."""

    def __init__(self, k: int, bounds: np.ndarray):
        self.k, self.bound = k, bounds.astype(float)
        self.rows: list[list[tuple]] = [[] for _ in bounds]

    def add(self, query: int, found: list[tuple]) -> None:
        best = sorted(self.rows[query] + found)[: self.k]
        self.rows[query] = best
        if len(best) == self.k:
            self.bound[query] = max(self.bound[query], float(-best[-1][0]))


def order(vec_id, row) -> tuple:
    return (True, 0, row) if pd.isna(vec_id) else (False, int(vec_id), row)


def search(k: int, width: int, rotation: np.ndarray):
    """One block of queries (side 0) against one group of candidates (side 1)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ask = f[f["side"] == 0].reset_index(drop=True)
        have = f[f["side"] == 1].sort_values(["norm2", "row"], ascending=[False, True]).reset_index(drop=True)
        if not len(ask) or not len(have):
            return pd.DataFrame(columns=FOUND_NAMES)
        q, c = matrix(ask["v"], width), matrix(have["v"], width)
        exact = q.astype(float), c.astype(float)
        fits = width * max(1.0, np.abs(exact[0]).max(initial=0.0)) * max(1.0, np.abs(exact[1]).max(initial=0.0)) < EXACT
        turned_q, turned_c = exact[0] @ rotation, exact[1] @ rotation
        h = max(1, int(width * HEAD))
        length_q, length_c = np.sqrt(ask["norm2"].to_numpy()), np.sqrt(have["norm2"].to_numpy())
        rest_q, rest_c = (np.linalg.norm(t[:, h:], axis=1) for t in (turned_q, turned_c))
        best = Best(k, ask["bound"].fillna(-np.inf).to_numpy(float))
        rows_q, rows_c, ids_c = ask["row"].to_numpy(), have["row"].to_numpy(), have["vec_id"].to_numpy(object)
        for at in range(0, len(have), TILE):
            tile = slice(at, min(at + TILE, len(have)))
            slack = 1e-9 * (1.0 + length_q * length_c[at])  # rounding of the rotated products
            live = np.flatnonzero(length_q * length_c[at] + slack >= best.bound)
            if not len(live):
                break  # all later vectors are shorter
            head = turned_q[live, :h] @ turned_c[tile, :h].T
            top = head + np.outer(rest_q[live], rest_c[tile]) + slack[live, None]
            hit = top >= best.bound[live, None]
            for i in np.flatnonzero(hit.any(axis=1)):
                n = live[i]
                j = at + np.flatnonzero(hit[i])
                j = j[rows_c[j] != rows_q[n]]
                if fits:
                    score = np.rint(exact[1][j] @ exact[0][n]).astype(np.int64)
                else:
                    score = np.array([int(x) for x in c[j].astype(object) @ q[n].astype(object)], np.int64)
                good = score >= best.bound[n]
                best.add(n, [(-int(s), *order(ids_c[m], int(rows_c[m]))) for s, m in zip(score[good], j[good], strict=True)])
        out = [
            (int(rows_q[n]), ask["vec_id"].iloc[n], None if none else vec, row, -score)
            for n, rows in enumerate(best.rows)
            for score, none, vec, row in rows
        ]
        return pd.DataFrame(out, columns=FOUND_NAMES).astype({"vec_id": "Int64"})

    return run


FOUND = "query_row long, query_id long, vec_id long, row long, score long"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def top_k(vectors: DataFrame, id_col: str, vector_col: str, query: Column, k: int) -> DataFrame:
    """The ``k`` candidates of highest inner product for every row that meets ``query``:
    query_id, rank (from 1), vec_id, score. Candidates are all rows but the query's own."""
    rows = materialise(integers(vectors, id_col, vector_col, query))
    total, asked, width = rows.agg(
        F.count(F.lit(1)), F.count_if("query"), F.max(F.size("v"))
    ).first()
    width = max(1, width or 0)
    cells = rows.select("v").mapInArrow(moments(width), "cell long, total double")
    sums = np.zeros(width * width)
    for cell, value in cells.groupBy("cell").agg(F.sum("total")).collect():  # width ** 2 rows
        sums[cell] = value
    rotation = np.linalg.eigh(sums.reshape(width, width))[1][:, ::-1]
    groups, blocks = max(1, -(-total // GROUP)), max(1, -(-asked // BLOCK))
    longest_first = [F.desc("norm2"), F.asc("row")]
    dealt = materialise(
        rows.repartitionByRange(groups, *longest_first).withColumn("group", F.spark_partition_id())
    )
    groups = 1 + (dealt.agg(F.max("group")).first()[0] or 0)
    asks = dealt.where("query").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    columns = ["group", "block", "side", "row", "vec_id", "v", "norm2", "bound"]

    def met(group_from: int, group_to: int, bounds: DataFrame | None) -> DataFrame:
        """Bests in a range of groups, each met by all blocks."""
        numbers = F.sequence(F.lit(group_from), F.lit(group_to - 1))
        q = asks.withColumn("group", F.explode(numbers)).withColumn("side", F.lit(0))
        if bounds is None:
            q = q.withColumn("bound", F.lit(None).cast("double"))
        else:
            q = q.join(bounds, q["row"] == bounds["query_row"], "left").drop("query_row")
        c = (
            dealt.where(F.col("group").between(group_from, group_to - 1))
            .withColumns({"side": F.lit(1), "bound": F.lit(None).cast("double")})
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        )
        both = q.select(columns).unionByName(c.select(columns))
        return materialise(both.groupBy("group", "block").applyInPandas(search(k, width, rotation), FOUND))

    found = met(0, 1, None)
    if groups > 1:
        full = found.groupBy("query_row").agg(F.min("score").cast("double").alias("bound"), F.count(F.lit(1)).alias("n"))
        found = found.union(met(1, groups, full.where(F.col("n") == k).drop("n")))
    ranked = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest scores of every vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10)


SQL = {
    "op5_exact_top_k": """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, 1 + len(q.e))]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
