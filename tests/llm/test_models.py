"""Sharding, search, language model, quality and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracles import compare, database
from diffspark.llm import elias_fano, lm_score, quality, queries, sharding, top_k
from tests.llm.conftest import texts

# --- sharding -------------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards(docs, plain, shards):
    out = sharding.shard(docs, shards).collect()
    size = {i: len((t or "").encode()) + 8 for i, t in plain}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in plain}
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {i: (size[i], crc[i]) for i in size}
    parts = defaultdict(list)
    for r in sorted(out, key=lambda r: r.doc_id):
        parts[r.shard].append(r)
    largest, mean = max(size.values()), sum(size.values()) / shards
    assert set(parts) <= set(range(shards))
    for rows in parts.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - mean) <= largest
    order = [r.shard for r in sorted(out, key=lambda r: r.doc_id)]
    assert order == sorted(order)


def test_shards_of_odd_texts(odd, none, tmp_path):
    out = sharding.shard(odd, 4).collect()
    assert Counter(r.size for r in out) == Counter(len((t or "").encode()) + 8 for _, t in texts())
    for s in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none, 4).count() == 0
    wide = odd.withColumnRenamed("shard", "old")
    sharding.write_shards(wide, 4, str(tmp_path / "s"), 2)
    back = odd.sparkSession.read.parquet(str(tmp_path / "s"))
    assert Counter(r.shard for r in back.collect()) == Counter(r.shard for r in out)
    assert {"doc_id", "text", "old", "slot"} <= set(back.columns)


# --- search -----------------------------------------------------------------------------------


def brute(rows, k):
    """Queries are ids divisible by 100."""
    vectors = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((n, i, [math.floor(1024 * x) for x in v]))
    want = Counter()
    for n, i, v in vectors:
        if i is not None and i % 100 == 0:
            found = sorted(
                (-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, m)
                for m, j, w in vectors
                if m != n
            )[:k]
            for r, (s, missing, j, _) in enumerate(found, 1):
                want[i, r, None if missing else j, -s] += 1
    return want


def found(df, k):
    out = top_k.top_k(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k)
    return Counter(tuple(r) for r in out.collect())


def test_top_k_in_many_groups(spark, monkeypatch):
    for name, value in (("GROUP", 50), ("BLOCK", 3), ("TILE", 16)):
        monkeypatch.setattr(top_k, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=12) * (1 + i % 7)]) for i in range(700)]
    rows += [(800 + i, rows[0][1]) for i in range(30)] + [(100, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, 10) == brute(rows, 10)


def test_top_k_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]),
        (None, [3.0, 3.0]), (5, []), (6, [1.0, 2.0, 9.0]), (100, [0.0, 0.0]), (100, [0.0, 0.0]), (7, [-1.0, 0.3]),
        (200, [1e8, -1e8]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    assert found(df, 4) == brute(rows, 4)
    assert found(df.where("false"), 4) == Counter()
    assert sum(found(df.where("vec_id = 0"), 4).values()) == 0


def test_top_k_float_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert found(df, 10) == brute(rows, 10)


# --- language model ------------------------------------------------------------------------------


@pytest.mark.parametrize("n,top", [(0, 9), (1, 1), (5, 3), (1000, 900), (1000, 2**63), (50_000, 10**6)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    packed = elias_fano.EliasFano.of(values)
    assert (packed.access(np.arange(n)) == values).all()
    x = np.concatenate([values, rng.integers(0, top + 5, 300, dtype=np.uint64)])
    at = np.searchsorted(values, x)
    assert (packed.successor(x) == at).all()
    hit = (at < n) & (values[np.minimum(at, n - 1)] == x) if n else np.zeros(len(x), bool)
    assert (packed.find(x) == np.where(hit, at, -1)).all()


def test_trie_is_mapped_and_searched():
    rng = np.random.default_rng(1)
    contexts = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    sizes = rng.integers(0, 20, len(contexts))
    codes = [np.sort(rng.choice(2**40, k, replace=False)) for k in sizes]
    codes = np.concatenate(codes).astype(np.uint64)
    share, backoff = rng.random(len(codes)), rng.random(len(contexts))
    trie = elias_fano.Trie.of(contexts, sizes, codes, share, backoff).mapped()
    a, b = trie.look_up(contexts, sizes, codes)
    assert np.allclose(elias_fano.value(a), share, rtol=6e-4) and np.allclose(elias_fano.value(b), backoff, rtol=6e-4)
    a, b = trie.look_up(contexts + np.uint64(1), sizes, codes)
    assert (a == elias_fano.UNKNOWN).all() and (b == elias_fano.UNKNOWN).all()
    a, _ = trie.look_up(contexts, sizes, codes ^ np.uint64(1))
    assert (a == elias_fano.UNKNOWN).all()


def expected_scores(rows):
    low = {c: c + 32 for c in range(65, 91)}
    tokens = [[w for w in re.split("[ \t-\r]+", (t or "").translate(low)) if w] + [0] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    one, two = Counter(), Counter()
    for ws, h in zip(tokens, held, strict=True):
        if not h:
            one.update(ws)
            one[1] += 1  # the start context
            two.update(zip([1, *ws], ws, strict=False))
    starts = one.pop(1, 0)
    n, v, prior = sum(one.values()), len(one), lm_score.PRIOR
    out = []
    for (i, _), ws, h in zip(rows, tokens, held, strict=True):
        base = [(one[w] + 1) / (n + v + 1) for w in ws]
        total = [starts if c == 1 else one[c] for c in [1, *ws[:-1]]]
        p = [(two[c, w] + prior * b) / (t + prior) for c, w, b, t in zip([1, *ws], ws, base, total, strict=False)]
        known = sum(one[w] > 0 for w in ws)
        out.append((str(i), h, len(ws), known, n, sum(map(math.log10, base)), sum(map(math.log10, p))))
    return sorted(out)


def check_scores(out, rows):
    got = sorted((str(r[0]), *r[1:]) for r in map(tuple, out))
    for a, b in zip(got, expected_scores(rows), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert abs(a[6] - b[6]) <= 2e-4 * a[2]


@pytest.mark.parametrize("hot", [4096, 20])
def test_scores(docs, plain, monkeypatch, hot):
    """With few hot contexts and with many, in small blocks."""
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(lm_score, "HOT", hot)
    out = lm_score.score(docs).collect()
    check_scores(out, plain)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_odd_texts(odd, none, spark):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check_scores(lm_score.score(odd).collect(), rows)
    assert lm_score.score(none).count() == 0
    alone = next(i for i in range(100) if lm_score.held_out(i))
    check_scores(lm_score.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect(), [(alone, "a b")])


# --- quality ---------------------------------------------------------------------------------------


def test_quality_separates(docs, spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    out = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    judged = [(r.quality, out[r.doc_id].kept) for r in labels.collect() if r.doc_id in out]
    good, bad = ([k for q, k in judged if q == v] for v in (1, 0))
    assert sum(good) >= 0.9 * len(good)  # learned from some forty labels
    assert sum(bad) <= 0.5 * len(bad)


def test_cutoff(spark):
    rng = random.Random(7)
    keys = [rng.choice([rng.gauss(0, 1), 0.25]) for _ in range(3000)] + [1e9, -1e9]
    df = spark.createDataFrame([(k,) for k in keys], "key double").cache()
    ordered = sorted(keys, reverse=True)
    for k in (1, 2, 700, 1500, len(keys)):
        least, ties = quality.cutoff(df, k)
        assert least == ordered[k - 1]
        assert ties == k - sum(x > least for x in keys)


def test_nth_row(spark):
    rng = random.Random(8)
    rows = rng.sample(range(1 << 62), 900) + list(range(5000, 5600))
    df = spark.createDataFrame([(r,) for r in rows], "row long").cache()
    ordered = sorted(rows)
    for n in (1, 2, 333, 1499, 1500):
        assert quality.nth_row(df, n) == ordered[n - 1]


def test_quality_ties(spark, docs, small):
    """Rows that tie at the cut are taken in their order."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    text = docs.where("doc_id = 0").first().text
    same = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    both = docs.select("doc_id", "text").unionByName(same.repartition(3))
    out = quality.scores(both, labels).collect()
    ranked = sorted(out, key=lambda r: (-r.key, r.row))
    assert sum(r.kept for r in out) > 0
    assert [r.kept for r in ranked] == sorted((r.kept for r in out), reverse=True)


def test_quality_judges_each_labelled_id_once(spark):
    """However many rows share a labelled id, the driver gets one weight of it."""
    rows = [(1, True, float(i)) for i in range(500)] + [(2, True, 7.0), (3, False, 7.0), (4, None, 1.0)]
    keyed = spark.createDataFrame(rows, "doc_id long, verdict boolean, log_weight double")
    got = sorted(tuple(r) for r in quality.judged_weights(keyed).collect())
    assert got == [(False, 7.0), (True, 0.0), (True, 7.0)]


def test_quality_odd_cases(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (7, None), (13, 0), (13, 1)], "doc_id long, quality int")
    out = quality.keep_good(odd, labels)
    assert out.columns == odd.columns
    empty = labels.where("false")
    assert quality.keep_good(odd, empty).count() == odd.count()
    assert quality.scores(none, labels).count() == 0
    assert quality.scores(none, empty).count() == 0


# --- all together -------------------------------------------------------------------------------------


def test_pipeline(spark, small, plain):
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["quality classifier", "exact dedup", "near dedup", "packing"]
    out = corpus_pipeline.run(spark, small).collect()
    kept = {r.doc_id for r in out}
    bad = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 0").collect()}
    assert len(kept & bad) <= 0.5 * len(bad)
    by_text = defaultdict(list)
    for i, t in plain:
        by_text[t].append(i)
    assert all(len(kept & set(ids)) <= 1 for ids in by_text.values())
    for r in out:
        assert 0 <= r.offset and r.offset + r.length <= 2048


def test_stages_pass_columns_on(spark, docs, small):
    df = docs.limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, small)
        assert df.columns == docs.columns


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_matches_sql(spark, small, key):
    text, *_ = compare(spark, database(small), key, small)
    assert text.startswith("ok") and "TYPES" not in text, text


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
