"""Exact, near and line dedup against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from diffspark.llm import exact_dedup, line_dedup, near_dedup
from diffspark.llm.components import components


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


# --- exact ------------------------------------------------------------------------------


def expected_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(-1 if i is None else i)
    return {t: (max(ids), len(ids)) for t, ids in groups.items()}


def test_exact_index_from_empty(spark, odd):
    out = exact_dedup.DigestIndex(spark, buckets=4).add(odd).collect()
    rows = odd.select("doc_id", "text").collect()
    assert len(out) == len(rows)
    want = expected_exact(rows)
    digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    kept = Counter()
    for r in out:
        keep, size = digest[r.text_sha256]
        assert (-1 if r.keep_id is None else r.keep_id, r.group_size) == (keep, size)
        kept[r.text_sha256] += r.kept
        assert not r.known and (not r.kept or (-1 if r.doc_id is None else r.doc_id) == keep)
    assert set(kept.values()) == {1}


def test_exact_index_goes_on(spark, odd, none, tmp_path):
    path = str(tmp_path / "index")
    first = exact_dedup.DigestIndex(spark, path, buckets=4)
    a = first.add(odd.where("doc_id <= 5"))
    assert a.where("kept").count() == a.select("text_sha256").distinct().count()
    again = exact_dedup.DigestIndex(spark, path, buckets=4)  # as a later session would
    b = again.add(odd).cache()
    known = {r.text_sha256 for r in a.collect()}
    assert {r.text_sha256 for r in b.where("known").collect()} == known
    assert b.where("kept and known").count() == 0
    assert b.where("kept").count() == b.select("text_sha256").distinct().count() - len(known)
    assert again.add(none).count() == 0
    assert again.add(odd).where("kept").count() == 0
    assert again.rows().count() == again.rows().select("digest").distinct().count()


def test_exact_batch_again(spark, odd, tmp_path, monkeypatch):
    """A batch that failed behind its append, or half way through it, is added again."""
    path = str(tmp_path / "index")
    with exact_dedup.DigestIndex(spark, path, buckets=4) as index:
        index.add(odd.where("doc_id <= 3"), batch="one").collect()

    def shown(out):
        columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256", "known")
        return sorted(map(str, out.select(*columns).collect()))

    with exact_dedup.DigestIndex(spark, path) as index:
        assert index.buckets == 4
        first = shown(index.add(odd, batch="two"))
    with exact_dedup.DigestIndex(spark, path) as index:
        again = shown(index.add(odd.repartition(2), batch="two"))
        digests = index.rows().count()
        other = index.add(odd, batch="three")
        assert other.where("kept").count() == 0 and other.where("not known").count() == 0
        assert index.rows().count() == digests == index.rows().select("digest").distinct().count()
    assert again == first
    half = str(tmp_path / "half")
    with exact_dedup.DigestIndex(spark, half, buckets=2) as index:
        index.add(odd.where("doc_id > 5"), batch="b")
        kept = index.add(odd, batch="b").where("kept")
        assert kept.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert not [t for t in spark.catalog.listTables() if t.name == index.name]
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, half, buckets=3)


def test_exact_buckets_follow_size(spark, odd, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 1)
    with exact_dedup.DigestIndex(spark) as index:
        assert index.rows().count() == 0
        index.add(odd)
        assert index.buckets == 16


def test_keep_first_keeps_columns(spark, odd):
    out = exact_dedup.keep_first(odd, exact_dedup.DigestIndex(spark, buckets=2))
    assert out.columns == odd.columns
    assert out.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()


# --- components -----------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges += [(100 + i, 101 + i) for i in range(40)]  # a long chain
    edges += [(200, 200 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: forest.find(x) for x in linked}


def test_no_components(spark):
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


# --- near -----------------------------------------------------------------------------------


def shingle_set(text, size=5):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split("[ \t-\r]+", low) if w]
    n = min(size, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def expected_near(rows, percent):
    """Per row: set size, and the smallest id of its component (null ids last)."""
    sets = [shingle_set(t) for _, t in rows]
    forest = Forest()
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        meets = Counter(j for x in s for j in holders[x])
        for j, common in meets.items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                forest.join(i, j)
        for x in s:
            holders[x].append(i)
    least = defaultdict(lambda: float("inf"))
    for i, (doc, _) in enumerate(rows):
        least[forest.find(i)] = min(least[forest.find(i)], float("inf") if doc is None else doc)
    return [(doc, len(sets[i]), least[forest.find(i)]) for i, (doc, _) in enumerate(rows)]


def shown_near(out):
    return Counter(
        (r.doc_id, r.n_shingles, float("inf") if r.component_id is None else r.component_id) for r in out
    )


@pytest.mark.parametrize("percent", [80, 85])
def test_near_against_all_pairs(docs, plain, percent):
    out = near_dedup.near_duplicates(docs, percent).collect()
    assert shown_near(out) == Counter(expected_near(plain, percent))
    assert sum(r.first for r in out) == len({(r.component_id,) for r in out})


def test_near_odd_cases(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    out = near_dedup.near_duplicates(odd, 85).collect()
    assert shown_near(out) == Counter(expected_near(rows, 85))
    kept = near_dedup.keep_one(odd, 85)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.first for r in out)
    assert near_dedup.near_duplicates(none, 85).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_near_signatures_lose_less_than_bands(percent):
    """The share of pairs that signatures drop, by what ``alike`` lets through."""
    s, n = percent / 100, near_dedup.BANDS * near_dedup.ROWS
    one = np.zeros(n, "<u2")
    sigs = [(np.arange(n) >= k).astype("<u2").tobytes() for k in range(n + 1)]  # k minima agree
    f = pd.DataFrame({"u": range(n + 1), "v": -1, "sig_u": sigs, "sig_v": one.tobytes()})
    (passed,) = near_dedup.alike(percent)(iter([f]))
    lost = set(range(n + 1)) - set(passed["u"])
    tail = sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in lost)
    assert 0 < tail < (1 - s**near_dedup.ROWS) ** near_dedup.BANDS


def test_near_large_group_in_blocks(spark, monkeypatch):
    """Variants of one text, most of them too far from the smallest: found block by block."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        new = list(words)
        for _ in range(rng.randrange(0, 7)):
            new[rng.randrange(len(new))] = f"x{rng.random()}"
        rows.append((i, " ".join(new)))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert shown_near(out) == Counter(expected_near(rows, 85))
    assert len({r.component_id for r in out}) > 1


# --- lines ------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expected_lines(rows, edits):
    lines = [(d, n, l) for d, t in rows if t is not None for n, l in enumerate(t.split("\n"))]
    distinct = sorted({l for _, _, l in lines})
    forest, degree = Forest(), Counter()
    for a, b in itertools.combinations([l for l in distinct if len(l) >= line_dedup.SHORTEST], 2):
        if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
            forest.join(a, b)
            degree[a] += 1
            degree[b] += 1
    first = {}
    for d, n, l in sorted(lines, key=lambda x: (x[0] is not None, x[0], x[1])):
        first.setdefault(forest.find(l), (d, n))
    return Counter((d, n, *first[forest.find(l)], degree[l]) for d, n, l in lines)


def line_rows():
    rng = random.Random(2)
    base = ["".join(rng.choice("abc é") for _ in range(rng.randrange(16, 40))) for _ in range(25)]
    rows = [(None, base[0]), (None, base[1] + "\n\n" + base[0]), (3, ""), (4, None), (5, "short\nshort\nshorx")]
    for i in range(10, 40):
        lines = []
        for _ in range(4):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(["", "z", "zz"])
            lines.append("".join(line))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_against_all_pairs(spark, edits):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x"))
    out = line_dedup.near_lines(df, edits).collect()
    got = Counter((r.doc_id, r.line_no, r.class_doc_id, r.class_line_no, r.n_links) for r in out)
    assert got == expected_lines(rows, edits)
    classes = {(r.class_doc_id, r.class_line_no) for r in out if r.class_doc_id is not None}
    assert sum(r.kept for r in out if r.class_doc_id is not None) == len(classes)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_short_lines_against_all_pairs(spark, edits):
    """Lines of 0 to 20 characters: no length is left out, nor a pair across the two methods."""
    rng = random.Random(edits)
    lines = ["", "a", "é", "ab", "xyz", "And ornd.", "And | ornd.", "😀a😀b", "😀ab"]
    for n in [*range(3, 21)] * 2:
        line = [rng.choice("abcdé ") for _ in range(n)]
        lines.append("".join(line))
        for _ in range(3):
            near = list(line)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(near) + 1)
                near[at : at + rng.randrange(2)] = rng.choice(["", "z", "zz"])
            lines.append("".join(near))
    distinct, links = sorted(set(lines)), Counter()
    for a, b in itertools.combinations(distinct, 2):
        if distance(a, b) <= edits:
            links[a] += 1
            links[b] += 1
    assert any(links[x] for x in distinct if 3 <= len(x) < 16)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    out = line_dedup.near_lines(df, edits).collect()
    assert {r.doc_id: r.n_links for r in out} == {i: links[x] for i, x in enumerate(lines)}


def test_lines_of_odd_texts(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    out = line_dedup.near_lines(odd).collect()
    assert len(out) == sum(t.count("\n") + 1 for _, t in rows if t is not None)
    assert line_dedup.near_lines(none).count() == 0


def test_dropped_lines(spark):
    keep = "a line that is long enough"
    df = spark.createDataFrame([(1, f"{keep}\nsecond"), (2, f"{keep}!\nthird"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    assert got == {1: f"{keep}\nsecond", 2: "third"}


def test_lines_that_share_only_a_segment_are_no_candidates(spark, monkeypatch):
    """Lines with the same start and end whose signs differ too much are told apart where they meet, and
    the copies of a line change nothing."""
    seen, trimmed = [], line_dedup.trimmed
    monkeypatch.setattr(line_dedup, "trimmed", lambda pairs, edits: seen.append(pairs.count()) or trimmed(pairs, edits))
    middles = [x * 3 for x in "bcdfghjklmpqrsuvwxyz"] + ["bbc"]
    lines = [f"the same start of them all {x} and the same end of them all" for x in middles] + ["y"]
    lines += lines[:1] * 30
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = {r.doc_id: (r.class_doc_id, r.n_links) for r in line_dedup.near_lines(df).collect()}
    want = {i: (i, 0) for i in range(22)} | {i: (0, 1) for i in range(22, 52)}
    assert out == want | {0: (0, 1), 1: (0, 1), 20: (0, 2)}
    assert seen == [2]


def test_lines_with_many_equal_signs(spark):
    line = "etaoinshrdlu" * 16
    df = spark.createDataFrame([(1, line), (2, "tt" + line[2:-1] + "d"), (3, "xx" + line)], "doc_id long, text string")
    assert [r.n_links for r in line_dedup.near_lines(df).orderBy("doc_id").collect()] == [2, 1, 1]
