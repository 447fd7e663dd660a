"""Suffix dedup, whitening and fill-in-middle against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffspark.llm import fill_middle, suffix_dedup, whitening

# --- suffix dedup -----------------------------------------------------------------------


def expected_removal(rows):
    """Brute force over all strings of 100 bytes; rows in order."""
    seen, out = set(), []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        spans = len(re.findall(b"\x01+", gone.astype(np.uint8).tobytes()))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_removal(df):
    rows = sorted(
        df.select("doc_id", "text", F.monotonically_increasing_id()).collect(),
        key=lambda r: (r[0] is not None, r[0] or 0, r[2]),
    )
    got = suffix_dedup.remove_repeats(df)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    key = lambda r: (r[0] is not None, *(x if x is not None else -1 for x in r))
    got = sorted((tuple(r) for r in got.collect()), key=key)
    want = sorted(expected_removal([r[:2] for r in rows]), key=key)
    assert got == want
    return want


def repetitive(seed):
    """Few blocks, pasted, cut and edited; runs of one sign; two-byte characters at the edges."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(1, 9))) for _ in range(60)]
    blocks = [" ".join(r.choice(words) for _ in range(r.randint(10, 80))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 5)):
            b = r.choice(blocks)
            kind = r.random()
            if kind < 0.3:
                at = r.randrange(len(b))
                b = b[:at] + "X" + b[at + 1 :]
            elif kind < 0.5:
                b = b[r.randrange(len(b)) :]
            elif kind < 0.6:
                b = r.choice(["z", "ab"]) * r.randint(1, 300)
            parts.append(b)
        docs.append("".join(parts))
    ids = r.sample(range(-50, 50), len(docs))
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_are_removed(spark, seed):
    rows = repetitive(seed)
    want = check_removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sum(r[2] for r in want) > 1000


def test_repeats_of_given_documents(spark, docs):
    assert sum(r[2] > 0 for r in check_removal(docs)) > 10


def test_repeats_odd_cases(odd, none):
    check_removal(odd)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeats_one_hot_text(spark):
    """Many copies of one text, and many texts around one passage."""
    passage = " ".join(f"w{k * k}" for k in range(60))
    rows = [(i, passage if i % 2 else f"{i * 7919} before {passage} after {i * 104729} it") for i in range(400)]
    check_removal(spark.createDataFrame(rows, "doc_id long, text string"))


def test_repeats_of_long_texts(spark, monkeypatch):
    """Documents longer than the pieces that are parsed at a time."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    test_repeats_across_chunks()
    for _, text in repetitive(6):
        raw = np.frombuffer(text.encode(), np.uint8)
        bounds = np.array([0, len(raw)])
        pieces = suffix_dedup.parse(raw, bounds)
        with monkeypatch.context() as whole:
            whole.setattr(suffix_dedup, "CHUNK", 1 << 19)
            for a, b in zip(pieces, suffix_dedup.parse(raw, bounds), strict=True):
                assert (a == b).all()
    rows = [(k, t) for k, (_, t) in enumerate(repetitive(7))]
    check_removal(spark.createDataFrame(rows, "doc_id long, text string"))


def test_repeats_across_chunks():
    """Parses that are cut at other places name the same strings."""
    texts = [t.encode() for _, t in repetitive(5)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    whole = suffix_dedup.parse(raw, bounds)
    for i in range(len(texts)):
        one = suffix_dedup.parse(raw[bounds[i] : bounds[i + 1]], np.array([0, len(texts[i])]))
        mine = whole.doc == i
        assert (whole.anchor[mine] - bounds[i] == one.anchor).all()
        assert (whole.entry[mine] == one.entry).all() and (whole.context[mine] == one.context).all()


# --- whitening ----------------------------------------------------------------------------


def integer_vectors(rows):
    width = max((len(v) for _, v in rows if v), default=0)
    out = []
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            v = list(v) + [0.0] * (width - len(v))
            out.append((i, [int(np.floor(64 * float(np.float64(c)))) + 1_000_000 for c in v]))
    return out


def check_whitening(df, id_col, vector_col, components):
    x = integer_vectors(df.select(id_col, vector_col).collect())
    got = whitening.whiten(df, id_col, vector_col, components).collect()
    distinct = np.array(sorted({tuple(v) for _, v in x}), float)
    n = len(distinct)
    mean = distinct.mean(axis=0)
    v = (distinct - mean).T @ (distinct - mean) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-12 * e.sum()).sum()))
    assert len(got) == k * len(x)
    totals = [sum(int(r[j]) for r in distinct) for j in range(distinct.shape[1])]
    by_vector = {}
    for i, row in x:
        by_vector.setdefault(i, []).append(row)
    white = {c: [] for c in range(1, k + 1)}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-8
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
        rows = by_vector[r.vec_id]
        assert r.deviation in {sum((n * a - s) ** 2 for a, s in zip(row, totals, strict=True)) for row in rows}
        white[r.component].append((r.whitened, rows))
    for c, pairs in white.items():
        single = [(w, rows[0]) for w, rows in pairs if len(rows) == 1]
        mine = np.array([w for w, _ in single])
        want = (np.array([row for _, row in single]) - mean) @ q[:, c - 1] / np.sqrt(e[c - 1])
        sign = np.sign(mine @ want)
        assert np.allclose(mine, sign * want, atol=1e-6), c


def test_whitening_of_given_vectors(spark, small):
    check_whitening(spark.read.parquet(f"{small}/embeddings.parquet"), "vec_id", "embedding", 16)


def test_whitening_odd_cases(spark):
    rows = [(i, [float(i % 7), float(i * i % 11), 2.0]) for i in range(30)]
    rows += [(30, None), (31, [None, 1.0, 1.0]), (32, [float("nan"), 1.0, 1.0]), (33, [float("inf"), 1.0, 1.0])]
    rows += [(3, [3.0, 9.0, 2.0]), (34, [5.0]), (35, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("x", F.lit("x"))
    check_whitening(df.repartition(3), "id", "v", 16)
    assert whitening.whiten(df.where("id = 30"), "id", "v", 16).count() == 0
    assert whitening.whiten(df.where("id = 0"), "id", "v", 16).count() == 0
    huge = spark.createDataFrame([(1, [1e300]), (2, [1.0]), (3, [2.0])], "id long, v array<double>")
    assert {r.vec_id for r in whitening.whiten(huge, "id", "v", 4).collect()} == {2, 3}
    far = spark.createDataFrame([(i, [i * 1e14]) for i in range(9)], "id long, v array<double>")
    assert {r.deviation for r in whitening.whiten(far, "id", "v", 4).collect()} <= {None, 0}


def test_spectrum_slices():
    r = np.random.default_rng(0)
    for case in range(40):
        d = int(r.integers(1, 30))
        a = r.standard_normal((50, d)) * (10.0 ** -r.integers(0, 6, d) if case % 2 else 1.0)
        v = a.T @ a
        if case % 5 == 0:  # repeated eigenvalues
            q = np.linalg.qr(r.standard_normal((d, d)))[0]
            v = q @ np.diag(r.integers(0, 3, d).astype(float)) @ q.T
        v = (v + v.T) / 2
        e = np.linalg.eigvalsh(v)[::-1]
        k = min(8, int((e > 1e-12 * np.trace(v)).sum()))
        values, vectors = whitening.leading(v, 8)
        assert np.allclose(values, e[:k], rtol=1e-9, atol=1e-13 * np.trace(v))
        assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-9)
        assert np.allclose(vectors @ v, values[:, None] * vectors, atol=1e-12 * max(1.0, np.trace(v)))
        shift = float(r.normal())
        assert whitening.below(v, shift) == (e < shift).sum()


# --- fill-in-middle -----------------------------------------------------------------------


def expected_middle(doc_id, text, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not n or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (0, 100)])
def test_middle_and_back(spark, odd, docs, none, rate, spm):
    marked = [(70, "a<P>b\nc"), (71, "<\n<S"), (72, "\n\n\n"), (73, "x\r\ny z"), (74, "M>\n<\nP>")]
    more = spark.createDataFrame(marked, "doc_id long, text string")
    for df in (odd, docs, more):
        out = fill_middle.fill_in_middle(df, rate=rate, spm=spm)
        back = fill_middle.restore(out).collect()
        key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
        got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=key)
        want = [(i, *expected_middle(i, t, rate, spm)) for i, t in df.select("doc_id", "text").collect()]
        assert got == sorted(want, key=key)
        assert sorted(r.restored for r in back) == sorted(r.text or "" for r in df.collect())
    assert fill_middle.restore(fill_middle.fill_in_middle(none)).count() == 0


def test_rotation_in_small_steps(monkeypatch):
    monkeypatch.setattr(fill_middle, "STEP", 3)
    r = random.Random(4)
    for _ in range(500):
        data = bytes(r.randrange(256) for _ in range(r.randint(0, 30)))
        i, m, j = sorted(r.randint(0, len(data)) for _ in range(3))
        buffer = bytearray(data)
        fill_middle.rotate(buffer, i, m, j)
        assert buffer == data[:i] + data[m:j] + data[i:m] + data[j:]
