"""The classifier and the whole pipeline recomputed in plain Python."""

import math
import re
import struct
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from diffspark.llm import byte_bpe, packing, quality, words
from tests.llm.test_dedup import expected_near

MASK = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def hashed(word):
    total = sum(int(words.BYTE[b]) * pow(int(words.STEP), i, 1 << 64) for i, b in enumerate(word))
    return mix((total + len(word)) & MASK)


def pairs(x, seed):
    out = []
    for a, b in zip(x, x[1:], strict=False):
        a, b = (0, seed) if a == b else (a, b)
        out.append(mix((3 * a + b + seed) & MASK))
    return out


def shape(text):
    """Bytes of a text by class, runs of letters or digits once."""
    out = bytearray()
    for b in text:
        kind = 97 if b >= 128 or 97 <= b < 123 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b
        if not (out and kind in (48, 65, 97) and last == kind):
            out.append(kind)
        last = kind
    return bytes(out)


def features(text):
    raw = (text or "").encode()
    split = lambda t: [w for w in re.split(b"[ \t-\r]+", t) if w]
    w = [hashed(x.lower()) for x in split(raw)]
    s = [hashed(x.lower()) for x in split(shape(raw))]
    whole = w + pairs(w, 5) + [mix((x + 7) & MASK) for x in s] + pairs(s, 9)
    return [x % quality.BUCKETS for x in whole]


def xxhash64(doc_id, more=b""):
    h = xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()
    return xxhash.xxh64(more, seed=h).intdigest() if more else h


def expected_quality(rows, labels):
    """Per document: features, log weight, and whether it is in the top k."""
    marks = {}
    for doc_id, good in labels:
        marks[doc_id] = min(marks.get(doc_id, 1), good)
    found = [features(t) for _, t in rows]
    raw, target = Counter(range(quality.BUCKETS)), Counter()
    for (i, _), f in zip(rows, found, strict=True):
        raw.update(f)
        if marks.get(i) and xxhash64(i) % 2 == 0:
            target.update(f)
    total, seen = sum(raw.values()), sum(target.values())
    ratio = []
    for b in range(quality.BUCKETS):
        share = raw[b] / total
        ratio.append(math.log((target[b] + quality.SMOOTH * share) / (seen + quality.SMOOTH)) - math.log(share))
    weights = [math.fsum(ratio[b] for b in f) for f in found]
    good, bad = [], []
    for (i, _), w in zip(rows, weights, strict=True):
        if i in marks and xxhash64(i) % 2:
            (good if marks[i] else bad).append(w)
    both = sorted({*good, *bad})
    cuts = [both[0] - 1, *((a + b) / 2 for a, b in zip(both, both[1:], strict=False))]
    cost = [
        quality.KEEP_COST * sum(g < c for g in good) / len(good) + sum(b >= c for b in bad) / len(bad) for c in cuts
    ]
    least = cuts[min(range(len(cuts)), key=lambda k: (cost[k], k))]
    k = sum(w >= least for w in weights)
    keys = []
    for n, ((i, _), w) in enumerate(zip(rows, weights, strict=True)):
        u = (xxhash64(i, b"gumbel") % (1 << 52) + 0.5) / (1 << 52)
        keys.append((-(w - math.log(-math.log(u))), n))
    kept = {n for _, n in sorted(keys)[:k]}
    return [(i, len(f), w, n in kept) for n, ((i, _), f, w) in enumerate(zip(rows, found, weights, strict=True))]


@pytest.fixture(scope="module")
def labels(spark, small):
    rows = spark.read.parquet(f"{small}/labels.parquet").where("doc_id is not null and quality is not null")
    return [(r.doc_id, r.quality) for r in rows.collect()]


def test_quality_recomputed(spark, docs, plain, small, labels):
    want = {r[0]: r[1:] for r in expected_quality(plain, labels)}
    assert len(want) == len(plain)
    got = quality.scores(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()
    assert len(got) == len(plain)
    for r in got:
        n, weight, kept = want[r.doc_id]
        assert (r.n_features, r.kept) == (n, kept)
        assert r.log_weight == pytest.approx(weight, rel=1e-9, abs=1e-7)
    assert 0 < sum(r.kept for r in got) < len(got)


def test_pipeline_recomputed(spark, small, plain, labels):
    """Every stage on what the one before has kept, and every id of a kept text in one place."""
    good = [r[0] for r in expected_quality(plain, labels) if r[3]]
    text = dict(plain)
    last = {}
    for i in good:
        last[text[i] or ""] = max(i, last.get(text[i] or "", i))
    single = [(i, text[i]) for i in good if last[text[i] or ""] == i]
    kept = [i for i, n, least in expected_near(single, 80) if i == least or not n]
    assert len(kept) < len(single) < len(good) < len(plain)
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == set(kept)
    encode = Tokenizer.from_file(public_tokenizers.path(byte_bpe.FILE)).encode
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    for i in kept:
        n = len(encode(text[i] or "", add_special_tokens=False).ids) + 1
        at = 0
        for start, length, tokens in sorted(pieces[i]):
            assert (start, tokens) == (at, n)
            at += length
        assert at == n
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, small, tmp_path):
    marks = spark.read.parquet(f"{small}/labels.parquet")
    for name, docs in (("odd", odd), ("none", none)):
        root = str(tmp_path / name)
        docs.write.parquet(f"{root}/documents.parquet")
        marks.write.parquet(f"{root}/labels.parquet")
        marks.where("false").write.parquet(f"{root}-unlabelled/labels.parquet")
        docs.write.parquet(f"{root}-unlabelled/documents.parquet")
        for folder in (root, f"{root}-unlabelled"):
            df = spark.read.parquet(f"{folder}/documents.parquet")
            for _, stage in corpus_pipeline.STAGES[:-1]:
                df = stage(spark, df, folder)
                assert df.columns == odd.columns
        out = corpus_pipeline.run(spark, f"{root}-unlabelled").collect()
        texts = {r.text or "" for r in docs.collect()}
        assert (len(out) > 0) == (name == "odd")
        assert sum(r.length for r in out if r.start == 0 and r.doc_tokens == 1) <= len(texts)
        assert len({(r.doc_id, r.start, r.ids_crc32) for r in out}) == len(out)
