"""Encoding, packing and counting against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from diffspark.llm import byte_bpe, packing, token_counts, word_bpe
from tests.llm.conftest import texts

BYTE, WORD = (public_tokenizers.path(m.FILE) for m in (byte_bpe, word_bpe))


def noise(n, seed):
    rng = random.Random(seed)
    signs = "ab cΣς'sSLl<|>1½é́ͅ \t\n\x1c\x85​!?İǅ🤷"
    return ["".join(rng.choice(signs) for _ in range(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def samples(plain):
    return [t for _, t in texts()] + noise(300, 1) + ["<|startoftext|>A<|endoftext|>b", "<|"] + [t for _, t in plain[:60]]


def test_byte_ids(samples):
    want = Tokenizer.from_file(BYTE).encode_batch([t or "" for t in samples], add_special_tokens=False)
    assert [byte_bpe.ids(t, BYTE).tolist() for t in samples] == [e.ids for e in want]


def test_word_ids_and_decoding(samples):
    library = Tokenizer.from_file(WORD)
    want = library.encode_batch([t or "" for t in samples], add_special_tokens=False)
    got = list(word_bpe.Vocabulary(WORD).encode(samples))
    for e, (n, ids, text) in zip(want, got, strict=True):
        assert (n, ids) == (len(e.ids), " ".join(map(str, e.ids)))
        assert text == library.decode(e.ids, skip_special_tokens=False)


def test_word_query_columns(odd, none):
    out = word_bpe.digests(odd, WORD).collect()
    library = Tokenizer.from_file(WORD)
    want = []
    for doc, text in odd.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((doc, len(ids), *sha))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert word_bpe.digests(none, WORD).count() == 0
    full = word_bpe.encode(odd, WORD).collect()
    assert sorted(len(r.ids) for r in full) == sorted(w[1] for w in want)


def test_dictionary_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE", 50)
    v, whole = word_bpe.Vocabulary(WORD), word_bpe.vocabulary(WORD)
    some = [t for _, t in plain[:20]]
    assert [list(v.encode([t]))[0] for t in some] == list(whole.encode(some))


# --- packing ----------------------------------------------------------------------------------


def check_packing(rows, docs, window):
    library = Tokenizer.from_file(BYTE)
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in docs]
    want, got = defaultdict(list), defaultdict(list)
    for (doc, _), tokens in zip(docs, ids, strict=True):
        for at in range(0, len(tokens), window):
            piece = tokens[at : at + window]
            want[doc].append((at, len(piece), zlib.crc32(piece.tobytes()), len(tokens)))
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(map(len, ids)) / (len(sequences) * window)


@pytest.mark.parametrize("window", [64, 2048])
def test_packing(docs, plain, window):
    fill = check_packing(packing.pack(docs, BYTE, window).collect(), plain, window)
    assert fill > 0.98


def test_packing_odd_cases(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    out = packing.pack(odd, BYTE, 128, with_ids=True).collect()
    check_packing(out, rows, 128)
    assert all(len(r.ids) == r.length for r in out)
    assert packing.pack(none, BYTE).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_fill_is_best(seed):
    rng = random.Random(seed)
    counts = {n: rng.randrange(1, 4) for n in rng.sample(range(2, 30), 6)}
    free = rng.randrange(1, 60)
    taken = packing.fill(counts, free)
    sums = {0}
    for n, c in counts.items():
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= free}
    assert sum(n * k for n, k in taken.items()) == max(sums)
    assert all(k <= counts[n] for n, k in taken.items())
    patterns = packing.plan(counts, 64)
    used = defaultdict(int)
    for times, lengths in patterns:
        assert sum(n * k for n, k in lengths.items()) <= 64
        for n, k in lengths.items():
            used[n] += k * times
    assert dict(used) == counts


# --- edit-aware counts --------------------------------------------------------------------------


@pytest.mark.parametrize("leaf", [1, 2, 8])
def test_tree_follows_edits(monkeypatch, leaf):
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    rng = random.Random(leaf)
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    signs = "ab  '\n\tsll1.é,<|endoftext|>"
    for _ in range(60):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(80)))
        tree = token_counts.TokenTree(text, token_counts.counts(BYTE))
        for _ in range(10):
            start, length = rng.randrange(len(text) + 3), rng.choice([0, 0, 1, 2, 5, 30])
            new = "".join(rng.choice(signs) for _ in range(rng.choice([0, 0, 1, 2, 6, 20])))
            tree.edit(start, length, new)
            start = min(start, len(text))
            text = text[:start] + new + text[start + length :]
            assert tree.text() == text
            assert tree.total == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_of_documents(docs, plain, odd, none):
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True

    def count(text):
        return len(library.encode(text or "", add_special_tokens=False).ids)

    for df, rows in ((docs, plain), (odd, texts())):
        out = token_counts.follow(df, token_counts.removals, BYTE).collect()
        want = []
        for doc, text in rows:
            edits, new = list(token_counts.removals(text or "")), text or ""
            for start, length, put in edits:
                new = new[:start] + put + new[start + length :]
            want.append((doc, count(text), len(edits), count(new)))
        assert sorted(map(str, ((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_edited) for r in out))) == sorted(map(str, want))
        if df is docs:
            assert sum(r.n_edits for r in out) > 0
    assert token_counts.follow(none, token_counts.removals, BYTE).count() == 0


def test_kept_trees_take_batches_of_edits(spark, docs, plain, odd, none, tmp_path):
    """Two batches of insertions, deletions and replacements on stored trees."""
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    rng = random.Random(12)
    trees = token_counts.plant(docs, BYTE)
    trees.write.parquet(str(tmp_path / "0"))
    now = {i: t or "" for i, t in plain}
    long = sorted(now, key=lambda i: -len(now[i]))[:5]
    pieces = {r.doc_id: len(r.pieces) for r in trees.collect()}
    for batch in (1, 2):
        rows = []
        for i in sorted({*rng.sample(sorted(now), 60), *long}):
            for seq in range(rng.randint(1, 4)):
                at = rng.randrange(len(now[i]) + 1)
                length, new = rng.choice([(0, " more words'll"), (7, ""), (3, "x\n 12é")])
                rows.append((i, seq, at, length, new))
                now[i] = now[i][:at] + new + now[i][at + length :]
        rows.sort(key=lambda r: rng.random())  # the table has no order
        edits = spark.createDataFrame(
            [*rows, (None, 0, 0, 1, "n"), (-7, 0, 0, 1, "n")], "doc_id long, seq int, start int, length int, new string"
        )
        out = token_counts.edit(spark.read.parquet(str(tmp_path / str(batch - 1))), edits, BYTE)
        out.write.parquet(str(tmp_path / str(batch)))
        got = spark.read.parquet(str(tmp_path / str(batch))).collect()
        assert len(got) == len(plain)
        for r in got:
            assert "".join(r.pieces) == now[r.doc_id]
            assert r.n_tokens == len(library.encode(now[r.doc_id], add_special_tokens=False).ids)
            assert r.n_edits == sum(x[0] == r.doc_id for x in rows)
            assert sum(r.sizes) == len(r.pieces) and sum(r.tokens) == r.n_tokens
            if r.doc_id in long:
                assert 0 < r.n_recounted < pieces[r.doc_id] / 4
    assert token_counts.edit(token_counts.plant(none, BYTE), edits, BYTE).count() == 0
    odd_trees = token_counts.edit(token_counts.plant(odd, BYTE), edits.where("doc_id = -7"), BYTE).collect()
    assert sorted("".join(r.pieces) for r in odd_trees) == sorted(r.text or "" for r in odd.collect())
