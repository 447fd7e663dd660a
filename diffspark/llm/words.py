"""Words, hashed words and hashed shingles of many texts at once, with numpy.

A word is a run of bytes other than space and tab to carriage return, with A-Z in lower
case. Its hash is a 64-bit polynomial of random byte values, finished by a mixing step;
two different words of a corpus with n distinct ones share a hash with probability of about
n**2 / 2**65.
"""

from __future__ import annotations

import numpy as np

from diffspark.llm.common import ship

ship(__name__)

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finisher over 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def series(n: int, start: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(start))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE = series(256, 7)
BYTE[65:91] = BYTE[97:123]
STEP = U(0xD6E8FEB86659FD93)
WINDOW = 1 << 20


def buffer(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Texts (str or None) as one array of bytes, each closed by a line end, and where each
    starts (one more entry than texts)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n" if parts else b"", np.uint8), at


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words."""
    solid = ~SPACE[raw]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(raw) and solid[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def hash_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words start."""
    raw, at = buffer(texts)
    out, start = hash_runs(raw)
    return out, np.searchsorted(start, at)


def hash_runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer, and where each starts."""
    start, end = spans(raw)
    length = end - start
    upto = np.cumsum(length)
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):  # so many words at a time that the temporary arrays stay small
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + WINDOW, "right")))
        out[i:j] = _hash(raw, start[i:j], length[i:j])
        i = j
    return out, start


def _hash(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        power = np.full(int(length.max()), STEP, U)
        power[0] = 1
        np.cumprod(power, out=power)
        value = BYTE[raw[np.repeat(start, length) + place]] * power[place]
        return mix(np.add.reduceat(value, first) + length.astype(U))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, sorted and distinct; a shorter sequence is one
    shingle; no words give none."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    weight = series(width, 1000 + width) | U(1)
    with np.errstate(over="ignore"):
        total = words[: n - width + 1] * weight[0]
        for k in range(1, width):
            total = total + words[k : n - width + 1 + k] * weight[k]
    return np.unique(mix(total))
