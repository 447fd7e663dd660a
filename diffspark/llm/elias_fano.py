"""Elias-Fano sequences and the n-gram trie made of them, with numpy.

A sequence of n non-decreasing 64-bit values is kept as low bits in a packed array and
high bits in unary; ``access`` selects the i-th set bit, ``successor`` selects zeros to find the few
values that share the high bits of what is looked for. All calls take and give arrays.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

from diffspark.llm.common import ship

ship(__name__)

U = np.uint64
ONES = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)
#: Place of the r-th set bit of a byte (least significant first).
NTH = np.zeros((256, 8), np.int64)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    NTH[_b, : len(_at)] = _at
SUCCESSOR_BITS = 40
STEPS = 4096.0  # codes per factor of ten of a probability
UNKNOWN = 0xFFFF


def _select(packed: np.ndarray, before: np.ndarray, k: np.ndarray, zeros: bool) -> np.ndarray:
    """Place of the k-th one (or zero) of a bit vector of whole 64-bit words."""
    word = np.searchsorted(before, k, "right") - 1
    rest, place = k - before[word], word * 64
    done = np.zeros(len(k), bool)
    for i in range(8):
        byte = packed[word * 8 + i]
        if zeros:
            byte = ~byte
        n = ONES[byte]
        here = ~done & (rest < n)
        place[here] += 8 * i + NTH[byte[here], rest[here]]
        done |= here
        rest = np.where(done, rest, rest - n)
    return place


class EliasFano:
    """``parts`` are plain arrays, so that a sequence can be written and mapped again."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones)) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, values = len(values), values.astype(U)
        top = int(values[-1]) + 1 if n else 1
        low_bits = min(63, max(0, (top // max(n, 1)).bit_length() - 1))
        high = (values >> U(low_bits)).astype(np.int64)
        size = -(-(n + (int(high[-1]) if n else 0) + 2) // 64) * 64
        bits = np.zeros(size, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        per_word = np.bitwise_count(packed.view(U)).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(per_word)[:-1]])
        width = -(-low_bits // 8)  # low bits in whole bytes
        low = (values & U((1 << low_bits) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        return cls(n, low_bits, np.ascontiguousarray(low), packed, ones)

    def _low(self, at: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(at), 8), np.uint8)
        wide[:, : self.low.shape[1]] = self.low[at]
        return wide.view("<u8").ravel()

    def access(self, at: np.ndarray) -> np.ndarray:
        high = _select(self.high, self.ones, at, zeros=False) - at
        return high.astype(U) << U(self.low_bits) | self._low(at)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not less than x, n if there is none."""
        out = np.full(len(x), self.n)
        if self.n == 0 or len(x) == 0:
            return out
        high = (x >> U(self.low_bits)).astype(np.int64)
        most = int(self.access(np.array([self.n - 1]))[0] >> U(self.low_bits))
        live = np.flatnonzero(high <= most)
        high = high[live]
        # values with high part h stand between the (h - 1)-th and the h-th zero
        first = np.where(high > 0, _select(self.high, self.zeros, np.maximum(high - 1, 0), zeros=True) - high + 1, 0)
        end = _select(self.high, self.zeros, high, zeros=True) - high
        low = x[live] & U((1 << self.low_bits) - 1)
        at = first.copy()
        go = np.flatnonzero(at < end)
        while len(go):
            go = go[self._low(at[go]) < low[go]]
            at[go] += 1
            go = go[at[go] < end[go]]
        out[live] = at
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of x, -1 where it is not in the sequence."""
        at = self.successor(x)
        some = np.flatnonzero(at < self.n)
        hit = some[self.access(at[some]) == x[some]]
        out = np.full(len(x), -1)
        out[hit] = at[hit]
        return out

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]


def code(probability: np.ndarray) -> np.ndarray:
    """Logarithm in steps of 1 / STEPS of a factor of ten."""
    return np.minimum(np.rint(-np.log10(probability) * STEPS), UNKNOWN - 1).astype("<u2")


def value(codes: np.ndarray) -> np.ndarray:
    """Probability of a code; 0 for UNKNOWN."""
    return np.where(codes == UNKNOWN, 0.0, 10.0 ** (-codes.astype(float) / STEPS))


class Trie:
    """Contexts and their successors. A successor is named by a code of SUCCESSOR_BITS bits
    that is relative to its context; the codes of all contexts make one monotone sequence,
    as each is put after the number of its context. ``starts`` points to each context's
    first successor. ``share`` holds the coded part of the probability that comes from
    the successor's count, ``backoff`` the coded weight of the lower order."""

    def __init__(self, contexts: EliasFano, starts: EliasFano, successors: EliasFano, share, backoff):
        self.contexts, self.starts, self.successors = contexts, starts, successors
        self.share, self.backoff = share, backoff

    @classmethod
    def of(cls, contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray, share, backoff) -> Trie:
        """Sorted contexts, how many successors each has, and their sorted codes."""
        if len(contexts) >> (64 - SUCCESSOR_BITS):
            raise ValueError("too many contexts in one shard: use more shuffle partitions")
        owner = np.repeat(np.arange(len(contexts), dtype=U), sizes)
        return cls(
            EliasFano.of(contexts),
            EliasFano.of(np.concatenate([[0], np.cumsum(sizes)])),
            EliasFano.of(owner << U(SUCCESSOR_BITS) | successors),
            code(share),
            code(backoff),
        )

    def look_up(self, contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray) -> tuple:
        """Codes of the shares of all asked successors, and of the contexts' backoffs."""
        node = self.contexts.find(contexts)
        known = node >= 0
        backoff = np.full(len(contexts), UNKNOWN, "<u2")
        backoff[known] = self.backoff[node[known]]
        first, end = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        first[known] = self.starts.access(node[known])
        end[known] = self.starts.access(node[known] + 1)
        owner = np.repeat(node, sizes)
        asked = np.flatnonzero(owner >= 0)
        at = self.successors.find(owner[asked].astype(U) << U(SUCCESSOR_BITS) | successors[asked])
        inside = (at >= np.repeat(first, sizes)[asked]) & (at < np.repeat(end, sizes)[asked])
        share = np.full(len(successors), UNKNOWN, "<u2")
        share[asked[inside]] = self.share[at[inside]]
        return share, backoff

    def mapped(self, folder: str | None = None) -> Trie:
        """The same trie with its levels in one file that is mapped, not read. The file
        has no name any more, so it goes with the trie."""
        levels = [self.contexts, self.starts, self.successors]
        arrays = [p for s in levels for p in s.parts()] + [self.share, self.backoff]
        with tempfile.TemporaryFile(dir=folder) as f:
            places = []
            for a in arrays:
                f.seek(-f.tell() % 8, os.SEEK_CUR)
                places.append(f.tell())
                f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * 8)
            f.flush()
            whole = np.memmap(f, np.uint8, "r")
            views = [
                whole[p : p + a.nbytes].view(a.dtype).reshape(a.shape) for p, a in zip(places, arrays, strict=True)
            ]
        new = [EliasFano(s.n, s.low_bits, *views[3 * i : 3 * i + 3]) for i, s in enumerate(levels)]
        return Trie(*new, *views[9:])
