"""Words and word shingles of whole batches of texts, hashed with NumPy instead of a loop over words.

A word is `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes after A-Z are lower-cased. Its hash is a polynomial
over random 64-bit codes of its bytes, taken from prefix sums over blocks of the batch and mixed at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from carecolumns.llm.common import arrow_offsets

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES[65:91] = _CODES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Multipliers that give the five words of a shingle their places.
_PLACES = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
SHINGLE = 5
#: Bytes whose prefix sums are held at once.
BLOCK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for words beyond 1 MB are not kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    steps = [np.full(n, base, np.uint64) for base in (_BASE, _INVERSE)]
    for x in steps:
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    if n <= 1 << 20:
        _powers[:] = steps
    return steps[0], steps[1]


class Words:
    """hash, doc, start and end (byte places in `data`) of every word of a batch; counts: words by text."""

    __slots__ = ("counts", "data", "doc", "end", "hash", "start")

    def __init__(self, texts: pa.Array):
        offsets = arrow_offsets(texts)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        n = len(raw)
        self.data = raw
        solid = np.zeros(n + 1, bool)
        np.logical_not(_SPACE[raw], out=solid[:n])
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begins = solid[:n].copy()
        begins[1:] &= ~solid[: n - 1] | first[1:n]
        ends = solid[:n].copy()
        ends &= ~solid[1:] | first[1:]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.hash = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            # the words of the next BLOCK bytes, or one longer word
            a = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, a + BLOCK, "right")))
            start, end = self.start[at:to] - a, self.end[at:to] - a
            size = int(end[-1])
            up, down = _power(size + 1)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_CODES[raw[a : a + size]] * up[:size], out=sums[1:])
            self.hash[at:to] = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _PLACES[1])
            at = to

    def bytes(self, i: int) -> bytes:
        return _LOWER[self.data[self.start[i] : self.end[i]]].tobytes()


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: five words each, or all words where there are fewer."""
    w = Words(texts)
    h, out = w.hash, []
    five = np.zeros(0, np.uint64)
    if len(h) >= SHINGLE:
        five = h[: -SHINGLE + 1] * _PLACES[0]
        for k in range(1, SHINGLE):
            five = five + (h[k : len(h) - SHINGLE + 1 + k] ^ _PLACES[k]) * _PLACES[k]
        five = mix(five)
    at = 0
    for n in w.counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(five[at : at + n - SHINGLE + 1]))
        elif n:
            x = U(n)
            with np.errstate(over="ignore"):
                for y in h[at : at + n]:
                    x = (x * _PLACES[3]) ^ (y * _PLACES[4])
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
