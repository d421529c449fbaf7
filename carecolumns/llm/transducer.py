"""Minimal acyclic transducers: a sorted list of distinct byte strings to their places in it.

Built term by term from the sorted list: states that no later term can change are merged with equal ones at once, so that memory follows the minimal automaton. Every
state knows how many terms end behind it; an arc's output is the number of terms that stand before those through it. A walk from the start sums outputs, and the
sum at a final state is the term's ordinal. The automaton is a few flat arrays; whole batches of texts walk through it side by side, a byte a step.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np


class Transducer:
    """bits, first: for each state and each quarter of the byte values, a bit a byte that has an arc, and the place of its first arc; to, output: by arc; final: by state."""

    PARTS = ("bits", "first", "to", "output", "final")

    def __init__(self, bits, first, to, output, final, start: int, size: int):
        self.bits, self.first, self.to, self.output, self.final, self.start, self.size = bits, first, to, output, final, start, size

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> "Transducer":
        """From distinct terms in byte order, read once."""
        register: dict[tuple, int] = {}
        arcs: list[tuple[tuple[int, int], ...]] = []  # of each finished state: (byte, state)
        finals: list[bool] = []
        #: The states along the last term, not yet finished: [final, arcs so far].
        path: list[list] = [[False, []]]
        last, size = b"", 0

        def finish(depth: int) -> None:
            while len(path) > depth:
                final, out = path.pop()
                key = (final, tuple(out))
                at = register.get(key)
                if at is None:
                    at = register[key] = len(arcs)
                    arcs.append(key[1])
                    finals.append(final)
                if path:
                    path[-1][1].append((last[len(path) - 1], at))

        for t in terms:
            if size and t <= last:
                raise ValueError("terms must be distinct and in byte order")
            k, most = 0, min(len(t), len(last))
            while k < most and t[k] == last[k]:
                k += 1
            finish(k + 1)
            path += [[False, []] for _ in range(len(t) - k)]
            path[-1][0] = True
            last, size = t, size + 1
        finish(0)
        states = len(arcs)
        count, many = [0] * states, sum(map(len, arcs))
        bits, first = np.zeros(4 * states, np.uint64), np.zeros(4 * states, np.int32)
        to, output = np.zeros(many, np.int32), np.zeros(many, np.int32)
        at = 0
        for s, own in enumerate(arcs):  # a state's arcs lead to states finished before it
            before, quarter = int(finals[s]), 0
            for b, next_state in own:
                while quarter <= b >> 6:
                    first[4 * s + quarter] = at
                    quarter += 1
                bits[4 * s + (b >> 6)] |= np.uint64(1 << (b & 63))
                to[at], output[at] = next_state, before
                before += count[next_state]
                at += 1
            first[4 * s + quarter : 4 * s + 4] = at
            count[s] = before
        return cls(bits, first, to, output, np.array(finals, bool), states - 1, size)

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, start=self.start, size=self.size, **{k: getattr(self, k) for k in self.PARTS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> "Transducer":
        with np.load(io.BytesIO(raw)) as f:
            return cls(*[f[k] for k in cls.PARTS], int(f["start"]), int(f["size"]))

    def ordinals(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The ordinal of each term data[begin:end] (bytes), -1 for those that are not in the list. All walk side by side."""
        out = np.full(len(begin), -1, np.int64)
        who, at, stop = np.arange(len(begin)), begin.astype(np.int64), end
        state, total = np.full(len(begin), self.start, np.int64), np.zeros(len(begin), np.int64)
        while len(who):
            over = at == stop
            if over.any():
                hit = np.flatnonzero(over)
                hit = hit[self.final[state[hit]]]
                out[who[hit]] = total[hit]
                go = np.flatnonzero(~over)
                who, at, stop, state, total = who[go], at[go], stop[go], state[go], total[go]
            byte = data[at].astype(np.int64)
            place, bit = 4 * state + (byte >> 6), np.uint64(1) << (byte & 63).astype(np.uint64)
            own = self.bits[place]
            go = np.flatnonzero(own & bit)
            who, at, stop, total = who[go], at[go] + 1, stop[go], total[go]
            arc = self.first[place[go]] + np.bitwise_count(own[go] & (bit[go] - np.uint64(1)))
            state, total = self.to[arc].astype(np.int64), total + self.output[arc]
        return out
