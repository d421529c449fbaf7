"""Byte-pair encoding and decoding of whole texts: speculate and verify.

A text is cut at white space into chunks, which the public pre-tokenizer never crosses; chunks and their words are encoded once per Python worker and kept.
A new word is split greedily into the longest tokens, those of a batch side by side, a byte a round; the split is right exactly if
every token is what its own bytes encode to and every adjacent pair is what the pair's bytes encode to. Adjacent pairs of all new words of a batch
are checked together against a sorted table of pairs known to hold; a pair that is met first is decided by merging its bytes. Only words with
a failing pair are merged exactly, those of a batch side by side, a merge of each a round. Ids and texts equal those of the tokenizers library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecolumns.llm.common import batch, kept_for, small_batches

#: Bytes of encoded chunks (by a rule of thumb for Python objects) and decided pairs that a worker keeps before it starts anew.
KEPT_BYTES, KEPT_PAIRS = 50_000_000, 400_000
#: Symbols up to which merging scans the word for its best pair; longer words use a heap.
SHORT = 48
#: The rank of pairs that do not merge.
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next letter from U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 0
    for b in range(256):
        if b in prints:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return letters


def _classes() -> tuple[str, str, str]:
    """Character classes for `re` of letters, numbers and white space, from the Unicode properties that the pre-tokenizer names."""
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))

    def ranges(property: str) -> str:
        out = []
        for m in regex.finditer(property, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out += [(a, b)] if not a < 0xD800 <= b else [(a, 0xD7FF), (0xE000, b)]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    return ranges(r"\p{L}+"), ranges(r"\p{N}+"), ranges(r"\p{White_Space}+")


def codec_of(path: str) -> "Codec":
    """One codec a Python worker, whatever the number of its tasks, until another operator's tasks come."""
    return kept_for("bpe", path, lambda: Codec(path))


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        to_bytes = lambda s: bytes(byte_of[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        self.bytes = {i: to_bytes(s) for s, i in vocabulary.items() if s not in self.special} | {i: s.encode() for s, i in self.special.items()}
        self.id = {b: i for i, b in self.bytes.items() if i not in self.special.values()}
        self.text = list(map(str, range(max(self.bytes) + 1)))
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        #: Merges by packed pair, and the ids that they make, by rank.
        self.order: dict[int, int] = {}
        self.made: list[int] = []
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = to_bytes(a), to_bytes(b)
            self.rank.setdefault((self.id[a], self.id[b]), (k, self.id[a + b]))
            self.order.setdefault(self.id[a] << 17 | self.id[b], k)
            self.made.append(self.id[a + b])
        self.longest = max(map(len, self.id))
        self.single = [self.id[bytes([b])] for b in range(256)]
        #: Merges for many words at once: packed pairs in order with their ranks, and the ranks of all pairs of bytes.
        self.sorted = np.array(sorted(self.order), np.int64)
        self.ranks = np.array([self.order[p] for p in self.sorted.tolist()], np.int64)
        self.made_of, self.bytes_of = np.array(self.made, np.int64), np.array(self.single, np.int64)
        self.first = self.rank_of(np.repeat(self.bytes_of, 256), np.tile(self.bytes_of, 256)).reshape(256, 256)
        #: Tokens that greedy splits may use: those that their own bytes encode to.
        self.usable = {b: i for b, i in self.id.items() if self.merge(b) == [i]}
        #: Beginnings of tokens: a longer match is looked for while the bytes so far are one.
        self.begins = {b[:k] for b in self.usable for k in range(1, len(b))}
        self.trie = self._trie()
        #: One number object an id, whatever the number of words that hold it.
        self.same = list(range(max(self.bytes) + 1))
        letters, numbers, spaces = _classes()
        pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
        self.words = re.compile(pattern).findall
        self.chunks = re.compile(rf" ?[^{spaces}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall
        self.apart = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        #: Ids of chunks and of words: a word is a chunk of one word, so both are one table.
        self.kept: dict[str, tuple[int, ...]] = {}
        self.known = self.kept
        self.kept_bytes = 0
        self.pairs: dict[int, bool] = {}

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the leftmost pair of least rank first."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        if n <= SHORT:
            get, most = self.order.get, 1 << 30
            ranks = [get(a << 17 | b, most) for a, b in zip(ids, ids[1:])]
            while ranks:
                best = min(ranks)
                if best == most:
                    break
                i = ranks.index(best)
                ids[i : i + 2] = [self.made[best]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = get(ids[i] << 17 | ids[i + 1], most)
                if i:
                    ranks[i - 1] = get(ids[i - 1] << 17 | ids[i], most)
            return ids
        # a heap over a linked list
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := self.rank.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (k := before[i]) >= 0 and (r := self.rank.get((ids[k], ids[i]))):
                heapq.heappush(heap, (r[0], k, ids[k], ids[i]))
        return [i for i in ids if i >= 0]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NEVER where they do not merge."""
        pairs = a << 17 | b
        at = np.minimum(np.searchsorted(self.sorted, pairs), len(self.sorted) - 1)
        return np.where(self.sorted[at] == pairs, self.ranks[at], NEVER)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """What `merge` gives for each word: a round makes the leftmost merge of least rank in every word that has one. Words beyond SHORT bytes are merged one by one."""
        out: list[list[int]] = [self.merge(w) if len(w) > SHORT else [] for w in words]
        which = np.array([k for k, w in enumerate(words) if 0 < len(w) <= SHORT], np.int64)
        if not len(which):
            return out
        size = np.fromiter((len(words[k]) for k in which.tolist()), np.int64, len(which))
        raw = np.frombuffer(b"".join(words[k] for k in which.tolist()), np.uint8)
        ids, rank = self.bytes_of[raw], np.full(len(raw), NEVER)
        rank[:-1] = self.first[raw[:-1], raw[1:]]
        while len(which):
            ends = np.cumsum(size)
            begins = ends - size
            rank[ends - 1] = NEVER
            # the place within the word tells equal ranks apart
            least = np.minimum.reduceat(rank << 6 | np.arange(len(ids)) - np.repeat(begins, size), begins)
            moves = least >> 6 < NEVER
            for k, a, b in zip(which[~moves].tolist(), begins[~moves].tolist(), ends[~moves].tolist(), strict=True):
                out[k] = ids[a:b].tolist()
            at = begins[moves] + (least[moves] & 63)
            ids[at] = self.made_of[least[moves] >> 6]
            keep = np.repeat(moves, size)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            which, size, at, ids, rank = which[moves], size[moves] - 1, place[at], ids[keep], rank[keep]
            # pairs across words are none, whatever their ranks: they are closed at the head of the loop
            right, left = at[at + 1 < len(ids)], at[at > 0]
            rank[right] = self.rank_of(ids[right], ids[right + 1])
            rank[left - 1] = self.rank_of(ids[left - 1], ids[left])
        return out

    def greedy(self, word: bytes) -> list[int]:
        """The longest usable token at each place."""
        out, at, n, usable, begins = [], 0, len(word), self.usable, self.begins
        while at < n:
            end, last, last_end = at + 1, usable[word[at : at + 1]], at + 1
            while end < n:
                end += 1
                part = word[at:end]
                if (i := usable.get(part)) is not None:
                    last, last_end = i, end
                elif part not in begins:
                    break
            out.append(last)
            at = last_end
        return out

    def _trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Usable tokens as a trie in arrays: a state's first place, the state that owns a place, the state behind it (both by first place + byte), and a state's token, -1 without one."""
        states = {b"": 0} | {b: n for n, b in enumerate(sorted(self.begins | self.usable.keys()), 1)}
        children: dict[int, list[tuple[int, int]]] = {}
        for b, n in states.items():
            if b:
                children.setdefault(states[b[:-1]], []).append((b[-1], n))
        places = 1 << (4 * len(states) + 1024).bit_length()
        first, owner, behind, token = [0] * len(states), [-1] * places, [0] * places, np.full(len(states), -1, np.int64)
        at = 0
        # states with many children first; the next place tried is far off, so that few are taken
        for n in sorted(children, key=lambda n: -len(children[n])):
            while any(owner[at + b] >= 0 for b, _ in children[n]):
                at = (at + 40503) % (places - 256)
            first[n] = at
            for b, to in children[n]:
                owner[at + b], behind[at + b] = n, to
            at = (at + 40503) % (places - 256)
        token[[states[b] for b in self.usable]] = list(self.usable.values())
        return np.array(first, np.int64), np.array(owner, np.int64), np.array(behind, np.int64), token

    def greedy_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What `greedy` gives for all words, one after the other, and the number of each: a byte of every word a round. Words beyond SHORT bytes are split one by one."""
        first, owner, behind, token = self.trie
        n_bytes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        ends = np.cumsum(n_bytes)
        of, ids = [], []
        for k in np.flatnonzero(n_bytes > SHORT).tolist():
            ids.append(np.array(self.greedy(words[k]), np.int64))
            of.append(np.full(len(ids[-1]), k))
        which = np.flatnonzero((n_bytes > 0) & (n_bytes <= SHORT))
        at, end = (ends - n_bytes)[which], ends[which]
        state, last, last_end = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), at.copy()
        while len(which):
            place = first[state] + raw[at]
            on = (owner[place] == state) & (at < end)
            state = np.where(on, behind[place], 0)
            at = at + on
            found = token[state]
            last, last_end = np.where(found >= 0, found, last), np.where(found >= 0, at, last_end)
            if not on.all():
                # no token is longer: the last one found stands, and the next begins behind it
                of.append(which[~on])
                ids.append(last[~on])
                at = np.where(on, at, last_end)
                left = on | (at < end)
                which, at, end, state, last, last_end = which[left], at[left], end[left], state[left], last[left], last_end[left]
        if not of:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word = np.concatenate(of)
        return np.concatenate(ids)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def verified(self, pairs: np.ndarray) -> np.ndarray:
        """Which packed pairs (a << 32 | b) of tokens keep apart when their bytes are merged."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        each, to = np.unique(pairs, return_inverse=True)
        decided, raw, single = self.pairs, self.bytes, self.merge
        for p in set(each.tolist()) - decided.keys():
            a, b = p >> 32, p & 0xFFFFFFFF
            decided[p] = single(raw[a] + raw[b]) == [a, b]
        return np.fromiter(map(decided.__getitem__, each.tolist()), bool, len(each))[to]

    def learn(self, words: list[str]) -> None:
        """Encode new words: speculate, verify all adjacent pairs at once, merge those that fail."""
        raw = [w.encode() for w in words]
        flat, size = self.greedy_all(raw)
        word = np.repeat(np.arange(len(raw)), size)
        inside = word[1:] == word[:-1]
        fails = np.zeros(len(raw), bool)
        fails[word[1:][inside][~self.verified((flat[:-1] << 32 | flat[1:])[inside])]] = True
        ids, ends = tuple(map(self.same.__getitem__, flat.tolist())), np.cumsum(size)
        guess = [ids[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
        wrong = np.flatnonzero(fails).tolist()
        for k, merged in zip(wrong, self.merge_all([raw[k] for k in wrong]), strict=True):
            guess[k] = tuple(map(self.same.__getitem__, merged))
        self.kept.update(zip(words, guess, strict=True))
        # words, their ids, and the entries of the table
        self.kept_bytes += 220 * len(words) + 2 * sum(map(len, words)) + 8 * len(flat)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; the vocabulary's special strings are tokens of their own."""
        split: list[list] = []
        for t in texts:
            if self.apart and "<" in t and self.apart.search(t):
                parts, at = [], 0
                for m in self.apart.finditer(t):
                    parts += [self.chunks(t[at : m.start()]), self.special[m[0]]]
                    at = m.end()
                split.append([*parts, self.chunks(t[at:])])
            else:
                split.append([self.chunks(t)])
        if self.kept_bytes > KEPT_BYTES:
            self.kept.clear()
            self.kept_bytes = 0
        kept = self.kept
        new = set().union(*(p for parts in split for p in parts if not isinstance(p, int))) - kept.keys()
        if new:
            # letters only, behind a space or not, are one word of the pre-tokenizer
            words = {c for c in new if (c[1:] if c[0] == " " else c).isalpha()}
            several = {c: self.words(c) for c in new - words}
            words.update(w for ws in several.values() for w in ws if w not in kept)
            if words:
                self.learn(list(words))
            for c, ws in several.items():
                if len(ws) > 1:
                    kept[c] = ids = tuple(chain.from_iterable(map(kept.__getitem__, ws)))
                    self.kept_bytes += 220 + 2 * len(c) + 8 * len(ids)
        for parts in split:
            if len(parts) == 1:
                yield list(chain.from_iterable(map(kept.__getitem__, parts[0])))
                continue
            yield list(chain.from_iterable((p,) if isinstance(p, int) else chain.from_iterable(map(kept.__getitem__, p)) for p in parts))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _run(path: str, column: str, keep: list[str], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        at_most = 400
        for b in batches:
            for begin in range(0, b.num_rows, at_most):
                p = b.slice(begin, at_most)
                texts = [t or "" for t in p.column(p.schema.get_field_index(column)).to_pylist()]
                n, ids_hash, text_hash, every = [], [], [], []
                for ids in codec.encode(texts):
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join(map(codec.text.__getitem__, ids)).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                    if whole:
                        every.append(ids)
                out = [p.column(p.schema.get_field_index(k)) for k in keep] + [np.array(n, np.int64), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                yield batch([*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * whole], *out, *([pa.array(every, pa.list_(pa.int32()))] if whole else []))

    return run


def encode_texts(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """docs (doc_id long, text string, others ignored) to doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the ids' text).

    With ids=True the ids themselves come too, as array<int>. Null and empty texts have no ids. Rows come out one by one, repeated ones and those
    without an id as well. No length is cut.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return docs.select("doc_id", F.col("text")).mapInArrow(_run(path, "text", ["doc_id"], ids), schema)


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id long, ids array<int>) to (doc_id, text); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in batches:
            yield batch(["doc_id", "text"], b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.string()))

    small_batches(rows.sparkSession)
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
