"""Ids of whole texts by a word-level BPE vocabulary (lower case, white space dropped, word ends marked), equal to those of the tokenizers library.

Texts of ASCII and Latin-1 letters are cut into words by the vocabulary's own rule, and each distinct word is encoded once a Python worker. New words are
merged many at a time: some of about one length stand in one matrix, and each step merges, in every word at once, the leftmost pair of least rank. The rules never join
what ASCII white space parts, so of other texts only the chunks with other characters go through the library itself, as do special tokens and very long words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from operator import itemgetter

import numpy as np

from carecolumns.llm.bpe import byte_letters
from carecolumns.llm.common import kept_for

#: Bytes of encoded words (by a rule of thumb for Python objects) that a worker keeps.
KEPT_BYTES = 140_000_000
#: Bytes of a word up to which it is merged in a matrix and kept.
MATRIX = 32
#: Words in a matrix.
SIDE_BY_SIDE = 4096
#: Characters of text that are split at once.
BLOCK = 1 << 20
#: Fixed value: the rule by which the public vocabulary cuts words; letters, single digits, and runs of other signs.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same rule over ASCII and the letters of Latin-1, in lower case.
_LETTERS = "a-zß-öø-ÿ"
_SIGNS = RULE.replace(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "")
#: Letters, the most frequent, are tried first: no other part of the rule begins with one.
_words = re.compile(rf"[{_LETTERS}]+|[0-9]|{_SIGNS}[^\t-\r {_LETTERS}0-9]+").findall
#: The same for texts of ASCII alone.
_ascii_words = re.compile(rf"[a-z]+|[0-9]|{_SIGNS}[^\t-\r a-z0-9]+").findall
_plain = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*").fullmatch
_chunks = re.compile(r"[^\t-\r ]+").findall
_gap = re.compile(r"[\t-\r ]").search
NONE = np.int32(1 << 30)


def codec_of(path: str) -> "WordCodec":
    return kept_for("word_bpe", path, lambda: WordCodec(path))


class WordCodec:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, rule = spec["model"], json.dumps(spec.get("pre_tokenizer"))
        vocabulary = model["vocab"]
        self.size = max(vocabulary.values(), default=0) + 1
        self.size = max(self.size, *(t["id"] + 1 for t in spec["added_tokens"]), 1)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        #: Whether the vocabulary follows the rules that this module knows; if not, whole texts go through the library.
        self.known_rules = model.get("end_of_word_suffix") == "</w>" and not model.get("ignore_merges") and json.dumps(RULE)[1:-1] in rule and all(t in json.dumps(spec["normalizer"]) for t in ("NFC", "Lowercase")) and all("<|" in t["content"] for t in spec["added_tokens"])
        #: Words met lately, and those of the time before: what comes again is kept, the rest goes.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.known_bytes = 0
        if not self.known_rules:
            return
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.last = np.array([vocabulary[c + "</w>"] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        # an open table of pairs, at most a quarter full
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(4 * len(keys) + 1)))))
        self.mask = (1 << int(64 - int(self.shift))) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE, np.int32)
        for rank, (k, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[at] not in (-1, k):
                at = (at + 1) & self.mask
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at] = k, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE for pairs that are no merge."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of 1 to MATRIX bytes, all merged side by side."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max())
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)
        rows, every = np.arange(len(words)), np.empty((len(words), width), self.dtype)
        left_over = size.copy()
        ids = self.inner[raw]
        ids[rows, size - 1] = self.last[raw[rows, size - 1]]
        ranks = np.full((len(words), width), NONE, np.int32)
        inside = np.flatnonzero(np.arange(width)[None] < size[:, None] - 1)
        ranks.ravel()[inside] = self.rank(ids.ravel()[inside], ids.ravel()[inside + 1])
        columns = np.arange(width)[None]
        while len(rows):
            best = ranks.argmin(1)
            at = np.arange(len(rows)) * width + best
            low = ranks.ravel()[at]
            go = low != NONE
            if not go.all():
                done = ~go
                every[rows[done]], left_over[rows[done]] = ids[done], size[done]
                rows, size, ids, ranks, best, low = rows[go], size[go], ids[go], ranks[go], best[go], low[go]
                at = np.arange(len(rows)) * width + best
            # what stands behind the merged pair moves up by one; the last place of a row is never part of a pair
            up = np.flatnonzero(columns[:, :-1] > best[:, None])
            up += up // (width - 1)
            ids.ravel()[up] = ids.ravel()[up + 1]
            ranks.ravel()[at], ranks.ravel()[up] = ranks.ravel()[np.minimum(at + 1, ranks.size - 1)], ranks.ravel()[up + 1]
            flat = ids.ravel()
            flat[at] = self.made[low]
            size -= 1
            right, left = at[best < size - 1], at[best > 0]
            ranks.ravel()[right] = self.rank(flat[right], flat[right + 1])
            ranks.ravel()[left - 1] = self.rank(flat[left - 1], flat[left])
        whole, step = every.tobytes(), self.dtype.itemsize
        return [whole[i : i + n] for i, n in zip(range(0, len(whole), width * step), (left_over * step).tolist(), strict=True)]

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new words of plain letters; those of kept length are remembered, the others returned."""
        got = {w: self.by_library(w) for w in words if len(w) > MATRIX // 2 and len(w.encode()) > MATRIX}
        words = sorted(words - got.keys(), key=len)
        for k in range(0, len(words), SIDE_BY_SIDE):  # words of about one length share a matrix
            some = words[k : k + SIDE_BY_SIDE]
            self.known.update(zip(some, self.merge([w.encode() for w in some]), strict=True))
        self.known_bytes += 200 * len(words)
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of `dtype`."""
        if not self.known_rules:
            return [self.by_library(t) for t in texts]
        if max(map(len, texts), default=0) > 2 * BLOCK:
            return [b"".join(self._encoded([part])[0] for part in self._blocks(t)) for t in texts]
        return self._encoded(texts)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        if self.known_bytes > KEPT_BYTES // 2:
            self.before, self.known, self.known_bytes = self.known, {}, 0
        split: list[list[str]] = []
        for t in texts:
            if t.isascii() and "<|" not in t:
                split.append(_ascii_words(t.lower()))
            elif _plain(t) and "<|" not in t:
                split.append(_words(t.lower()))
            else:
                # chunks with other characters are marked by a space, which no word holds
                split.append([w for c in _chunks(t) for w in (_words(c.lower()) if _plain(c) and "<|" not in c else (" " + c,))])
        new = set().union(*split) - self.known.keys()
        again = new & self.before.keys()
        self.known.update(zip(again, map(self.before.__getitem__, again)))
        self.known_bytes += 200 * len(again)
        new -= again
        odd = {w for w in new if w[0] == " "}
        rare = self.learn(new - odd) if new else {}
        rare |= {w: self.by_library(w[1:]) for w in odd}
        known = self.known
        if not rare:
            return [b"".join(itemgetter(*s)(known)) if len(s) > 1 else known[s[0]] if s else b"" for s in split]
        return [b"".join([rare[w] if w in rare else known[w] for w in s]) for s in split]

    def _blocks(self, text: str) -> Iterable[str]:
        at = 0
        while at < len(text):
            m = _gap(text, at + BLOCK)
            end = m.end() if m else len(text)
            yield text[at:end]
            at = end
