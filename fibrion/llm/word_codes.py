"""Encodes Arrow batches of texts with a tokenizers-library model, each distinct word of a batch once.

A vocabulary qualifies if no token reaches over the space or line end before a word, so that a text's ids are its words'
ids put together. Texts for which that isn't plain (`plain` says which) go to the library whole. A worker keeps the
codes of the first `kept` words it meets; the ids never depend on that.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("RAYON_NUM_THREADS", "2")  # the library's threads; executors run a task a core
JOINED = 50  #: new words given to the library in one text


def ragged(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices pool[start:start+length], end to end."""
    end = np.cumsum(length)
    return pool[np.repeat(start - (end - length), length) + np.arange(end[-1] if len(end) else 0)]


class WordCodes:
    """words: the library's tokenizer for ' w1 w2...' with no prefix added; whole: for entire texts; width: bytes of text
    that each id stands for; plain: RE2 pattern that no plain text matches; leading: the first word of a text is coded
    as after a line end, whose single id is dropped."""

    def __init__(self, words, whole, width: np.ndarray, unplain: str, leading: bool, kept: int = 300_000, held=None):
        """held(texts, ids, count, cut): is given every new word (cut) and every text that goes to the library whole, with
        the ids end to end and how many each has."""
        self.words, self.whole, self.width, self.unplain, self.leading, self.kept, self.held = words, whole, width, unplain, leading, kept, held
        self.known: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 16, "<u4"), 0
        self.off = np.empty(1 << 14, "i8")

    @staticmethod
    def _ids(tok, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        n = np.fromiter(map(len, got), "i8", len(got))
        return np.fromiter(chain.from_iterable(got), "<u4", int(n.sum())), n

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, end to end, and how many each has; cut where the text bytes that ids stand for meet the words'."""
        texts = [w if w[0] == "\n" else " " + w for w in words]
        ids, _ = self._ids(self.words, ["".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)])
        ends = np.cumsum(pc.binary_length(pa.array(texts, pa.large_string())).to_numpy().astype("i8"))
        at = np.cumsum(self.width[ids])
        cuts = np.searchsorted(at, ends)
        if len(ids) and not np.array_equal(at[cuts], ends):
            raise ValueError("a token reaches over a word's end: this vocabulary can't be cut at words")
        n = np.diff(cuts + 1, prepend=0)
        if self.held:
            self.held(words, ids, n, True)
        return ids, n

    def _codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, start, length) for distinct words."""
        at = np.fromiter((self.known.get(w, -1) for w in words), "i8", len(words))
        length = np.zeros(len(words), "i8")
        start = np.zeros(len(words), "i8")
        old = at >= 0
        start[old] = self.off[at[old]]
        length[old] = self.off[at[old] + 1] - start[old]
        fresh = np.flatnonzero(~old & np.fromiter(map(bool, words), bool, len(words)))
        pool = self.pool[: self.used]
        if len(fresh):
            names = [words[i] for i in fresh]
            ids, n = self._new(names)
            first = np.cumsum(n) - n
            start[fresh], length[fresh] = first + self.used, n
            room = max(0, min(self.kept - len(self.known), len(names)))
            pool = np.concatenate([pool, ids])
            if room:
                base, k = len(self.known), int(n[:room].sum())
                if self.used + k > len(self.pool):
                    self.pool = np.concatenate([self.pool[: self.used], np.empty(max(k, self.used), "<u4")])
                if base + room + 1 > len(self.off):
                    self.off = np.concatenate([self.off, np.empty(max(room + 1, len(self.off)), "i8")])
                self.pool[self.used : self.used + k] = ids[:k]
                self.off[base : base + room] = first[:room] + self.used
                self.off[base + room] = self.used + k
                self.used += k
                self.known.update(zip(names[:room], range(base, base + room), strict=True))
        return pool, start, length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit), document after document, and each document's number of ids. Null: none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        hard = pc.match_substring_regex(texts, self.unplain).to_numpy(zero_copy_only=False)
        n = len(texts)
        count = np.zeros(n, "i8")
        plain = np.flatnonzero(~hard)
        sub = texts.take(pa.array(plain))
        if self.leading:
            sub = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), sub, pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(pc.replace_substring(sub, "\n", " \n"), " ")
        flat, bounds = lists.flatten(), lists.value_lengths().to_numpy().astype("i8")
        coded = flat.dictionary_encode()
        pool, start, length = self._codes(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy()
        per_word = length[code]
        easy = ragged(pool, start[code], per_word)
        total = np.concatenate([[0], np.cumsum(per_word)])
        at = np.concatenate([[0], np.cumsum(bounds)])
        count[plain] = total[at[1:]] - total[at[:-1]]
        if self.leading and len(plain):
            keep = np.ones(len(easy), bool)
            keep[total[at[:-1]]] = False
            easy = easy[keep]
            count[plain] -= 1
        hard_i = np.flatnonzero(hard & (pc.binary_length(texts).to_numpy() > 0))
        if not len(hard_i):
            return easy, count
        whole = texts.take(pa.array(hard_i)).to_pylist()
        rest, k = self._ids(self.whole, whole)
        if self.held:
            self.held(whole, rest, k, False)
        count[hard_i] = k
        out, slot = np.empty(len(easy) + len(rest), "<u4"), np.repeat(hard, count)
        out[~slot], out[slot] = easy, rest
        return out, count
