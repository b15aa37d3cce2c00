"""Prefix-free parsing: the order of a repetitive corpus' suffixes from suffix arrays of a dictionary and a parse.

Places where a rolling hash of TRIGGER words is 0 modulo MODULUS part each sequence into phrases, which
overlap in their triggers. No suffix of a phrase that is longer than a trigger begins another one, so the suffixes of the corpus are in the
order of (the suffix of the phrase they begin in, the parse from the next phrase on). What repeats is sorted once, in the dictionary.
"""

from __future__ import annotations

import numpy as np

from .texthash import runs, stretches

TRIGGER, MODULUS = 4, 8


def _gather(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return values[np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)]


class SuffixRanks:
    """Ranks of all suffixes of several sequences, each up to its own end, by prefix doubling; the ranks of
    the first 1, 2, 4, ... symbols are kept, from which the common length of any two suffixes is read."""

    def __init__(self, symbols: np.ndarray, end: np.ndarray):
        """``end``: for each position the end of its sequence. Symbols are 1 or more."""
        self.end = end
        at = np.arange(len(symbols))
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
        self.levels, width, longest = [rank.astype(np.int32)], 1, int((end - at).max(initial=0))
        while width < longest:
            after = np.zeros(len(rank), dtype=np.int64)
            inside = np.flatnonzero(at + width < end)
            after[inside] = rank[inside + width]
            rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
            self.levels.append(rank.astype(np.int32))
            width *= 2
        self.rank = rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``i`` and ``j`` have in common."""
        out = np.zeros(len(i), dtype=np.int64)
        top = len(self.rank) - 1
        for level in reversed(range(len(self.levels))):
            a, b, ranks = i + out, j + out, self.levels[level]
            same = (a < self.end[i]) & (b < self.end[j])
            same &= ranks[np.minimum(a, top)] == ranks[np.minimum(b, top)]
            out += np.where(same, np.minimum(1 << level, self.end[i] - a), 0)
        return out


class PrefixFreeParse:
    """Dictionary, parse, and the suffix arrays of both. Sequence k is words[first[k]:first[k + 1]], and
    its place p is place first[k] + k + p of ``text``, in which every sequence is followed by the end sign 1."""

    def __init__(self, words: np.ndarray, first: np.ndarray, modulus: int = MODULUS):
        rows = len(first) - 1
        n = np.diff(first)
        row = np.repeat(np.arange(rows), n)
        own = np.arange(len(words)) + row
        self.text = np.ones(len(words) + rows, dtype=np.int64)
        self.text[own] = np.unique(words, return_inverse=True)[1] + 2
        at, h = runs(words.astype(np.uint64) + np.uint64(1), row, TRIGGER)
        trigger = own[at[h % np.uint64(modulus) == 0]]
        # phrases begin at sequences' starts and at triggers, and end with the next trigger or the end sign
        opens = first[:-1] + np.arange(rows)
        self.start = np.union1d(opens, trigger)
        self.row = np.searchsorted(opens, self.start, side="right") - 1
        last = np.append(self.row[1:] != self.row[:-1], True) if len(self.start) else np.zeros(0, bool)
        close = opens + n + 1
        end = np.append(self.start[1:] + TRIGGER, 0)
        end[last] = close[self.row[last]]
        self.close = close[self.row]
        # the dictionary: distinct phrases one after the other
        size = end - self.start
        key = stretches(self.text.astype(np.uint64), self.start, end) + size.astype(np.uint64)
        _, one, self.phrase = np.unique(key, return_index=True, return_inverse=True)
        self.entry = np.append(0, np.cumsum(size[one]))
        words_of = _gather(self.text, self.start[one], size[one])
        self.dictionary = SuffixRanks(words_of, np.repeat(self.entry[1:], size[one]))
        # the parse: each sequence as the ranks of its phrases
        stop = np.searchsorted(self.row, np.arange(rows), side="right")[self.row] if rows else np.zeros(0, np.int64)
        self.stop = stop
        self.parse = SuffixRanks(self.dictionary.rank[self.entry[self.phrase]], stop)

    def _common_parse(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words the corpus has in common from the phrases ``p`` and ``q`` on."""
        m = self.parse.common(p, q)
        whole = p + m >= self.stop[p]  # both are the same to their ends
        inner = np.where(whole, p, p + m), np.where(whole, q, q + m)
        more = self.dictionary.common(self.entry[self.phrase[inner[0]]], self.entry[self.phrase[inner[1]]])
        return np.where(whole, self.close[p] - self.start[p], self.start[inner[0]] - self.start[p] + more)

    def order(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common): ``places`` of ``text`` in the order of the suffixes that begin there, and how many words each
        has in common with the one before it (the end sign is a word)."""
        k = np.searchsorted(self.start, places, side="right") - 1
        inside = self.entry[self.phrase[k]] + places - self.start[k]
        goes_on = k + 1 < self.stop[k]
        after = np.minimum(k + 1, len(self.start) - 1)
        head, tail = self.dictionary.rank[inside], np.where(goes_on, self.parse.rank[after], 0)
        order = np.lexsort((tail, head))
        common = np.zeros(len(order), dtype=np.int64)
        if len(order) > 1:
            i, j = order[:-1], order[1:]
            same = head[i] == head[j]
            far = same & goes_on[i]
            common[1:] = self.dictionary.common(inside[i], inside[j])
            x, y = i[far], j[far]
            common[1:][far] = self.start[after[x]] - places[x] + self._common_parse(after[x], after[y])
        return order, common
