"""Hashes of words and of runs of words, for whole Arrow batches at once in numpy.

A text's words are its maximal runs of ASCII letters and digits and of bytes beyond
ASCII, in lower case. Prefix sums of byte * base^i (mod 2^64) give any run's
polynomial hash by one subtraction, so no word ever becomes a Python object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = np.multiply.accumulate(have)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit hash well spread (a finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20):
    """The batch in slices of about ``most_bytes`` of text; a longer text is one alone."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def pieces(texts: pa.Array, most_bytes: int, overlap: int, lower: bool = True):
    """One long text in pieces of about ``most_bytes`` that end with a word: (an array of one text, by default in lower case, the number
    of its first word, whether it is the last). Each piece begins ``overlap`` words before the one before it
    ends, so every run of ``overlap`` + 1 words or fewer lies wholly in one."""
    raw, _ = flat(pc.utf8_lower(pc.fill_null(texts, "")) if lower else texts)
    at = word = 0
    while True:
        end = at
        while True:
            end = min(end + most_bytes, len(raw))
            while end < len(raw) and not len(gap := np.flatnonzero(~WORD_BYTE[raw[end : end + 65536]])):
                end = min(end + 65536, len(raw))
            if end < len(raw):
                end += int(gap[0])
            letter = WORD_BYTE[raw[at:end]]
            starts = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
            if len(starts) > overlap or end == len(raw):
                break
        yield pa.array([raw[at:end].tobytes()], pa.binary()).cast(pa.string()), word, end == len(raw)
        if end == len(raw):
            return
        keep = len(starts) - overlap
        at, word = at + int(starts[keep]) if overlap else end, word + keep


def is_long(texts: pa.Array, most_bytes: int) -> bool:
    """Whether an array that slices made is one text to be cut into pieces."""
    return len(texts) == 1 and (pc.binary_length(texts[0]).as_py() or 0) > 2 * most_bytes


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings; NULL is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def byte_sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums that part_hashes takes differences of."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw)), out=out[1:])
    return out


def part_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges."""
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start])


class Words:
    """Words of a slice of texts: ``start``/``end`` (bytes), ``doc`` (row), ``first``
    (row -> its first word; one more entry at the end), ``hash``."""

    def __init__(self, texts: pa.Array, keep_case: bool = False):
        """keep_case: ``raw`` keeps capital letters; hashes then lower ASCII and Latin-1 only."""
        if not keep_case:
            texts = pc.utf8_lower(pc.fill_null(texts, ""))
        self.raw, self.off = flat(texts)
        raw, n = self.raw, len(self.raw)
        if keep_case:
            raw = _LOWER[raw]
            latin = np.flatnonzero(raw[:-1] == 0xC3) + 1
            latin = latin[(raw[latin] >= 0x80) & (raw[latin] <= 0x9E) & (raw[latin] != 0x97)]
            raw[latin] += 0x20
        letter = WORD_BYTE[raw]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = letter[:-1], letter[1:]
        inner = self.off[(self.off > 0) & (self.off < n)]
        before[inner], after[inner - 1] = False, False
        self.start = np.flatnonzero(letter & ~before)
        self.end = np.flatnonzero(letter & ~after) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))
        self.sums = byte_sums(raw)
        self.hash = self.part(self.start, self.end)

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges."""
        return part_hashes(self.sums, start, end)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of ``k`` words inside a row."""
        return runs(self.hash, self.doc, k)


def runs(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    if k <= 8:
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(k):
            out = out * np.uint64(_BASE) + h[at + j]
        return at, mix(out)
    return at, stretches(h, at, at + k)


def stretches(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of word hashes h[start:end]."""
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(_BASE, len(h)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(h) + 1)[start])


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of each row's distinct shingles, sorted: runs of ``k`` words, or
    the one run of all words where a row has fewer. Row i has hashes[first[i]:first[i+1]]."""
    rows = len(words.off) - 1
    at, h = words.runs(k)
    doc = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        h = np.concatenate([h, stretches(words.hash, words.first[short], words.first[short + 1])])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(rows + 1))


def all_shingle_sets(texts: pa.Array, k: int, most_bytes: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of texts of any length, worked on in slices and long ones in pieces."""
    parts, counts = [np.zeros(0, np.uint64)], [0]
    for cut in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", most_bytes):
        if is_long(cut["text"], most_bytes):
            own = np.unique(np.concatenate([np.unique(Words(piece).runs(k)[1]) for piece, _, _ in pieces(cut["text"], most_bytes, k - 1)]))
            if len(own):
                parts.append(own)
                counts.append(len(own))
                continue
        h, first = shingle_sets(Words(cut["text"]), k)
        parts.append(h)
        counts += np.diff(first).tolist()
    return np.concatenate(parts), np.cumsum(counts)
