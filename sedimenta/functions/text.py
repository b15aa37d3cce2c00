"""Text functions of full-text search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, and every other character by itself (blanks and punctuation
    are tokens, line feeds alone aren't); case is kept."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+|[^\\n]"), F.lit(0))


_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Bytes of text whose tokens are counted at once.
AT_ONCE = 8 << 20


def bounds(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where tokens of UTF-8 texts begin (a line feed counts as one here); each ends where the next one begins."""
    letter = _ALNUM[raw]
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    first = off[:-1][off[:-1] < len(raw)]
    start[first] |= letter[first]
    return np.flatnonzero(start | ~letter & ((raw & 0xC0) != 0x80))


def counted(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts, as by ``tokens``: the terms; term, text and count of each pair there is, by term, then text; tokens of each text."""
    at, n = bounds(raw, off), len(off) - 1
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw)).astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
    text = np.repeat(np.arange(n), np.diff(np.searchsorted(at, off)))
    keep = raw[at] != 10
    text = text[keep]
    pairs = words.indices.to_numpy().astype(np.int64)[keep] * n + text
    pairs.sort()
    heads = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    return words.dictionary, pairs[heads] // n, pairs[heads] % n, np.diff(np.append(heads, len(pairs))), np.bincount(text, minlength=n)


def counted_long(raw: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``counted`` of one long text, by pieces that end where a token does."""
    parts, at, length = [], 0, 0
    while at < len(raw):
        end = min(at + AT_ONCE, len(raw))
        while end < len(raw) and (_ALNUM[raw[end]] or raw[end] & 0xC0 == 0x80):
            end += 1
        terms, term, _, n, sizes = counted(raw[at:end], np.array([0, end - at]))
        parts.append(pa.table({"term": terms.take(pa.array(term)), "n": n}))
        at, length = end, length + int(sizes[0])
    total = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
    n = total["n_sum"].to_numpy()
    return total["term"].combine_chunks(), np.arange(len(n)), np.zeros(len(n), np.int64), n, np.array([length])


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, row id, text) to (file, term, [(row id, tf, length of the text)]), a list for each term of some MB of a file's texts."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(2)))
        file, key, text = batch.column(0), batch.column(1), batch.column(2).cast(pa.large_string())
        if not len(text):
            continue
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = text.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        turns = np.flatnonzero(pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)) + 1
        for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(text)]):
            while a < b:
                to = min(b, max(a + 1, int(np.searchsorted(off, off[a] + AT_ONCE, side="right")) - 1))
                own = raw[off[a] : off[to]]
                terms, term, row, tf, sizes = counted_long(own) if len(own) > 2 * AT_ONCE else counted(own, off[a : to + 1] - off[a])
                heads = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
                entry = pa.StructArray.from_arrays([key[a:to].take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(sizes[row], pa.int32())], names=[batch.schema.names[1], "tf", "len"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(term)), pa.int32()), entry)
                yield pa.RecordBatch.from_arrays([pa.repeat(file[a], len(heads)), terms.take(pa.array(term[heads])), lists], names=[batch.schema.names[0], "term", "rows"])
                a = to
