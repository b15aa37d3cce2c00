"""BPE encoding and decoding with a memory-mapped lexicon of frequent words.

Frequent words are compiled into a minimal acyclic transducer: an automaton that
shares prefixes and suffixes and whose arcs carry the numbers that add up to a word's
place in the lexicon, where its token ids lie. Words it doesn't hold are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
from collections import Counter
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_at_exit, discard, materialize, shared_dir
from .texthash import byte_sums, flat, is_long, part_hashes, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are parted into words before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 256  # bytes from which a word is merged alone, by a heap
CACHE_WORDS = 400_000
PIECE = 1 << 20  # bytes of text that are worked on at once


def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def compile_vocabulary(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """Tables of a vocabulary: bytes of each id, id of each byte, id that each pair merges to."""
    size = max(ranks.values()) + 1
    by_id = [b""] * size
    for token, i in ranks.items():
        by_id[i] = token
    pairs = {}
    for token, i in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = i
    keys = np.array(sorted(pairs), dtype=np.int64)
    return {
        "token_bytes": np.frombuffer(b"".join(by_id), dtype=np.uint8),
        "token_first": np.concatenate([[0], np.cumsum([len(t) for t in by_id])]).astype(np.int64),
        "byte_id": np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64),
        "pair_key": keys,
        "pair_id": np.array([pairs[k] for k in keys.tolist()], dtype=np.int64),
    }


def compile_lexicon(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of ``words``: arcs sorted by state * 256 + byte, each with
    its target and the number of words that come before it; incremental construction from sorted words."""
    register: dict[tuple, int] = {}
    count: list[int] = []
    states: list[tuple] = []

    def frozen(node) -> int:
        key = (node[0], tuple(map(tuple, node[1])))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            count.append(node[0] + sum(count[t] for _, t in node[1]))
        return register[key]

    path, before = [[0, []]], b""
    for word in sorted(set(words)):
        same = 0
        while same < min(len(before), len(word)) and before[same] == word[same]:
            same += 1
        while len(path) - 1 > same:
            state = frozen(path.pop())
            path[-1][1][-1][1] = state
        for b in word[same:]:
            path[-1][1].append([b, -1])
            path.append([0, []])
        path[-1][0] = 1
        before = word
    while len(path) > 1:
        state = frozen(path.pop())
        path[-1][1][-1][1] = state
    root = frozen(path[0])
    arcs = []
    for no, (final, out) in enumerate(states):
        add = final
        for b, target in out:
            arcs.append((no << 8 | b, target, add))
            add += count[target]
    table = np.array(arcs, dtype=np.int64).reshape(-1, 3)
    return {"arc_key": table[:, 0], "arc_to": table[:, 1], "arc_add": table[:, 2], "final": np.array([f for f, _ in states], dtype=np.int8), "root": np.array([root])}


def look_up(t: dict[str, np.ndarray], raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place of each word in the lexicon, -1 where it has none; all words walk at once."""
    n = np.diff(first)
    place, state = np.zeros(len(n), dtype=np.int64), np.full(len(n), int(t["root"][0]))
    alive = np.flatnonzero(n >= 0)
    keys = t["arc_key"]
    for pos in range(int(n.max(initial=0))):
        alive = alive[n[alive] > pos]
        if not len(alive) or not len(keys):
            break
        want = state[alive] << 8 | raw[first[alive] + pos]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        ok = keys[at] == want
        state[alive[~ok]] = -1
        alive, at = alive[ok], at[ok]
        state[alive] = t["arc_to"][at]
        place[alive] += t["arc_add"][at]
    if not len(keys):
        return np.full(len(n), -1)
    good = (state >= 0) & (t["final"][state] == 1) & (n > 0)
    return np.where(good, place, -1)


def gather(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[start:start + n] for each pair, one after the other."""
    ends = np.cumsum(n)
    return values[np.arange(int(n.sum())) + np.repeat(start - ends + n, n)]


def firsts(n: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs of lengths ``n`` begins, and the end."""
    return np.append(0, np.cumsum(n)).astype(np.int64)


def _pair_ids(t: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Id that each pair merges to; a large number where it doesn't."""
    want = a << 32 | b
    at = np.minimum(np.searchsorted(t["pair_key"], want), len(t["pair_key"]) - 1)
    return np.where(t["pair_key"][at] == want, t["pair_id"][at], 1 << 40)


def merge_long(t: dict[str, np.ndarray], raw: np.ndarray) -> list[int]:
    """Merge one word by a heap of its pairs and a linked list of its symbols."""
    sym = t["byte_id"][raw].tolist()
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    table: dict[int, int] = {}

    def pair(a, b):
        key = a << 32 | b
        if key not in table:
            table[key] = int(_pair_ids(t, np.array([a]), np.array([b]))[0])
        return table[key]

    first = _pair_ids(t, np.array(sym[:-1]), np.array(sym[1:])).tolist() if n > 1 else []
    heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(first) if r < 1 << 40]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = rank, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := pair(rank, sym[after[i]])) < 1 << 40:
                heapq.heappush(heap, (r, i, rank, sym[after[i]]))
        if (p := before[i]) >= 0 and (r := pair(sym[p], rank)) < 1 << 40:
            heapq.heappush(heap, (r, p, sym[p], rank))
    return [s for s in sym if s >= 0]


def merge(t: dict[str, np.ndarray], raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact merges of many words at once, (ids, first) like the words: in each step every word merges all places of its
    pair of least rank (left to right where they overlap), until no pair is left."""
    n = np.diff(first)
    done_sym, done_word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.flatnonzero(n > LONG_WORD):
        done_sym.append(np.array(merge_long(t, raw[first[k] : first[k + 1]])))
        done_word.append(np.full(len(done_sym[-1]), k))
    short = np.flatnonzero((n > 0) & (n <= LONG_WORD))
    sym, word = t["byte_id"][gather(raw, first[short], n[short])], np.repeat(short, n[short])
    rank = np.full(len(sym), 1 << 40)
    inside = np.flatnonzero(word[:-1] == word[1:])
    rank[inside] = _pair_ids(t, sym[inside], sym[inside + 1])
    while len(sym):
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(sym))))
        over = best == 1 << 40  # words without a pair to merge are ready
        if over.any():
            done_sym.append(sym[over])
            done_word.append(word[over])
            sym, word, rank, best = sym[~over], word[~over], rank[~over], best[~over]
            if not len(sym):
                break
        place = np.flatnonzero(rank == best)
        runs = np.append(True, np.diff(place) != 1).nonzero()[0]
        lead = place[(np.arange(len(place)) - np.repeat(runs, np.diff(np.append(runs, len(place))))) % 2 == 0]
        sym[lead] = rank[lead]
        keep = np.ones(len(sym), dtype=bool)
        keep[lead + 1] = False
        sym, word, rank = sym[keep], word[keep], rank[keep]
        # only the pairs of new symbols with their neighbours are new
        lead -= np.arange(len(lead))
        fresh = np.concatenate([lead, lead[lead > 0] - 1])
        last = (fresh == len(sym) - 1) | (word[np.minimum(fresh + 1, len(sym) - 1)] != word[fresh])
        rank[fresh[last]] = 1 << 40
        fresh = fresh[~last]
        rank[fresh] = _pair_ids(t, sym[fresh], sym[fresh + 1])
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    return sym[np.argsort(word, kind="stable")].astype(np.int32), firsts(np.bincount(word, minlength=len(n)))


def pack(tables: dict[str, np.ndarray]) -> bytes:
    """Arrays in one block that can be memory-mapped: a length, a JSON header, the arrays at multiples of 64."""
    head, at, parts = {}, 0, []
    for name, a in tables.items():
        a = np.ascontiguousarray(a)
        head[name] = (a.dtype.str, len(a), at)
        parts.append(a.tobytes() + b"\0" * (-a.nbytes % 64))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def unpack(path: str) -> dict[str, np.ndarray]:
    block = np.memmap(path, dtype=np.uint8, mode="r")
    size = int.from_bytes(block[:8].tobytes(), "little")
    head = json.loads(block[8 : 8 + size].tobytes())
    return {k: block[8 + size + at : 8 + size + at + n * np.dtype(d).itemsize].view(d) for k, (d, n, at) in head.items()}


def ship(spark: SparkSession, block: bytes) -> str:
    """Put a block in the shared folder and have Spark bring it to every executor that
    ever runs a task; its name is for SparkFiles."""
    name = f"bpe-{uuid.uuid4().hex}.bin"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(block))
    out.close()
    delete_at_exit(spark, path.toString())
    spark.sparkContext.addFile(path.toString())
    return name


_KIND = np.full(256, 3, dtype=np.uint8)  # 0 letter, 1 digit, 2 space, 3 other
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]], _KIND[48:58], _KIND[[32, 9, 10, 13]] = 0, 1, 2
_RARE = np.zeros(256, dtype=bool)  # bytes whose texts are parted by PATTERN itself
_RARE[[*range(0, 9), 11, 12, *range(14, 32), 39, *range(192, 195), *range(196, 256)]] = True


_SAFE = np.full(256, 9, dtype=np.uint8)  # kinds of ASCII between which PATTERN always ends a word; 9: none
_SAFE[33:127] = 3
_SAFE[[*range(65, 91), *range(97, 123)]], _SAFE[48:58], _SAFE[[32, 9, 10, 13]], _SAFE[39] = 0, 1, 2, 9


def cut(text: pa.Array, most_bytes: int) -> pa.Array:
    """One text in parts of about ``most_bytes`` whose words are those of the text: each ends after a letter, digit or sign
    (no apostrophe) that is followed by an ASCII character of another kind, or a space. A run without such a place isn't cut."""
    raw, _ = flat(text)
    ends = [0]
    while ends[-1] < len(raw):
        at = ends[-1] + most_bytes
        while at < len(raw):
            kind = _SAFE[raw[at - 1 : at + 65536]]
            safe = np.flatnonzero((kind[:-1] != 2) & (kind[:-1] != 9) & (kind[1:] != 9) & (kind[:-1] != kind[1:]))
            if len(safe):
                at += int(safe[0])
                break
            at += len(kind) - 1
        ends.append(min(at, len(raw)))
    return pa.array([raw[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()).cast(pa.string())


def texts_of(batch: pa.RecordBatch, column: str):
    """Texts of a batch in arrays of about PIECE bytes; longer texts are cut."""
    for part in slices(batch, column, PIECE):
        if is_long(part[column], PIECE):
            own = cut(part[column], PIECE)
            yield from (own.slice(k, 1) for k in range(len(own)))
        else:
            yield part[column]


class Parted:
    """The words that PATTERN makes of texts, as byte ranges ``start``/``end`` of ``raw`` with their ``hash``.

    Texts of ASCII (but for apostrophes and rare controls) and Latin-1 letters are parted in numpy: a word
    begins where the kind of character changes, and the last of some spaces before other characters begins one
    by itself or, if it is a blank, with them. Other texts (``slow``, row numbers) go through the regular expression."""

    def __init__(self, texts: pa.Array):
        raw, off = flat(texts)
        rows = len(off) - 1
        bad = _RARE[raw]
        signs = np.flatnonzero(raw[:-1] == 0xC3) + 1
        bad[signs[(raw[signs] == 0x97) | (raw[signs] == 0xB7)]] = True
        seen = np.append(0, np.cumsum(bad))[off]
        self.slow = np.flatnonzero(seen[1:] > seen[:-1])
        if len(self.slow):
            fast = np.ones(rows, dtype=bool)
            fast[self.slow] = False
            size = np.where(fast, np.diff(off), 0)
            raw, off = raw[np.repeat(fast, np.diff(off))], firsts(size)
        n = len(raw)
        kind = _KIND[raw]
        begin = np.zeros(n, dtype=bool)
        if n:
            begin[1:] = kind[1:] != kind[:-1]
            opens = off[:-1][np.diff(off) > 0]
            begin[opens] = True
            inside = begin.copy()
            inside[opens] = False
            after = np.flatnonzero(inside & (kind != 2))
            after = after[kind[after - 1] == 2]  # other characters after spaces
            begin[after - 1] = True
            begin[after[raw[after - 1] == 32]] = False
        self.raw, self.start = raw, np.flatnonzero(begin)
        self.end = np.append(self.start[1:], n)
        self.first = np.searchsorted(self.start, off)
        self.hash = part_hashes(byte_sums(raw), self.start, self.end)

    def bytes_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.end[words] - self.start[words]
        return gather(self.raw, self.start[words], n), firsts(n)


class Numbers:
    """Numbers 0, 1, ... for 64-bit hashes in the order in which they are met."""

    def __init__(self):
        self.keys, self.nums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for new ones."""
        at = np.searchsorted(self.keys, keys)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == keys[hit]
        out = np.full(len(keys), -1, dtype=np.int64)
        out[hit] = self.nums[at[hit]]
        return out

    def add(self, keys: np.ndarray, start: int) -> None:
        """Sorted new keys, numbered from ``start``."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.nums = np.insert(self.keys, at, keys), np.insert(self.nums, at, np.arange(start, start + len(keys)))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; each task adds up its own before anything is shuffled."""

    def count(batches):
        find, rare = regex.compile(PATTERN).findall, Counter()
        numbers, total, kept = Numbers(), np.zeros(0, np.int64), []

        def drain():
            nonlocal numbers, total, kept
            if kept:
                data = pa.py_buffer(np.concatenate([r for r, _ in kept]).tobytes())
                off = firsts(np.concatenate([np.diff(f) for _, f in kept])).astype(np.int32)
                words = pa.StringArray.from_buffers(len(total), pa.py_buffer(off.tobytes()), data)
                yield pa.RecordBatch.from_arrays([words, pa.array(total)], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(rare), pa.string()), pa.array(list(rare.values()), pa.int64())], names=["word", "n"])
            rare.clear()
            numbers, total, kept = Numbers(), np.zeros(0, np.int64), []

        for batch in batches:
            for texts in texts_of(batch, "text"):
                p = Parted(texts)
                keys, at, n = np.unique(p.hash, return_index=True, return_counts=True)
                num = numbers.find(keys)
                total[num[num >= 0]] += n[num >= 0]
                new = num < 0
                numbers.add(keys[new], len(total))
                kept.append(p.bytes_of(at[new]))
                total = np.concatenate([total, n[new]])
                for text in texts.take(pa.array(p.slow)).to_pylist():
                    rare.update(find(text))
                if len(total) + len(rare) > CACHE_WORDS:
                    yield from drain()
        yield from drain()

    parts = docs.select(F.col(text_col).alias("text")).where("text <> ''").mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, text_col: str, lexicon_size: int) -> list[bytes]:
    """The most frequent words of 64 bytes at most, as many whole classes of frequency (steps of
    about a tenth) as ``lexicon_size`` has room for; only these are collected."""
    counts = word_counts(docs, text_col).where("octet_length(word) <= 64 and n > 1")
    counts = materialize(counts.withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "word-counts")
    left, least = lexicon_size, 1 << 30
    for level, n in counts.groupBy("level").count().orderBy(F.col("level").desc()).collect():  # some hundred rows
        left -= n
        if left < 0:
            break
        least = level
    words = sorted(r[0].encode() for r in counts.where(F.col("level") >= least).select("word").collect())
    discard(counts)
    return words


def build_lexicon(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, lexicon_size: int = 65536) -> str:
    """Count all words of all texts, compile the frequent ones with their ids, and ship
    them; the name of the shipped block."""
    words = frequent_words(docs, text_col, lexicon_size)
    tables = compile_vocabulary(load_ranks(vocabulary))
    raw, first = np.frombuffer(b"".join(words), dtype=np.uint8), firsts(np.array([len(w) for w in words], dtype=np.int64))
    tables["ids"], tables["ids_first"] = merge(tables, raw, first)
    tables |= compile_lexicon(words)
    return ship(docs.sparkSession, pack(tables))


class Encoder:
    """Encodes texts; the ids of word number k are ``ids[first[k]:first[k + 1]]``. Words that were met before
    are known by their hash."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.t, self.find = tables, regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.numbers, self.by_word = Numbers(), {}
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, raw: np.ndarray, first: np.ndarray) -> int:
        """Give words numbers, the first of which is returned, and ids: from the lexicon, else by merging."""
        place, n = look_up(self.t, raw, first), np.diff(first)
        known, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        at = self.t["ids_first"][place[known]]
        have = self.t["ids_first"][place[known] + 1] - at
        merged, cut = merge(self.t, gather(raw, first[new], n[new]), firsts(n[new]))
        owner = np.concatenate([np.repeat(known, have), np.repeat(new, np.diff(cut))])
        ids = np.concatenate([gather(self.t["ids"], at, have), merged])[np.argsort(owner, kind="stable")]
        start = len(self.first) - 1
        self.ids = np.concatenate([self.ids, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(owner, minlength=len(n)))])
        return start

    def _numbers(self, p: Parted) -> np.ndarray:
        keys, at, back = np.unique(p.hash, return_index=True, return_inverse=True)
        num = self.numbers.find(keys)
        new = np.flatnonzero(num < 0)
        if len(new):
            start = self.learn(*p.bytes_of(at[new]))
            self.numbers.add(keys[new], start)
            num[new] = np.arange(start, start + len(new))
        return num[back]

    def _slow(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parted = [self.find(t) if t else [] for t in texts]
        missing = list(set(chain.from_iterable(parted)).difference(self.by_word))
        if missing:
            raw = [w.encode("utf-8", "surrogatepass") for w in missing]
            start = self.learn(np.frombuffer(b"".join(raw), dtype=np.uint8), firsts(np.array([len(r) for r in raw])))
            self.by_word.update(zip(missing, range(start, start + len(missing))))
        n = np.array([len(p) for p in parted], dtype=np.int64)
        return np.fromiter(map(self.by_word.__getitem__, chain.from_iterable(parted)), dtype=np.int64, count=int(n.sum())), n

    def encode(self, texts: pa.Array, by_hash: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of text i are ids[first[i]:first[i + 1]]."""
        if len(self.first) > CACHE_WORDS:
            self.forget()
        if by_hash:
            p = Parted(texts)
            words, n = self._numbers(p), np.diff(p.first)
            if len(p.slow):
                more, m = self._slow(texts.take(pa.array(p.slow)).to_pylist())
                row = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(p.slow, m)])
                words = np.concatenate([words, more])[np.argsort(row, kind="stable")]
                n[p.slow] = m
        else:
            words, n = self._slow(texts.to_pylist())
        size = self.first[words + 1] - self.first[words]
        return gather(self.ids, self.first[words], size), firsts(size)[firsts(n)].astype(np.int32)

    def exact(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, whether each text is what its ids decode to); long texts are worked on in parts."""
        if (pc.max(pc.binary_length(texts)).as_py() or 0) <= 2 * PIECE:
            return self._exact(texts)
        ids, n, same = [], [], []
        for i in range(len(texts)):
            own = texts.slice(i, 1)
            cuts = cut(own, PIECE) if is_long(own, PIECE) else own
            done = [self._exact(cuts.slice(k, 1)) for k in range(len(cuts))]
            ids += [x for x, _, _ in done]
            n.append(sum(len(x) for x, _, _ in done))
            same.append(all(ok.all() for _, _, ok in done))
        return np.concatenate(ids), firsts(np.array(n)).astype(np.int32), np.array(same)

    def _exact(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As exact; words are known by their hash
        unless that makes a difference."""
        want, want_off = flat(texts)
        for by_hash in (True, False):
            ids, first = self.encode(texts, by_hash)
            raw, off = decode_bytes(self.t, ids, first)
            if np.array_equal(raw, want) and np.array_equal(off, want_off):
                return ids, first, np.ones(len(texts), dtype=bool)
        return ids, first, np.array([np.array_equal(raw[a:b], want[c:d]) for a, b, c, d in zip(off, off[1:], want_off, want_off[1:])])


def decode_bytes(t: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of rows of ids."""
    start, n = t["token_first"][ids], np.diff(t["token_first"])[ids]
    return gather(t["token_bytes"], start, n), np.append(0, np.cumsum(n))[first]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, lexicon_size: int = 65536) -> DataFrame:
    """``doc_id, input_ids, n_tokens, round_trip`` for every row of ``docs``.

    Two passes over whole texts: words are counted over all of them (only counts are shuffled)
    and the frequent ones compiled; then each text's words get their ids from the
    memory-mapped lexicon, or by exact merges. ``round_trip`` says whether the decoded ids are the text.

    A NULL text has NULL ids, token count and round trip; an empty one has no ids. Ids of documents are whole numbers; NULL ids
    are returned as they are, long texts are worked on in parts, an empty table gives no rows, rows that repeat are encoded again, other columns are
    ignored. Marks of special tokens are ordinary text. The ids don't depend on which words are frequent.
    """
    name = build_lexicon(docs, text_col, vocabulary, lexicon_size)

    def run(batches):
        tables = unpack(SparkFiles.get(name))
        encoder = Encoder(tables)
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                ids, first, same = encoder.exact(part["text"])
                null = pc.is_null(part["text"])
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(ids))
                cols = [part["id"], pc.if_else(null, None, lists), pc.if_else(null, None, pa.array(np.diff(first).astype(np.int32))), pc.if_else(null, None, pa.array(same))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "input_ids", "n_tokens", "round_trip"])

    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id bigint, input_ids array<int>, n_tokens int, round_trip boolean")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "input_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` from token ids. NULL ids give NULL, none an empty text; a NULL among them stands for no token; ids that don't
    make up UTF-8 give replacement characters; an id that the vocabulary lacks is an error."""
    name = ship(encoded.sparkSession, pack(compile_vocabulary(load_ranks(vocabulary))))

    def run(batches):
        tables = unpack(SparkFiles.get(name))
        for batch in batches:
            lists = batch["ids"]
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = lists.flatten()
            real = ids.is_valid().to_numpy(zero_copy_only=False)
            n = np.bincount(np.repeat(np.arange(len(size)), size)[real], minlength=len(size))
            raw, off = decode_bytes(tables, ids.drop_null().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(n)).astype(np.int64))
            null = pc.is_null(lists).to_pylist()
            data = raw.tobytes()
            texts = [None if gone else data[a:b].decode("utf-8", "replace") for gone, a, b in zip(null, off.tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    base = encoded.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return base.mapInArrow(run, "doc_id bigint, text string")


def op4_bpe_encode(spark, sf_dir) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
