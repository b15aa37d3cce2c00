"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, shared shingles, exact verification."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texthash import Words, is_long, pieces, runs, slices

RADIUS = 11
BLOCKS, BITS = 4, 16  # by pigeonhole, of two fingerprints within ``radius`` one of four blocks is within radius // 4
COMMON = 16  # a shingle of more items than this needn't be looked up for an item whose rarer ones suffice
PROBE = 8  # fingerprints that can be compared, at least, in the time of looking up one block
PAIRS = 1 << 18  # fingerprints that are compared at once
PIECE = 1 << 19  # bytes of text that are worked on at once
ITEM_BYTES = 1 << 24  # text of the items that one scan holds
SCHEMA = "doc_id bigint, item_id bigint, start_word int, end_word int, distance int, similarity double"
_made: dict[str, ItemIndex] = {}  # of the scan that this worker is at


def bit_sums(h: np.ndarray, kind: type) -> np.ndarray:
    """(words + 1, 64): running sums of +1 and -1 for the bits of the word hashes, which may
    wrap around: differences over windows that ``kind`` can count are right all the same."""
    out = np.zeros((len(h) + 1, 64), dtype=kind)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.int8)
    bits += bits
    bits -= 1
    np.cumsum(bits, axis=0, dtype=kind, out=out[1:])
    return out


def simhash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows of words start..end."""
    return np.packbits(sums[end] - sums[start] > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def sum_kind(longest: int) -> type:
    return np.int8 if longest < 128 else np.int16 if longest < 1 << 15 else np.int32


def flips(most: int) -> np.ndarray:
    """All 16-bit numbers with ``most`` bits or fewer."""
    return np.array([sum(1 << b for b in own) for n in range(most + 1) for own in combinations(range(BITS), n)], dtype=np.int64)


def known_shingles(words: Words, k: int) -> list[Counter]:
    """The ``k``-word runs of each row with their counts; of a shorter row the one run of all its words."""
    out = []
    for a, b in zip(words.first, words.first[1:]):
        h = words.hash[a:b]
        out.append(Counter(runs(h, np.zeros(len(h), np.int64), min(k, len(h)))[1].tolist()) if len(h) else Counter())
    return out


class ItemIndex:
    """Some items: their word hashes, shingle weights, the items by shingle, and the fingerprint
    of each item, found by any of four 16-bit blocks.

    ``df``: in how many of all ``total`` items each shingle is, where these are only some of them."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, threshold: float = 0.6, radius: int = RADIUS, df: dict[int, int] | None = None, total: int | None = None):
        words = Words(pa.array([t for _, t in items], pa.string()))
        self.shingle, self.threshold, self.radius = shingle, threshold, radius
        self.ids = [i for i, _ in items]
        self.words = [words.hash[a:b] for a, b in zip(words.first, words.first[1:])]
        sets = known_shingles(words, shingle)
        df = df or Counter(s for c in sets for s in c)
        self.weights = {s: math.log(1 + (total or len(items)) / df[s]) for c in sets for s in c}
        self.counts, self.total = sets, [sum(n * self.weights[s] for s, n in c.items()) for c in sets]
        self.known = np.array(sorted(self.weights), dtype=np.uint64)
        self.weight = np.array([self.weights[s] for s in self.known.tolist()], dtype=float)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        # shingles of some item that a stretch must have at least before it can reach the threshold, by item
        heaviest = [max((self.weights[s] for s in c), default=1.0) for c in sets]
        self.least = np.array([max(1, math.ceil(threshold * t / h - 1e-9)) if len(w) else 0 for t, h, w in zip(self.total, heaviest, self.words)], dtype=np.int64)
        self.kind = sum_kind(int(self.size.max(initial=0)))
        self.print = np.array([simhash(bit_sums(w, self.kind), [0], [len(w)])[0] for w in self.words], dtype=np.uint64)
        self.sizes = sorted({len(w) for w in self.words if len(w)})
        self.size_least = {n: int(self.least[self.size == n].min()) for n in self.sizes}
        own = np.flatnonzero(self.size > 0)
        self.near_bits = flips(radius // BLOCKS)
        self.of_size = {n: np.flatnonzero(self.size == n) for n in self.sizes}
        self.tables = []
        for b in range(BLOCKS):
            key = self.size[own] << BITS | self._block(self.print[own], b)
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], own[order]))
        self._post(df)

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(BITS * b)) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    def _post(self, df: dict[int, int]) -> None:
        """Items by shingle. A stretch that reaches the threshold has at least ``need`` of the weight that is
        posted for an item: all of it, or without its commonest shingles, of half the threshold at most."""
        self.need, place, who = np.zeros(len(self.ids)), [], []
        self.own: list[tuple[np.ndarray, list[int]]] = []
        for k, c in enumerate(self.counts):
            grams = np.array(sorted(c), dtype=np.uint64)
            self.own.append((np.searchsorted(self.known, grams), [c[s] for s in grams.tolist()]))
            if len(self.words[k]) < self.shingle:
                continue
            left_out = 0.0
            for s in sorted(c, key=lambda s: (-df[s], s)):
                more = left_out + c[s] * self.weights[s]
                if df[s] > COMMON and more < self.threshold * self.total[k] / 2:
                    left_out = more
                else:
                    place.append(s)
                    who.append(k)
            self.need[k] = self.threshold * self.total[k] - left_out
        place = np.searchsorted(self.known, np.array(place, dtype=np.uint64))
        self.posted = np.array(who, dtype=np.int64)[np.argsort(place, kind="stable")]
        self.first_posted = np.searchsorted(np.sort(place), np.arange(len(self.known) + 1))

    def sharing(self, at: np.ndarray, gram: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) of all rows that may hold a stretch of the item's length with the threshold's share of its
        weight. ``at``, ``gram``: places of known shingles, ascending, and which; none that reaches it is left out."""
        n = self.first_posted[gram + 1] - self.first_posted[gram]
        pos, weight = np.repeat(at, n), np.repeat(self.weight[gram], n)
        item = self.posted[np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first_posted[gram], n)]
        key = item * (len(doc) + int(self.size.max(initial=0)) + 1) + pos
        order = np.argsort(key, kind="stable")
        key, pos, item = key[order], pos[order], item[order]
        sums = np.append(0.0, np.cumsum(weight[order]))
        end = np.searchsorted(key, key + self.size[item] - self.shingle + 1)
        ok = sums[end] - sums[:-1] >= self.need[item] - 1e-6
        return [divmod(x, len(self.ids)) for x in np.unique(doc[pos[ok]] * len(self.ids) + item[ok]).tolist()]

    def place(self, k: int, at: np.ndarray, gram: np.ndarray, first: int) -> int:
        """Start of the first of the stretches of item ``k``'s length that have most of its weight, in a row that
        starts at word ``first`` and has known shingles ``gram`` at ``at``: a window slides over those of the item."""
        own, most = self.own[k]
        which = np.searchsorted(own, gram)
        mine = np.flatnonzero(own[np.minimum(which, len(own) - 1)] == gram)
        at, which, weight = at[mine].tolist(), which[mine].tolist(), self.weight[own].tolist()
        span, have, now, end = int(self.size[k]) - self.shingle, [0] * len(own), 0.0, 0
        best, start = -1.0, first
        for p, g in zip(at, which):
            while end < len(at) and at[end] <= p + span:
                h = which[end]
                now += weight[h] * (have[h] < most[h])
                have[h] += 1
                end += 1
            if now > best + 1e-9:
                # the last of its shingles that counts may as well be the stretch's end
                last, surplus = end - 1, dict[int, int]()
                while have[which[last]] - surplus.get(which[last], 0) > most[which[last]]:
                    surplus[which[last]] = surplus.get(which[last], 0) + 1
                    last -= 1
                best, start = now, max(first, at[last] - span)
            now -= weight[g] * (have[g] <= most[g])
            have[g] -= 1
        return start

    def near(self, size: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """(window, item, distance) of all pairs of a window and an item of its size within the radius.
        Windows of a size that few items have are compared with each of these, which finds the same sooner."""
        found, few = [np.zeros((0, 3), dtype=np.int64)], PROBE * BLOCKS * len(self.near_bits)
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for win in np.split(order, cuts) if len(order) else ():
            own = self.of_size.get(int(size[win[0]]), ())
            if len(own) > few:
                found.append(self._probed(win, size[win], prints[win]))
            elif len(own):
                step = max(1, PAIRS // len(own))
                for part in (win[lo : lo + step] for lo in range(0, len(win), step)):
                    distance = np.bitwise_count(prints[part][:, None] ^ self.print[own])
                    w, i = np.nonzero(distance <= self.radius)
                    found.append(np.stack([part[w], own[i], distance[w, i]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def _probed(self, window: np.ndarray, size: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """near() of these windows by looking up all neighbours of their blocks; a pair may come more than once."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        for b, (keys, who) in enumerate(self.tables):
            probes = ((size << BITS | self._block(prints, b))[:, None] ^ self.near_bits).reshape(-1)
            first = np.searchsorted(keys, probes, side="left")
            hit = np.flatnonzero((first < len(keys)) & (keys[np.minimum(first, len(keys) - 1)] == probes))
            n = np.searchsorted(keys, probes[hit], side="right") - first[hit]
            win = np.repeat(hit // len(self.near_bits), n)
            item = who[np.arange(len(win)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[hit], n)]
            distance = np.bitwise_count(prints[win] ^ self.print[item])
            ok = distance <= self.radius
            found.append(np.stack([window[win[ok]], item[ok], distance[ok]], axis=1))
        return np.concatenate(found)

    def _shingles(self, h: np.ndarray) -> np.ndarray:
        k = min(self.shingle, len(h))
        return runs(h, np.zeros(len(h), np.int64), k)[1] if k else h

    def similarity(self, k: int, h: np.ndarray) -> float:
        """Share of the item's shingle weight that the words ``h`` hold."""
        have = Counter(self._shingles(h).tolist())
        return sum(min(n, have.get(s, 0)) * self.weights[s] for s, n in self.counts[k].items()) / self.total[k]

    def _shared(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those of ``grams`` that some item has, and which they are."""
        gram = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hit = np.flatnonzero(self.known[gram] == grams)
        return hit, gram[hit]

    def windows(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the item-sized windows, at every word, that some item of that size may match: they have as many
        known shingles (which begin at ``at``) as such a match needs. The others can't pass at any distance."""
        starts, sizes, n = [], [], len(words.hash)
        known = np.zeros(n + 1, dtype=np.int32)
        known[at + 1] = 1
        np.cumsum(known, out=known)
        for size in self.sizes:
            if n < size:
                break
            if size < self.shingle:
                spot, grams = words.runs(size)
                begin = spot[self._shared(grams)[0]]
            else:
                span = size - self.shingle + 1
                begin = np.flatnonzero(known[span : n - self.shingle + 2] - known[: n - size + 1] >= self.size_least[size])
                begin = begin[words.doc[begin] == words.doc[begin + size - 1]]
            starts.append(begin)
            sizes.append(np.full(len(begin), size))
        return (np.concatenate(starts), np.concatenate(sizes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def similar(self, words: Words) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, distance) of the candidates of both searches; start and end are words of the slice."""
        if not len(self.known):
            return []
        spot, grams = words.runs(self.shingle)
        hit, gram = self._shared(grams)
        at = spot[hit]
        start, size = self.windows(words, at)
        out = []
        if len(start):
            # only rows with such windows are summed up
            used = np.zeros(len(words.first) - 1, dtype=bool)
            used[words.doc[start]] = True
            own = used[words.doc]
            moved = np.cumsum(own) - 1
            sums = bit_sums(words.hash[own], self.kind)
            for lo in range(0, len(start), 1 << 14):
                s, n = start[lo : lo + (1 << 14)], size[lo : lo + (1 << 14)]
                win, item, distance = self.near(n, simhash(sums, moved[s], moved[s] + n)).T
                out += zip(words.doc[s[win]].tolist(), item.tolist(), s[win].tolist(), (s[win] + n[win]).tolist(), distance.tolist())
        for r, k in self.sharing(at, gram, words.doc) if len(at) else ():
            first, last = int(words.first[r]), int(words.first[r + 1])
            x, y = np.searchsorted(at, (first, last))
            a = self.place(k, at[x:y], gram[x:y], first)
            b = min(a + int(self.size[k]), last)
            sums = bit_sums(words.hash[a:b], self.kind)
            out.append((r, k, a, b, int(np.bitwise_count(simhash(sums, [0], [b - a])[0] ^ self.print[k]))))
        return out

    def find(self, texts: pa.Array) -> dict[tuple[int, int | None], tuple]:
        """{(row, item id): (-similarity, start, end, distance)}, the best place of each item in each text."""
        if is_long(texts, PIECE):
            best: dict[tuple[int, int | None], tuple] = {}
            for part, word, last in pieces(texts, PIECE, int(self.size.max(initial=0)) + self.shingle):
                for key, (s, a, b, d) in self._find(part, whole=last).items():
                    now = (s, a + word, b + word, d)
                    best[key] = min(best.get(key, now), now)
            return best
        return self._find(texts)

    def _find(self, texts: pa.Array, whole: bool = True) -> dict[tuple[int, int | None], tuple]:
        words, best, tried = Words(texts), {}, {}
        for r, k, a, b, d in self.similar(words):
            if not whole and a + self.size[k] > len(words.hash):
                continue  # the next piece has all of it
            if (k, a, b) not in tried:
                tried[k, a, b] = self.similarity(k, words.hash[a:b])
            if (share := tried[k, a, b]) >= self.threshold:
                key, first = (r, self.ids[k]), int(words.first[r])
                now = (-share, a - first, b - first, d)
                best[key] = min(best.get(key, now), now)
        return best


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: float = 0.6, radius: int = RADIUS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row for each item that a document holds: ``doc_id, item_id, start_word, end_word, distance, similarity``.

    Windows of each item's size slide over every word of every document. Those that have enough of the benchmark's
    shingles to reach the threshold at all (the others can't, whatever their distance) get a 64-bit SimHash over their words,
    from differences of running sums. All items of the window's size within Hamming distance ``radius`` are found: by comparing
    their fingerprints, or if many have that size by multi-index search over four 16-bit blocks, each within ``radius`` // 4 bits. Passages edited more than that, or with words put in or
    left out, are found by the shingles that they share
    with an item: for each document and item that may reach the threshold by them, the stretch with the greatest share.
    The stretch of the item's length is verified: the share of the item's
    weighted ``shingle``-word runs that it has, rare ones (over the whole benchmark) weighing
    more, must reach ``threshold``. All documents that have such a stretch are found. The most similar place
    is reported, ties by the first; ``distance`` is that of the window or stretch and the item.

    Items without words have no match, nor has an item in a document too short for the threshold; items that
    repeat, or share an id, are each compared, and an id is reported once for a document row.
    NULL and empty texts give no rows, NULL ids of documents are returned as they are, items
    with NULL id are reported with it. Ids are whole numbers. Very long texts are worked on in overlapping pieces. Other columns are ignored. Items of up to
    ``item_bytes`` of text are one list that all tasks hold, built once in each worker; a larger benchmark is
    held against the documents part by part. Documents are scanned once for each part, without a shuffle.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text <> ''")

    def scan(find):
        def run(batches):
            for batch in batches:
                for part in slices(batch, "text", PIECE):
                    ids = part["doc_id"].to_pylist()
                    rows = [(ids[r], i, lo, hi, d, round(-s, 6)) for (r, i), (s, lo, hi, d) in find(part["text"]).items()]
                    cols = list(zip(*rows)) or [()] * 6
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "start_word", "end_word", "distance", "similarity"])

        return run

    out = None
    for find in _finders(benchmark, shingle, threshold, radius, item_bytes):
        found = base.mapInArrow(scan(find), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def _finders(benchmark: DataFrame, shingle: int, threshold: float, radius: int, item_bytes: int) -> list:
    """Functions that tasks call with an array of texts, one for each part of the benchmark; see ItemIndex.find.
    Items that share an id are in one part, and so are equal texts' shares: weights are those of the whole benchmark."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    size, total = items.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = max(1, math.ceil((size or 0) / item_bytes))
    if parts == 1:
        return [_finder(benchmark.sparkSession, items.collect(), shingle, threshold, radius)]
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))

    def count(batches):
        for batch in batches:
            for cut in slices(batch, "text", PIECE):
                part, sets = cut["part"].to_pylist(), known_shingles(Words(cut["text"]), shingle)
                rows = [(p, np.uint64(s).astype(np.int64).item()) for p, c in zip(part, sets) for s in c]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["part", "gram"])

    grams = items.select("part", "text").mapInArrow(count, "part bigint, gram bigint")
    shares = grams.distinct().join(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram")
    out = []
    for part in range(parts):
        df = {r["gram"] % (1 << 64): r["n"] for r in shares.where(F.col("part") == part).select("gram", "n").collect()}
        own = items.where(F.col("part") == part).select("item_id", "text").collect()
        out.append(_finder(benchmark.sparkSession, own, shingle, threshold, radius, df, total))
    return out


def _finder(spark, items: list, shingle: int, threshold: float, radius: int, df: dict[int, int] | None = None, total: int | None = None):
    items = sorted(((r[0], r[1]) for r in items), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    shared, key = spark.sparkContext.broadcast((items, df)), uuid.uuid4().hex

    def find(texts: pa.Array) -> dict[tuple[int, int | None], tuple]:
        return _index(key, shared, shingle, threshold, radius, total).find(texts)

    return find


def _index(key: str, shared, shingle: int, threshold: float, radius: int, total: int | None) -> ItemIndex:
    """The index of a list of items, made by the first of a worker's tasks."""
    if key not in _made:
        if len(_made) >= 4:  # parts of one benchmark may take turns
            _made.pop(next(iter(_made)))
        items, df = shared.value
        _made[key] = ItemIndex(items, shingle, threshold, radius, df, total)
    return _made[key]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", shingle: int = 3, threshold: float = 0.6, radius: int = RADIUS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds an item as benchmark_leaks says, whatever their ids:
    nothing is shuffled. NULL and empty texts stay."""
    names = docs.columns
    wide = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, kinds = f"c{names.index(text_col)}", wide.schema

    def clean(find):
        def run(batches):
            for batch in batches:
                for part in slices(batch, text, PIECE):
                    ok = np.ones(part.num_rows, dtype=bool)
                    ok[[row for row, _ in find(part[text])]] = False
                    yield part.filter(pa.array(ok))

        return run

    for find in _finders(benchmark, shingle, threshold, radius, item_bytes):
        wide = wide.mapInArrow(clean(find), kinds)
    return wide.toDF(*names)


def op8_decontaminate(spark, sf_dir) -> DataFrame:
    return benchmark_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
