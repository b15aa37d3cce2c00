"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .texthash import Words, byte_sums, flat, is_long, mix, part_hashes, pieces, slices

HEADS = ("quality", "toxic")
TEXT_BITS, META_BITS = 18, 16
BITS = (TEXT_BITS, META_BITS)
LEAST_Z = (3.5, 2.5)  # a slot must tell the classes apart this well to have a weight in its view
PIECE = 1 << 19
_CLASS = np.full(256, 4, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 symbol, 5 newline
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 13]], _CLASS[10] = 1, 2, 3, 5
_TOTAL = (1 << 20) - 1  # stands for all rows where slots are counted


def _slot(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def _word_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(words, 5) slots: each word, its first four and five bytes,
    the two bytes after it together with whether it is in capitals, and whether it is the
    second or a later one of equal words in a row; and whether it repeats the word before."""
    raw = np.concatenate([w.raw, np.zeros(2, np.uint8)])
    s, e = w.start, w.end
    last = w.off[w.doc + 1] if len(s) else e
    tail = np.where(e < last, raw[e], 0).astype(np.uint64) | np.where(e + 1 < last, raw[e + 1], 0).astype(np.uint64) << np.uint64(8)
    capital = (raw[s] >= 65) & (raw[s] <= 90) & (raw[np.minimum(s + 1, e - 1)] >= 65) & (raw[np.minimum(s + 1, e - 1)] <= 90) & (e - s > 1)
    tail |= capital.astype(np.uint64) << np.uint64(16)
    again = echoes(w)
    third = again & np.append(False, again[:-1])
    parts = [w.hash, w.part(s, np.minimum(s + 4, e)), w.part(s, np.minimum(s + 5, e)), tail, again.astype(np.uint64) + third]
    return np.stack([_slot(h, no + 1, TEXT_BITS) for no, h in enumerate(parts)], axis=1), again


def echoes(w: Words) -> np.ndarray:
    """Whether each word equals the one before it in its text."""
    out = np.zeros(len(w.hash), dtype=bool)
    out[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    return out


def _shape(counts: np.ndarray, words: np.ndarray, again: np.ndarray) -> np.ndarray:
    """(rows, 7) slots: the shape of the text in buckets. ``counts``: bytes of each class."""
    n, words = np.maximum(counts.sum(axis=1), 1), np.maximum(words, 1)
    share = counts / n[:, None]
    lines = np.minimum(np.floor(2 * np.log2(n / (counts[:, 5] + 1) + 1)), 40)
    cols = [np.floor(40 * share[:, 4]), np.floor(20 * share[:, 1]), np.floor(20 * share[:, 2]), lines, np.floor(2 * (n - counts[:, 3]) / words).clip(0, 60), np.floor(np.log2(words)), np.ceil(20 * again / words)]
    return np.stack([_slot((c + 2).astype(np.uint64), 18 + no, TEXT_BITS) for no, c in enumerate(cols)], axis=1)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) pairs of the text view, sorted, each once: of its words and of its shape. A long text is worked on in pieces."""
    rows = len(texts)
    if is_long(texts, PIECE):
        keys, words, again = np.zeros(0, np.int64), 0, 0
        raw, _ = flat(texts)
        counts = sum(np.bincount(_CLASS[raw[at : at + PIECE]], minlength=6) for at in range(0, len(raw), PIECE))[None, :]
        for piece, first, last in pieces(texts, PIECE, 3, lower=False):
            w = Words(piece, keep_case=True)
            slots, echo = _word_features(w)
            # what a word's features look at is in the piece but for its last word and, unless it is the first, its first two
            own = slice(2 if first else 0, None if last else -1)
            keys = np.union1d(keys, slots[own])
            words, again = words + len(slots[own]), again + int(echo[own].sum())
        words, again = np.array([words]), np.array([again])
    else:
        w = Words(texts, keep_case=True)
        slots, echo = _word_features(w)
        keys = np.unique(slots + (w.doc << TEXT_BITS)[:, None])
        counts = np.bincount(np.repeat(np.arange(rows), np.diff(w.off)) * 6 + _CLASS[w.raw], minlength=rows * 6).reshape(rows, 6)
        words, again = np.diff(w.first), np.bincount(w.doc[echo], minlength=rows)
    keys = np.union1d(keys, _shape(counts, words, again) + (np.arange(rows) << TEXT_BITS)[:, None])
    return keys >> TEXT_BITS, keys & ((1 << TEXT_BITS) - 1)


def meta_features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) pairs of the page view: language, source, host, size, and pairs of them. Nothing of it comes from the text."""
    rows = part.num_rows
    chars = part["n_chars"].to_numpy(zero_copy_only=False).astype(float)
    bad = np.isnan(chars) | (chars < 0)
    size = np.log2(np.maximum(np.where(bad, 1, chars), 1))
    fine, rough = (np.where(bad, 0, np.floor(size * k) + 1).astype(np.uint64) for k in (4, 1))
    lang, source, host = (_names(part[name]) for name in ("lang", "source", "host"))
    codes = [lang, source, host, fine, mix(lang) + source, mix(source) + rough, mix(lang) + rough]
    slots = np.stack([_slot(c, 40 + no, META_BITS) for no, c in enumerate(codes)], axis=1)
    keys = np.unique(slots + (np.arange(rows) << META_BITS)[:, None])
    return keys >> META_BITS, keys & ((1 << META_BITS) - 1)


def features(part: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) pairs of both views."""
    return [text_features(part["text"]), meta_features(part)]


def _names(values: pa.Array) -> np.ndarray:
    coded = pc.fill_null(values, "\0").dictionary_encode()
    raw, off = flat(coded.dictionary)
    own = part_hashes(byte_sums(raw), off[:-1], off[1:])
    return own[coded.indices.to_numpy()] if len(own) else np.zeros(len(values), np.uint64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(row: np.ndarray, col: np.ndarray, n_cols: int, y: np.ndarray, l2: float, dense: np.ndarray, steps: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of 0/1 features, weights of the columns of ``dense`` and bias of a logistic regression, by Adam on all rows, from
    weights and bias ``start`` on."""
    n, own = len(y), n_cols + dense.shape[1]
    w, m, v = (np.zeros(own + 1) for _ in range(3))
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    if start is not None:
        w[:n_cols], w[-1] = start[:-1], start[-1]
    for t in range(1, steps + 1):
        p = sigmoid(np.bincount(row, w[col], minlength=n) + dense @ w[n_cols:own] + w[-1])
        g = np.concatenate([np.bincount(col, (p - y)[row], minlength=n_cols), dense.T @ (p - y), [(p - y).sum()]]) / n + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n_cols], w[n_cols:own], float(w[-1])


def platt(scores: np.ndarray, y: np.ndarray, stands_for: np.ndarray) -> np.ndarray:
    """Weights and bias that turn columns of scores into a calibrated log odds (ridge Newton steps).
    ``stands_for``: how many rows each row was drawn from. Within a class it weighs the rows; between
    the classes it moves the bias, so that a rare class isn't lost to the ridge."""
    mean = np.array([stands_for[y == c].mean() if (y == c).any() else 1.0 for c in (0, 1)])
    weight = stands_for / mean[y.astype(int)]
    x = np.column_stack([scores, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (len(w) - 1) + [0.01])
    for _ in range(30):
        p = sigmoid(x @ w)
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
    w[-1] += np.log(mean[1] / mean[0])
    return w


@dataclass
class View:
    """A linear model on 0/1 slots of one view; zero weight for slots that tell nothing."""

    bits: int
    weights: np.ndarray = field(default=None)
    bias: float = 0.0

    def fit(self, row: np.ndarray, col: np.ndarray, y: np.ndarray, z_least: float, taught: np.ndarray | None = None, start: View | None = None) -> View:
        """On labelled rows, from the same view without lessons (``start``) on, if there is one. ``taught``: a weight for each slot that the other view's pseudo-labels gave; their sum is a
        feature of its own, so the labels decide how far it is trusted."""
        n1, n = y.sum(), len(y)
        size = 1 << self.bits
        chosen = np.flatnonzero(telling(np.bincount(col, y[row], minlength=size), np.bincount(col, minlength=size), n1, n, z_least))
        place = np.full(size, -1)
        place[chosen] = np.arange(len(chosen))
        ok = place[col] >= 0
        dense, scale = np.zeros((n, 0)), 1.0
        if taught is not None:
            lean = np.bincount(row, taught[col], minlength=n)
            scale = float(lean.std()) or 1.0
            dense = (lean / scale)[:, None]
        begin = np.append(start.weights[chosen], start.bias) if start else None
        w, trust, self.bias = logistic(row[ok], place[col[ok]], len(chosen), y, 1e-4, dense, 400 if start is None else 150, begin)
        self.weights = np.zeros(size, dtype=np.float32)
        self.weights[chosen] = w
        if taught is not None:
            self.weights += (taught * (trust[0] / scale)).astype(np.float32)
        return self

    def scores(self, row: np.ndarray, col: np.ndarray, rows: int) -> np.ndarray:
        """Log odds from (row, slot) pairs, each given once."""
        return np.bincount(row, self.weights[col], minlength=rows) + self.bias


def telling(df1: np.ndarray, df: np.ndarray, n1: float, n: float, z_least: float, df_least: int = 4) -> np.ndarray:
    """Which slots, that ``df`` of ``n`` rows and ``df1`` of the ``n1`` rows of class 1 have, tell the classes apart."""
    share = df / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / max(n1, 1) + 1 / max(n - n1, 1)))
    return (np.abs(df1 / max(n1, 1) - (df - df1) / max(n - n1, 1)) / spread >= z_least) & (df >= df_least)


@dataclass
class Head:
    """The views of one target (None for one that doesn't count) and their calibrated combination; constant without views."""

    views: list[View | None]
    blend: np.ndarray
    constant: float | None = None

    def score(self, sides: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(rows, self.constant)
        x = np.column_stack([v.scores(*side, rows) for v, side in zip(self.views, sides) if v] + [np.ones(rows)])
        return sigmoid(x @ self.blend)


def _rows_of(first: np.ndarray, flat: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = first[chosen + 1] - first[chosen]
    at = np.arange(n.sum(), dtype=np.int32)
    at += np.repeat((first[chosen] - np.cumsum(n) + n).astype(np.int32), n)
    return np.repeat(np.arange(len(chosen), dtype=np.int32), n), flat[at]


class Learner:
    """Co-training of one target. ``sides``: (first, slots) of each view for the labelled sample; ``y``: 0, 1 or -1
    (no such label). A fifth of each class is held out and calibrates. ``stands_for``: how many labelled rows each was
    drawn from, 1 by default; probabilities are those of all of these."""

    def __init__(self, sides: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, default: float, stands_for: np.ndarray | None = None):
        labelled = np.flatnonzero(y >= 0)
        self.sides, self.y = sides, y
        self.stands_for = np.ones(len(y)) if stands_for is None else stands_for
        self.constant = None
        if len(np.unique(y[labelled])) < 2 or min(np.bincount(y[labelled])) < 5:
            self.constant = float(np.average(y[labelled], weights=self.stands_for[labelled])) if len(labelled) else default
        mixed = np.random.default_rng(7).permutation(labelled)
        held = np.zeros(len(y), dtype=bool)
        for c in (0, 1):
            own = mixed[y[mixed] == c]
            held[own[: max(1, len(own) // 5)]] = True
        self.train, self.test = labelled[~held[labelled]], labelled[held[labelled]]
        self.views: list[View] = []
        self.alone: list[View] = []  # the views that the labels alone teach

    def fit(self, taught: list[np.ndarray | None]) -> None:
        """Fit both views to the labels and to what each was taught by the other."""
        if self.constant is None:
            y = self.y[self.train].astype(float)
            if not self.alone:
                self.alone = [View(bits).fit(*_rows_of(*side, self.train), y, z) for bits, side, z in zip(BITS, self.sides, LEAST_Z)]
            self.views = [first if own is None else View(first.bits).fit(*_rows_of(*side, self.train), y, z, own, first) for first, side, z, own in zip(self.alone, self.sides, LEAST_Z, taught)]

    def _held_out(self) -> np.ndarray:
        return np.column_stack([v.scores(*_rows_of(*side, self.test), len(self.test)) for v, side in zip(self.views, self.sides)])

    def teachers(self) -> list[Head]:
        """Each view by itself, calibrated."""
        scores, y = self._held_out(), self.y[self.test].astype(float)
        return [Head([v if i == own else None for i, v in enumerate(self.views)], platt(scores[:, [own]], y, self.stands_for[self.test])) for own in (0, 1)]

    def head(self) -> Head:
        if self.constant is not None:
            return Head([], np.zeros(0), self.constant)
        return Head(self.views, platt(self._held_out(), self.y[self.test].astype(float), self.stands_for[self.test]))


def count_sure(sides: list[tuple[np.ndarray, np.ndarray]], rows: int, teachers: list[Head], sure: float, counts: list[np.ndarray]) -> None:
    """Add what each teacher is sure of to the other view's counts: (2, slots + 1), rows of class 0 and 1 by slot, and all of them last."""
    for v, teacher in enumerate(teachers):
        p = teacher.score(sides, rows)
        row, col = sides[1 - v]
        for label, trust in ((0, 1 - p), (1, p)):
            chosen = trust >= sure
            own = counts[1 - v][label]
            own[:-1] += np.bincount(col[chosen[row]], minlength=len(own) - 1)
            own[-1] += chosen.sum()


def lessons(counts: np.ndarray, z_least: float) -> np.ndarray | None:
    """Log odds of the slots from counts of pseudo-labelled rows; None where a class has none to speak of."""
    (n0, n1), df = counts[:, -1], counts[:, :-1].sum(axis=0)
    if min(n0, n1) < 5:
        return None
    odds = np.log((counts[1, :-1] + 0.5) / (n1 + 1)) - np.log((counts[0, :-1] + 0.5) / (n0 + 1))
    return np.where(telling(counts[1, :-1], df, n1, n0 + n1, z_least), odds, 0.0)


def _prepare(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *_meta(docs))


def _meta(docs: DataFrame) -> list:
    """The page's metadata, NULL where ``docs`` has no such column; its host is ``domain`` or that of ``url``."""
    have = set(docs.columns)
    out = [(F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)).alias(c) for c, kind in (("lang", "string"), ("source", "string"), ("n_chars", "bigint"))]
    hosts = [F.col("domain").cast("string")] if "domain" in have else []
    hosts += [F.try_parse_url(F.col("url").cast("string"), F.lit("HOST"))] if "url" in have else []
    return [*out, (F.coalesce(*hosts) if hosts else F.lit(None).cast("string")).alias("host")]


def _exchange(base: DataFrame, learners: dict[str, Learner], apart: np.ndarray, sure: float) -> dict[str, list[np.ndarray | None]]:
    """One pass over all documents but the labelled sample's (ids ``apart``): what each view is sure of is counted by the
    slots of the other view. Counts alone are shuffled and collected: a row a slot, however many documents there are."""
    names = [h for h in HEADS if learners[h].constant is None]
    shared = base.sparkSession.sparkContext.broadcast(({h: [_plain(t) for t in learners[h].teachers()] for h in names}, apart))

    def count(batches):
        plain, known = shared.value
        teachers = {h: [_head(t) for t in own] for h, own in plain.items()}
        counts = {h: [np.zeros((2, (1 << bits) + 1), dtype=np.int64) for bits in BITS] for h in plain}
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                mine = np.isin(pc.fill_null(part["id"], 0).to_numpy(zero_copy_only=False), known) & part["id"].is_valid().to_numpy(zero_copy_only=False)
                part = part.filter(pa.array(~mine))
                sides = features(part)
                for h, own in teachers.items():
                    count_sure(sides, part.num_rows, own, sure, counts[h])
        for no, (h, own) in enumerate(counts.items()):
            for v, table in enumerate(own):
                slot = np.flatnonzero(table.any(axis=0))
                code = np.where(slot == table.shape[1] - 1, _TOTAL, slot) + ((2 * no + v) << 20)
                yield pa.RecordBatch.from_arrays([pa.array(code), *(pa.array(table[c, slot]) for c in (0, 1))], names=["code", "n0", "n1"])

    summed = base.mapInArrow(count, "code bigint, n0 bigint, n1 bigint").groupBy("code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    code, n0, n1 = (summed[c].to_numpy() for c in ("code", "n0", "n1"))
    out: dict[str, list[np.ndarray | None]] = {h: [None, None] for h in HEADS}
    for no, h in enumerate(names):
        for v, bits in enumerate(BITS):
            own = code >> 20 == 2 * no + v
            slot = np.where(code[own] & _TOTAL == _TOTAL, 1 << bits, code[own] & _TOTAL)
            table = np.zeros((2, (1 << bits) + 1))
            table[0, slot], table[1, slot] = n0[own], n1[own]
            out[h][v] = lessons(table, LEAST_Z[v])
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 8000, rounds: int = 2, sure: float = 0.97) -> dict[str, Head]:
    """The two heads. At most ``max_labelled`` labelled documents, those with the least hash of their id, are the
    labelled sample; their features
    alone (some KB each) are collected. They are taken for each pair of labels by itself, as many
    of each or all there are, so that those of a rare class all take part; the calibration
    corrects for it. Of several labels for one id the worst counts, of several rows with one id
    the one with the least hash.

    In each of ``rounds`` rounds each view, calibrated by labels held out, labels all other documents of the corpus in one distributed pass.
    All that it takes for a class with a probability of ``sure`` or more are counted by the other view's features, whose log odds that
    view learns from next. Documents with labels beyond the sample take part as documents without.

    NULL labels count as none, labels of ids that no document has are left out; NULL ids and NULL or empty texts take part in the
    rounds like all others. Without labels, or without documents, heads are constant (see score_documents)."""
    worst = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    every = _prepare(docs, id_col, text_col)
    base = every.where("id is not null")
    present = worst.join(base.select("id"), "id", "left_semi")
    there = {(r["quality"], r["toxic"]): r["count"] for r in present.groupBy("quality", "toxic").count().collect()}
    most = _even(list(there.values()), max_labelled)
    # a cut of the hashes, which are uniform, leaves little more than ``most`` of each pair to be ranked
    cut = F.lit(float("inf"))
    for (q, t), n in there.items():
        if n > most:
            cut = F.when(F.col("quality").eqNullSafe(F.lit(q)) & F.col("toxic").eqNullSafe(F.lit(t)), F.lit(-(2.0**63) + 2.0**64 * min(1.0, (1.2 * most + 200) / n))).otherwise(cut)
    ranked = Window.partitionBy("quality", "toxic").orderBy("hash", "id")
    wanted = present.withColumn("hash", F.xxhash64("id")).where(F.col("hash") <= cut).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most).select("id", "quality", "toxic")
    # bounded by max_labelled rows of 16 bytes; of rows that repeat an id, the one with the least hash takes part,
    # which is chosen by hashes alone, so that texts are shuffled only where they are that one
    own_hash = F.xxhash64("text", "lang", "source", "n_chars", "host")
    least = base.join(F.broadcast(wanted), "id").groupBy("id").agg(F.min(own_hash).alias("hash"))
    one = base.join(F.broadcast(wanted.join(least, "id")), "id").where(own_hash == F.col("hash")).dropDuplicates(["id"])
    sample = one.select("id", "text", "lang", "source", "n_chars", "host", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))

    def featurise(batches):
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)), pa.array(col.astype(np.int32))) for row, col in features(part)]
                yield pa.RecordBatch.from_arrays([part["id"], part["quality"], part["toxic"], *lists], names=["id", "quality", "toxic", "words", "page"])

    table = sample.mapInArrow(featurise, "id bigint, quality int, toxic int, words array<int>, page array<int>").toArrow().combine_chunks()
    table = table.sort_by("id")
    sides = []
    for name in ("words", "page"):
        lists = table[name].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
        sides.append((lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)))
    order = {"quality": 1.0, "toxic": 0.0}
    y = {h: table[h].to_numpy().astype(np.int64) for h in HEADS}
    stands_for = np.ones(table.num_rows)
    for pair, n in there.items():
        own = np.all([y[h] == (-1 if v is None else v) for h, v in zip(HEADS, pair)], axis=0)
        if n > most and own.any():
            stands_for[own] = n / own.sum()
    learners = {h: Learner(sides, y[h], order[h], stands_for) for h in HEADS}
    taught: dict[str, list[np.ndarray | None]] = {h: [None, None] for h in HEADS}
    for no in range(rounds + 1):
        for h in HEADS:
            learners[h].fit(taught[h])
        if no < rounds and any(x.constant is None for x in learners.values()):
            taught = _exchange(every, learners, table["id"].to_numpy(), sure)
    return {h: x.head() for h, x in learners.items()}


def _even(sizes: list[int], most: int) -> int:
    """The number up to which groups of ``sizes`` are taken so that no more than ``most`` are taken in all."""
    left, groups = most, len(sizes)
    for n in sorted(sizes):
        if n * groups > left:
            return left // groups
        left, groups = left - n, groups - 1
    return max(sizes, default=0)


def _plain(head: Head) -> tuple:
    return [v and (v.bits, v.weights, v.bias) for v in head.views], head.blend, head.constant


def _head(plain: tuple) -> Head:
    return Head([v and View(*v) for v in plain[0]], *plain[1:])


def _scorer(docs: DataFrame, heads: dict[str, Head]):
    # some MB, of fixed size
    shared = docs.sparkSession.sparkContext.broadcast({h: _plain(x) for h, x in heads.items()})

    def score(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        sides = features(part)
        return tuple(_head(shared.value[h]).score(sides, part.num_rows) for h in HEADS)

    return score


def score_documents(docs: DataFrame, heads: dict[str, Head], id_col: str = "doc_id", text_col: str = "text", least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """``doc_id, quality, toxic, keep`` for every row of ``docs``: calibrated probabilities, and
    whether quality reaches ``least_quality`` and toxic stays below ``most_toxic``.

    NULL and empty texts are scored as documents without words, NULL metadata (or columns that
    aren't there) as a value of its own; NULL ids are returned as they are; rows that repeat get
    equal scores. Where labels have fewer than five rows of a class, a head gives the
    labelled share to all (without labels: quality 1, toxic 0)."""
    score = _scorer(docs, heads)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                good, toxic = score(part)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(good), pa.array(toxic), pa.array((good >= least_quality) & (toxic < most_toxic))], names=["doc_id", "quality", "toxic", "keep"])

    return _prepare(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, quality double, toxic double, keep boolean")


def keep_good(docs: DataFrame, heads: dict[str, Head], id_col: str = "doc_id", text_col: str = "text", least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score_documents keeps, with all their columns, in one pass without a join. Rows with NULL or
    empty texts are judged as documents without words, rows that repeat fare alike, an empty table stays empty."""
    score, names, kinds = _scorer(docs, heads), docs.columns, dict(docs.dtypes)
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    seen = {"text": F.col(text_col), **dict(zip(("lang", "source", "n_chars", "host"), _meta(docs)))}
    # what the classifier reads is one of the columns that pass through, where there is one of that name and type
    wanted = {"text": (text_col, "string"), "lang": ("lang", "string"), "source": ("source", "string"), "n_chars": ("n_chars", "bigint"), "host": (None, None)}
    place = {c: f"c{names.index(name)}" for c, (name, kind) in wanted.items() if name and kinds.get(name) == kind}
    wide = docs.select(*own, *[col.alias(f"in_{c}") for c, col in seen.items() if c not in place])
    out = [f"c{i}" for i in range(len(names))]

    def run(batches):
        for batch in batches:
            for part in slices(batch, place.get("text", "in_text"), PIECE):
                seen = pa.RecordBatch.from_arrays([part[place.get(c, f"in_{c}")] for c in wanted], names=list(wanted))
                good, toxic = score(seen)
                yield part.select(out).filter(pa.array((good >= least_quality) & (toxic < most_toxic)))

    return wide.mapInArrow(run, wide.select(*out).schema).toDF(*names)


def op1_quality_classifier(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
