"""Dedup of repeated passages by prefix-free parsing, parted by triggers.

A rolling hash over runs of TRIGGER_WORDS words puts a trigger at the least hash of every
SPAN positions, so equal passages have equal triggers and are worked on together. The words around a trigger within which
the passages of ``min_words`` that have it lie are its context; equal contexts count once. The distinct contexts of some triggers
are a corpus of highly repetitive text: it is parsed into phrases, and suffix arrays of the dictionary of
phrases and of the parse combine into corpus order (prefix_free), where equal passages are neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAP_BITS, bits_for, discard, keys_map, materialize
from .prefix_free import PrefixFreeParse
from .texthash import Words, is_long, mix, pieces, runs, slices, stretches

TRIGGER_WORDS = 4
CHUNK = 10_000  # contexts whose order is found at once, if no trigger has more
HOT = 20_000  # occurrences of a trigger from which its passages are shuffled one by one
PIECE = 1 << 19
KEY_WORDS = 2  # in a context its key, as two words of 32 bits, stands for the words that are hashed to it
_RESULT = "key bigint, ctx bigint, a_lo int, a_hi int, f_id bigint, f_body bigint, f_at int"


class Parse:
    """Triggers of a slice of texts. Of each: ``at`` (word), the least and greatest
    distance ``lo``..``hi`` of window starts before it, ``key`` (hash of the words every window has)."""

    def __init__(self, texts: pa.Array, min_words: int):
        w = self.words = Words(texts)
        self.span = (min_words - TRIGGER_WORDS + 1) * 2 // 3
        h, n = w.hash, len(w.hash)
        self.at = self.lo = self.hi = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.int64)
        starts = np.flatnonzero(w.doc[: max(n - min_words + 1, 0)] == w.doc[min_words - 1 :]) if n >= min_words else np.zeros(0, np.int64)
        if not len(starts):
            return
        roll = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
        at, r = runs(h, w.doc, TRIGGER_WORDS)
        roll[at] = r
        ahead = np.lib.stride_tricks.sliding_window_view(roll, self.span)
        trigger = starts + np.concatenate([ahead[s].argmin(axis=1) for s in np.array_split(starts, len(starts) // 65536 + 1)])
        # starts ascend and so do their triggers within a text
        new = np.append(True, (trigger[1:] != trigger[:-1]) | (np.diff(starts) != 1))
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(starts)) - 1
        self.at = trigger[first]
        self.hi, self.lo = self.at - starts[first], self.at - starts[last]
        common = shared_words(min_words)
        place = np.full(n, -1)
        spots, keys = runs(h, w.doc, common)
        place[spots] = np.arange(len(spots))
        self.key = keys[place[self.at]].view(np.int64)


def shared_words(min_words: int) -> int:
    """Words from a trigger on that every passage of ``min_words`` with that trigger has; its key is their hash."""
    return min_words - (min_words - TRIGGER_WORDS + 1) * 2 // 3 + 1


def _lists(values: np.ndarray, key: np.ndarray, start: np.ndarray, before: np.ndarray, shared: int, after: np.ndarray) -> pa.ListArray:
    """Contexts from ``start`` on: the words before the trigger, the key in place of the ``shared`` ones, and those after them."""
    n = before + KEY_WORDS + after
    row = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    past = off - before[row]
    words = values[np.minimum(off + start[row] + np.where(past > 0, shared - KEY_WORDS, 0), len(values) - 1)]
    for i in range(KEY_WORDS):
        words[past == i] = (key >> 32 * i).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(words))


def _parses(batch: pa.RecordBatch, min_words: int):
    """(rows, their Parse, number of the first word) of the slices of a batch; long texts in pieces."""
    for part in slices(batch, "text", PIECE):
        if is_long(part["text"], PIECE):
            for piece, word, _ in pieces(part["text"], PIECE, min_words - 1):
                yield part, Parse(piece, min_words), word
        else:
            yield part, Parse(part["text"], min_words), 0


def _keys(base: DataFrame, min_words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, p, _ in _parses(batch, min_words):
                yield pa.RecordBatch.from_arrays([pa.array(p.key)], names=["key"])

    return base.select("text").mapInArrow(run, "key bigint")


def _set(bitmap: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    slot = np.mod(keys, bits)
    return bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0


def _occurrences(base: DataFrame, min_words: int, maps, full: bool) -> DataFrame:
    """A row for each trigger whose key may repeat: key, ctx, id, body, at; if ``full`` also its context's words and whether its key may be hot."""

    shared = shared_words(min_words)

    def run(batches):
        (bits, block), (hot_bits, hot_block) = maps.value
        known, hot_known = np.frombuffer(block, dtype=np.uint8), np.frombuffer(hot_block, dtype=np.uint8)
        for batch in batches:
            for part, p, word in _parses(batch, min_words):
                w, ok = p.words, np.flatnonzero(_set(known, bits, p.key))
                at, lo, hi, key = p.at[ok], p.lo[ok], p.hi[ok], p.key[ok]
                row = w.doc[at]
                # the words from the first window's start to the last one's end say all about a trigger
                ctx = stretches(w.hash, at - hi, at - lo + min_words) + mix((lo * 4096 + hi).astype(np.uint64))
                place, take = pa.array((at - w.first[row] + word).astype(np.int32)), pa.array(row)
                cols = {"key": pa.array(key), "ctx": pa.array(ctx.view(np.int64)), "id": part["id"].take(take), "body": part["body"].take(take), "at": place}
                if full:
                    hot = _set(hot_known, hot_bits, key) if len(hot_known) else np.zeros(len(key), dtype=bool)
                    short = (w.hash >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    cols |= {"lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32)), "hot": pa.array(hot), "words": _lists(short, key, at - hi, hi, shared, min_words - lo - shared)}
                yield pa.RecordBatch.from_pydict(cols)

    return base.mapInArrow(run, "key bigint, ctx bigint, id bigint, body bigint, at int" + (", lo int, hi int, hot boolean, words array<int>" if full else ""))


def _one_by_one(entries: DataFrame, length: int) -> DataFrame:
    """What combine finds, for contexts of triggers that no one task should hold: each passage is hashed (128 bits of its words'
    32) and added up by itself."""

    def run(batches):
        for batch in batches:
            lo, hi = (batch[c].to_numpy().astype(np.int64) for c in ("lo", "hi"))
            words, first = batch["words"].flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64), batch["words"].offsets.to_numpy().astype(np.int64)
            n = hi - lo + 1
            row = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = (first - first[0])[row] + off
            hashes = [pa.array(stretches(mix(words + np.uint64(salt)), at, at + length).view(np.int64)) for salt in (1, 1 << 40)]
            cols = [batch[c].take(pa.array(row)) for c in ("key", "ctx", "n", "f_id", "f_body", "f_at")]
            yield pa.RecordBatch.from_arrays([*hashes, pa.array((hi[row] - off).astype(np.int32)), *cols], names=["w1", "w2", "a", "key", "ctx", "n", "f_id", "f_body", "f_at"])

    every = entries.select("key", "ctx", "n", "lo", "hi", "words", "f_id", "f_body", "f_at").mapInArrow(run, "w1 bigint, w2 bigint, a int, key bigint, ctx bigint, n bigint, f_id bigint, f_body bigint, f_at int")
    # by the places of triggers: of two triggers with equal passages of one text the first is also the first passage
    place = F.struct(F.col("f_id").isNull().alias("no_id"), "f_id", "f_body", "f_at")
    firsts = every.groupBy("w1", "w2").agg(F.sum("n").alias("all"), F.min(place).alias("f")).where("all > 1").select("w1", "w2", "f")
    found = every.select("w1", "w2", "key", "ctx", "a").join(firsts, ["w1", "w2"])
    run_of = F.col("a") - F.row_number().over(Window.partitionBy("key", "ctx", "f").orderBy("a"))
    runs_of = found.withColumn("run", run_of).groupBy("key", "ctx", "f", "run").agg(F.min("a").alias("a_lo"), F.max("a").alias("a_hi"))
    return runs_of.select("key", "ctx", "a_lo", "a_hi", "f.f_id", "f.f_body", "f.f_at")


def combine(chunk: pa.Table, length: int, modulus: int = 8) -> pa.RecordBatch:
    """The repeated passages of the contexts of whole triggers: for each context runs
    of distances a_lo..a_hi before the trigger at which a passage starts that occurs more than
    once, and its first occurrence. ``length`` is that of a passage in a context, where the key stands for the shared words."""
    cols = {c: chunk[c].to_numpy().astype(np.int64) for c in ("key", "ctx", "n", "lo", "hi", "f_body", "f_at")}
    f_id = chunk["f_id"].combine_chunks()
    null = f_id.is_null().to_numpy(zero_copy_only=False)
    ids = f_id.fill_null(0).to_numpy(zero_copy_only=False)
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.lexsort((cols["f_at"], cols["f_body"], ids, null))] = np.arange(len(ids))
    by_rank = np.argsort(rank)
    lists = chunk["words"].combine_chunks()
    words, first = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32), lists.offsets.to_numpy().astype(np.int64)
    first = first - first[0]
    # all places at which a passage starts, in corpus order
    n = cols["hi"] - cols["lo"] + 1
    row = np.repeat(np.arange(len(ids)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    a = cols["hi"][row] - at
    order, common = PrefixFreeParse(words, first, modulus).order(first[row] + row + at)
    begin = np.flatnonzero(np.append(True, common[1:] < length)) if len(order) else np.zeros(0, np.int64)
    group = np.cumsum(np.append(True, common[1:] < length)[: len(order)]) - 1
    often = np.add.reduceat(cols["n"][row[order]], begin)[group] > 1 if len(order) else np.zeros(0, bool)
    least = np.minimum.reduceat(rank[row[order]], begin)[group] if len(order) else np.zeros(0, np.int64)
    row, a, least = row[order][often], a[order][often], least[often]
    order = np.lexsort((a, least, row))
    row, a, least = row[order], a[order], least[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1]) | (a[1:] != a[:-1] + 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(row)) - 1 if len(lo) else lo
    src = by_rank[least[lo]]
    arrays = [pa.array(cols["key"][row[lo]]), pa.array(cols["ctx"][row[lo]]), pa.array(a[lo].astype(np.int32)), pa.array(a[hi].astype(np.int32)), pa.array(ids[src], mask=null[src]), pa.array(cols["f_body"][src]), pa.array(cols["f_at"][src].astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "ctx", "a_lo", "a_hi", "f_id", "f_body", "f_at"])


def _combine_all(entries: DataFrame, length: int) -> DataFrame:
    def run(batches):
        held: list[pa.RecordBatch] = []
        size, opened = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            opened = batch["key"][0].as_py() if opened is None else opened
            if size >= CHUNK and batch["key"][-1].as_py() != opened:
                table = pa.Table.from_batches(held)
                key = table["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last trigger may go on
                yield combine(table.slice(0, cut), length)
                held, size, opened = table.slice(cut).to_batches(), len(key) - cut, int(key[-1])
        if held:
            yield combine(pa.Table.from_batches(held), length)

    return entries.mapInArrow(run, _RESULT)


def _fetch(bitmap: DataFrame, bits: int) -> tuple[int, bytes]:
    block = bytearray(bits // 8)
    for no, piece in bitmap.toLocalIterator():
        block[(no - 1) * 4096 : no * 4096] = piece
    return bits, bytes(block)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, map_bits: int = MAP_BITS, hot: int = HOT) -> DataFrame:
    """One row for each stretch that later occurrences of passages of ``min_words`` words cover:
    ``doc_id, start_word, end_word, n_words, first_doc_id``.

    Words are runs of letters and digits in lower case (bytes beyond ASCII are letters). Every run of
    ``min_words`` words that occurs before, in the order of (id, text hash, place; NULL ids last), is
    covered; covered runs that overlap or touch are merged. ``first_doc_id`` is the least of the documents
    that have the first occurrences. All runs of all texts take part; results are exact but for
    hashes: 64 bits for the words that all passages of a trigger share and 32 for each word around them.

    Contexts have the key itself in place of the words that are hashed to it. Which triggers' keys repeat is told by a bitmap, sized by how many they are (128 MB at most; others pass by chance only
    and are dropped later). Contexts are added up before they are shuffled. The distinct contexts of triggers of more than ``hot`` occurrences have their passages
    added up one by one (by hashes of 128 bits) instead of in one task.

    NULL texts and texts of fewer than ``min_words`` words give no rows. Rows that repeat with
    both id and text count as one. Ids are whole numbers; NULL ids are returned as they are. Very long texts are worked on in overlapping
    pieces. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("body")).where("text is not null")
    repeated = materialize(_keys(base, min_words).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "trigger-keys")
    many, hot_many = repeated.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > hot, 1))).first()
    bits, hot_bits = min(1 << 30, bits_for(many, map_bits)), min(1 << 30, bits_for(hot_many, 1 << 15))
    hot_map = _fetch(keys_map(repeated.where(F.col("n") > hot), "key", hot_bits), hot_bits) if hot_many else (hot_bits, b"")
    maps = spark.sparkContext.broadcast((_fetch(keys_map(repeated, "key", bits), bits), hot_map))
    discard(repeated)

    length = min_words - shared_words(min_words) + KEY_WORDS
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "body", "at")
    full = _occurrences(base, min_words, maps, True)
    entries = full.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("f"), *[F.first(c).alias(c) for c in ("lo", "hi", "hot", "words")])
    entries = entries.select("key", "ctx", "n", "lo", "hi", "hot", "words", F.col("f.id").alias("f_id"), F.col("f.body").alias("f_body"), F.col("f.at").alias("f_at"))
    found = _combine_all((entries.where("not hot") if hot_many else entries).repartition("key").sortWithinPartitions("key"), length)
    found = materialize(found.unionByName(_one_by_one(entries.where("hot"), length)) if hot_many else found, "passages")

    hits = _occurrences(base, min_words, maps, False).join(found, ["key", "ctx"])
    later = hits.where(~(F.col("id").eqNullSafe(F.col("f_id")) & (F.col("body") == F.col("f_body")) & (F.col("at") == F.col("f_at"))))
    spans = later.select("id", "body", (F.col("at") - F.col("a_hi")).alias("s"), (F.col("at") - F.col("a_lo") + min_words).alias("e"), "f_id")
    by_doc = Window.partitionBy("id", "body").orderBy("s", "e")
    reach = F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("apart", F.coalesce(F.col("s") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("apart").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("id", "body", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("f_id").alias("first_doc_id"))
    return out.select(F.col("id").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def op2_suffix_array_dedup(spark, sf_dir) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') as ws from documents where text is not null),
p as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as p from w where len(ws) >= 50),
k as (select doc_id, p, row_number() over win as nth, first_value(doc_id) over win as f from p
      window win as (partition by array_to_string(ws[p:p + 49], ' ') order by doc_id nulls last, p)),
g as (select *, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as apart from k where nth > 1),
i as (select *, sum(apart) over (partition by doc_id order by p) as island from g)
select doc_id, cast(min(p) - 1 as int) as start_word, cast(max(p) + 49 as int) as end_word, cast(max(p) + 50 - min(p) as int) as n_words, min(f) as first_doc_id
from i group by doc_id, island
"""
