"""MinHash near-dedup: banded candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_for, discard, fresh, keys_map, materialize, may_be_in_map
from .components import components
from .texthash import all_shingle_sets, mix, slices

BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
BATCH = 32  # hashes that the sequential test looks at in one step
BLOCK = 4096  # members of a bucket that are compared with each other in one task


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, HASHES, dtype=np.uint32), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def minhash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, HASHES) of int32: signatures of the shingle sets; rows without shingles get zeros."""
    out = np.zeros((len(first) - 1, HASHES), dtype=np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        xor, odd = _seeds()
        low = (h >> np.uint64(32)).astype(np.uint32)
        at = first[full]
        for j in range(HASHES):
            v = (low ^ xor[j]) * odd[j]
            v ^= v >> np.uint32(15)
            out[full, j] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), at)
    return out.view(np.int32)


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """After n compared hashes: the least number of matches with which the posterior
    P(similarity >= threshold | matches of n, uniform prior) is still ``miss`` or more."""
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out[n] = m
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS): a 64-bit key for each band of the signatures, other ones for other bands."""
    part = sig.view(np.uint32).astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(sig), 1), dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + part[:, :, j])
    return key


def _sign(base: DataFrame, shingle: int) -> DataFrame:
    """``keys`` of the bands and ``sig``, the low 16 bits of the hashes: unequal hashes agree in them once in 65,536 times."""

    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                h, first = all_shingle_sets(part["text"], shingle)
                sig = minhash(h, first)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(sig).view(np.int64).reshape(-1)))
                low = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * HASHES), len(sig), [None, pa.py_buffer(sig.astype(np.uint16).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part["id"], part["body"], pa.array(np.diff(first).astype(np.int32)), keys, low], names=["id", "body", "n", "keys", "sig"])

    return base.mapInArrow(sign, "id bigint, body binary, n int, keys array<bigint>, sig binary")


def _hashes(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(sigs.cast(pa.binary(2 * HASHES)).buffers()[1], dtype=np.uint16)[sigs.offset * HASHES :].reshape(-1, HASHES) if len(sigs) else np.zeros((0, HASHES), np.uint16)


def survivors(sig_a: np.ndarray, a: np.ndarray, sig_b: np.ndarray, b: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Which of the pairs (sig_a[a], sig_b[b]) no posterior bound rules out."""
    alive, seen = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for n in range(BATCH, HASHES + 1, BATCH):
        seen[alive] += (sig_a[a[alive], n - BATCH : n] == sig_b[b[alive], n - BATCH : n]).sum(axis=1, dtype=np.int32)
        alive = alive[seen[alive] >= need[n]]
    return alive


def _bayes(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that no posterior bound rules out."""
    need = least_matches(threshold, miss)
    joined = pairs.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")

    def test(batches):
        for batch in batches:
            at = np.arange(batch.num_rows)
            ok = pa.array(survivors(_hashes(batch["sig_a"]), at, _hashes(batch["sig_b"]), at, need))
            yield pa.RecordBatch.from_arrays([batch[c].take(ok) for c in ("a", "b")], names=["a", "b"])

    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(test, "a bigint, b bigint")


def _exact(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs whose shingle sets have the Jaccard similarity asked for, counted in full. Each ``b`` brings its text to
    where its ``a`` is; the text of an ``a`` of many pairs is moved once and its shingles are made once for each slice."""
    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def test(batches):
        for batch in batches:
            for part in slices(batch, "text_b", 1 << 19):
                a = part["a"].to_numpy(zero_copy_only=False)
                new = np.append(True, a[1:] != a[:-1])  # rows that share an id may differ in text
                if len(a) > 1:
                    new[1:] |= ~pc.equal(part["text_a"].slice(1), part["text_a"].slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)
                own, which = np.flatnonzero(new), np.cumsum(new) - 1
                ha, fa = all_shingle_sets(part["text_a"].take(pa.array(own)), shingle)
                hb, fb = all_shingle_sets(part["text_b"], shingle)
                na, nb = np.diff(fa)[which], np.diff(fb)
                # the sets of a and b of each pair, one after the other: a hash that is there twice is common
                at = np.arange(int(na.sum())) - np.repeat(np.cumsum(na) - na, na) + np.repeat(fa[which], na)
                row = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
                h = np.concatenate([ha[at], hb])
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                both = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=len(na))
                ok = pa.array(np.flatnonzero(both >= threshold * (na + nb - both)))
                yield pa.RecordBatch.from_arrays([part[c].take(ok) for c in ("a", "b")], names=["a", "b"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(test, "a bigint, b bigint")


def _blocks(split: DataFrame, block: int) -> DataFrame:
    """(key, pa, pb, side, id, comp): the members of buckets that span components, gathered for comparison. A bucket of up to
    ``block`` members is one group. A larger one is parted: components of more than ``block`` members into blocks of their own,
    the others together; two blocks (pa, pb) are a group, unless they are of the same component. Only blocks are paired,
    no rows, and a group never has more than some ``block`` members twice."""
    sizes = split.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.join(sizes.groupBy("key").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") <= block, F.col("n"))).alias("few")).where(F.col("all") > block), "key"), "near-large")
    if not large.take(1):
        discard(large)
        return split.select("key", F.lit("").alias("pa"), F.lit("").alias("pb"), F.lit(0).alias("side"), "id", "comp")
    small = split.join(large.select("key").distinct(), "key", "left_anti").select("key", F.lit("").alias("pa"), F.lit("").alias("pb"), F.lit(0).alias("side"), "id", "comp")
    rows = split.join(large, ["key", "comp"])
    no = lambda by, n: F.pmod(F.xxhash64(by), F.ceil(F.col(n) / block))
    rows = rows.withColumn("own", F.when(F.col("n") > block, F.col("comp"))).withColumn("p", F.when(F.col("n") > block, F.concat_ws("/", "comp", no("id", "n"))).otherwise(F.concat(F.lit("/"), no("comp", "few"))))
    parts = rows.select("key", "own", "p").distinct()
    left, right = (parts.select("key", F.col("own").alias(f"own_{i}"), F.col("p").alias(f"p{i}")) for i in "ab")
    pairs = left.join(right, "key").where("pa <= pb and coalesce(own_a <> own_b, true)").select("key", "pa", "pb")
    sides = pairs.select("key", "pa", "pb", F.explode(F.when(F.col("pa") == F.col("pb"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("p", F.when(F.col("side") == 0, F.col("pa")).otherwise(F.col("pb")))
    return small.unionByName(rows.select("key", "p", "id", "comp").join(sides, ["key", "p"]).select("key", "pa", "pb", "side", "id", "comp"))


def _across(split: DataFrame, sigs: DataFrame, threshold: float, miss: float, block: int) -> DataFrame:
    """The pairs (a, b) of members of one bucket but of different components that no posterior bound rules out. All are
    compared, where they lie, and only survivors are given out."""
    need = least_matches(threshold, miss)
    order = ["key", "pa", "pb", "side"]
    groups = _blocks(split, block).join(sigs.select("id", "sig"), "id").repartition("key", "pa", "pb").sortWithinPartitions(*order)

    def compare(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > 2 * block:
                table = pa.Table.from_batches(held).combine_chunks()
                new = _starts(table)
                if len(new) > 1:  # the last group may go on
                    yield from pairs_of(table.slice(0, int(new[-1])))
                    held, size = table.slice(int(new[-1])).to_batches(), table.num_rows - int(new[-1])
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    def pairs_of(table: pa.Table):
        cols = {c: table[c].combine_chunks() for c in ("side", "id", "comp", "sig")}
        sig, (side, ids, comp) = _hashes(cols["sig"]), (cols[c].to_numpy() for c in ("side", "id", "comp"))
        start = _starts(table)
        end = np.append(start[1:], table.num_rows)
        group = np.repeat(np.arange(len(start)), end - start)
        middle = start + np.bincount(group, side == 0, minlength=len(start)).astype(np.int64)  # where the second block begins
        # a row's partners: the second block, or what comes after it where there is but one
        first = np.where(middle[group] < end[group], np.maximum(middle[group], np.arange(len(ids)) + 1), np.arange(len(ids)) + 1)
        n = np.where((middle[group] < end[group]) & (side == 1), 0, end[group] - first)
        upto = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 19), side="right")))
            a = np.repeat(np.arange(at, to), n[at:to])
            b = np.arange(len(a)) - np.repeat(upto[at:to] - n[at:to] - (upto[at - 1] if at else 0), n[at:to]) + np.repeat(first[at:to], n[at:to])
            other = (comp[a] != comp[b]) & (ids[a] != ids[b])
            a, b = a[other], b[other]
            ok = survivors(sig, a, sig, b, need)
            x, y = ids[a[ok]], ids[b[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            at = to

    return groups.select(*order, "id", "comp", "sig").mapInArrow(compare, "a bigint, b bigint").distinct()


def _starts(table: pa.Table) -> np.ndarray:
    """Where the groups of equal (key, pa, pb) begin."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for c in ("key", "pa", "pb"):
        codes = table[c].combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: float = 0.5, miss: float = 0.001, block: int = BLOCK) -> DataFrame:
    """One row ``(doc_id, keep_id)`` for each document that isn't the first of its group.

    Groups are the components of the graph of pairs whose sets of ``shingle``-word runs have
    a Jaccard similarity of ``threshold`` or more; the least id of each stays. Equal texts are
    one node. Signatures have 160 hashes, banded 40 x 4. In each bucket every member is first
    paired with the least id; then, where a bucket still spans several components,
    all members of different components are compared in blocks, of which only survivors leave the task. So each pair that shares a bucket is
    either tested or known to be joined, whatever the size of a group, at a cost in proportion
    to the members of homogeneous groups. A pair is dropped once, after some 32, 64, ... hashes,
    the posterior that it reaches the threshold is below ``miss``; survivors are
    verified on their whole texts. Buckets are aggregated and joined back, so hot ones are split among tasks.

    Rows with NULL id or NULL text are in no group. Empty texts equal each other; texts
    without words equal only the same text; texts of fewer than ``shingle`` words
    have one shingle, of all their words. Ids are whole numbers. Rows that share an id count as one document, found if any of them is.
    Other columns aren't looked at. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    signed = materialize(_sign(base.select("id", "text", F.unhex(F.md5("text")).alias("body")), shingle), "near-sig")
    # texts that many documents share are added up before the shuffle, and joined by short rows
    repeated = signed.groupBy("body").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").drop("last")
    copies = materialize(signed.select("id", "body").join(repeated, "body").where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"), "body"), "near-copies")
    nodes = signed.where("n > 0").join(copies.select(F.col("u").alias("id"), "body"), ["id", "body"], "left_anti").select("id", "keys", "sig")
    nodes = materialize(nodes, "near-nodes")

    banded = nodes.select("id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").drop("last")
    multi = materialize(banded.join(shared, "key"), "near-buckets")
    # texts are looked up only for documents that share a bucket
    texts = base.join(multi.select("id").distinct(), "id", "left_semi")
    texts = materialize(texts, "near-texts")

    stars = materialize(multi.where("id > lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "near-stars")
    verified = materialize(_exact(_bayes(stars, nodes, threshold, miss), texts, shingle, threshold), "near-edges")
    comp = components(verified.select(F.col("a").alias("u"), F.col("b").alias("v")))

    split = multi.select("key", "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    spans = split.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    split = materialize(split.join(spans, "key").distinct(), "near-split")
    rest = materialize(_across(split, nodes, threshold, miss, block).join(stars, ["a", "b"], "left_anti"), "near-rest")
    more = materialize(_exact(rest, texts, shingle, threshold), "near-edges")

    edges = verified.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(copies.select("u", "v"))
    groups = components(edges)
    discard(signed, nodes, multi, texts, stars, split, rest, comp, copies, verified, more)
    return groups.where("id <> comp").select(F.col("id").alias(id_col), F.col("comp").alias("keep_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with one document of each group of near_duplicates; rows with NULL id or
    text stay. Rows that repeat with their id fare alike."""
    key, flag = fresh(docs, "gone", "near_flag")
    gone = materialize(near_duplicates(docs, id_col, text_col, **params).select(F.col(id_col).alias(key)), "near-gone")
    # a bitmap tells which rows may go; only these are shuffled
    bits = bits_for(gone.count())
    bitmap = keys_map(gone.select(F.xxhash64(key).alias("h")), "h", bits)
    rows = may_be_in_map(docs, F.xxhash64(F.col(id_col).cast("bigint")), bitmap, flag, bits)
    asked = rows.where(F.col(flag)).join(gone, F.col(id_col) == F.col(key), "left_anti")
    return rows.where(~F.col(flag)).unionByName(asked).select(*docs.columns)


def op5_minhash_near_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
