"""Distances between vectors in the JVM, and quantised codes (a random rotation and a few bits for
each dimension) whose inner products estimate theirs without bias."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42


def _pairwise(v: Column, q: list[float], f) -> Column:
    query = F.array(*[F.lit(float(x)) for x in q])
    return F.aggregate(F.zip_with(v.cast("array<double>"), query, f), F.lit(0.0), lambda a, b: a + b)


def l2_distance(v: Column, q: list[float]) -> Column:
    """Euclidean distance in doubles; NULL for a NULL vector or one of another length."""
    return F.when(F.size(v) == len(q), F.sqrt(_pairwise(v, q, lambda a, b: (a - b) * (a - b))))


def inner_product(v: Column, q: list[float]) -> Column:
    return F.when(F.size(v) == len(q), _pairwise(v, q, lambda a, b: a * b))


def candidates(df: DataFrame, keys: list[str], vector: str, q: list[float], metric: str, k: int) -> DataFrame:
    """``keys`` and ``vector`` of all rows that may be among the ``k`` best, ties included: each task passes on
    what isn't beaten by k rows it saw before, by distances of whole Arrow batches at once. Some k log n rows
    of a task remain for the exact order."""
    base = df.where(F.size(vector) == len(q)).select(*keys, vector)

    def run(batches):
        query, best = np.array(q, dtype=float), np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch[vector].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            score = -(rows @ query) if metric == "ip" else ((rows - query) ** 2).sum(axis=1)
            best = np.sort(np.concatenate([best, score]))[:k]
            worst = best[-1] if len(best) == k else np.inf
            yield batch.filter(pa.array(~(score > worst + 1e-9 * (1 + abs(worst)))))

    return base.mapInArrow(run, base.schema)


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows padded to a power of two (64 at least), then four rounds of random signs and a Hadamard transform."""
    size = max(64, 1 << (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    rng = np.random.default_rng(SEED)
    for _ in range(4):
        out *= rng.choice([-1.0, 1.0], size)
        step = 1
        while step < size:
            halves = out.reshape(len(x), -1, 2, step)
            out = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(len(x), size)
            step *= 2
        out /= np.sqrt(size)
    return out


def quantise(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, factor, squared norm) of rows: <x, q> is about factor * <code + 0.5 - 2^(bits-1), rotated q>."""
    r = rotate(x)
    norm = np.linalg.norm(r, axis=1)
    unit = r / np.where(norm == 0, 1, norm)[:, None]
    half = 1 << bits - 1
    most = np.abs(unit).max(axis=1, keepdims=True)
    codes = np.clip(np.floor(unit / np.where(most == 0, 1, most) * half) + half, 0, 2 * half - 1)
    grid = codes + 0.5 - half
    along = (grid * unit).sum(axis=1)
    return codes.astype(np.uint16), np.where(along > 0, norm / np.where(along > 0, along, 1), 0.0), norm**2


def _code(bits: int) -> np.dtype:
    return np.dtype(np.uint8 if bits <= 8 else np.uint16)


def encode_vectors(df: DataFrame, keys: list[str], vector: str, bits: int) -> DataFrame:
    """``keys`` with ``code``, ``factor``, ``norm2`` of each vector that isn't NULL or empty; a code takes one byte a dimension
    up to eight bits, two beyond."""

    def run(batches):
        for batch in batches:
            lists = batch["v"].to_pylist()
            sizes = {len(v) for v in lists}
            for n in sizes:
                chosen = [i for i, v in enumerate(lists) if len(v) == n]
                codes, factor, norm2 = quantise(np.array([lists[i] for i in chosen], dtype=float), bits)
                part = batch.take(pa.array(chosen))
                cols = [part[k] for k in keys] + [pa.array([c.tobytes() for c in codes.astype(_code(bits))], pa.binary()), pa.array(factor), pa.array(norm2)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "code", "factor", "norm2"])

    base = df.where(F.size(vector) > 0).select(*keys, F.col(vector).cast("array<double>").alias("v"))
    kinds = ", ".join(f"{c} {t}" for c, t in base.drop("v").dtypes)
    return base.mapInArrow(run, f"{kinds}, code binary, factor double, norm2 double")


def estimated(codes: DataFrame, keys: list[str], q: list[float], bits: int, metric: str, k: int) -> DataFrame:
    """The ``k`` best of each task by estimated score: ``keys``, ``score`` (squared distance, or inner product)."""
    kinds = ", ".join(f"{c} {t}" for c, t in codes.select(*keys).dtypes)

    def run(batches):
        query = rotate(np.array([q], dtype=float))[0]
        own, best, scores = float(np.dot(query, query)), [], np.zeros(0)
        half = 1 << bits - 1
        for batch in batches:
            part = batch.filter(pc.equal(pc.binary_length(batch["code"]), len(query) * _code(bits).itemsize))
            if not part.num_rows:
                continue
            grid = np.frombuffer(b"".join(part["code"].to_pylist()), dtype=_code(bits)).reshape(part.num_rows, -1) + 0.5 - half
            dot = (grid @ query) * part["factor"].to_numpy()
            now = dot if metric == "ip" else part["norm2"].to_numpy() - 2 * dot + own
            table = pa.Table.from_batches([*best, part.select(keys)])
            scores = np.concatenate([scores, now])
            order = np.argsort(-scores if metric == "ip" else scores, kind="stable")[:k]
            best, scores = table.take(pa.array(order)).combine_chunks().to_batches(), scores[order]
        for b in best:
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keys], pa.array(scores)], names=[*keys, "score"])

    return codes.select(*keys, "code", "factor", "norm2").mapInArrow(run, f"{kinds}, score double")
