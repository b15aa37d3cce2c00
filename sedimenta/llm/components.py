"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for each node of ``edges(u, v)``; comp is the least id it is joined to.

    Alternating large-star and small-star steps and a write to the shared folder, until nothing changes; a component of
    any size or shape takes about log(size) rounds. The least neighbour of each node comes from an aggregation that
    is begun before the shuffle and is joined back, so that the many edges of one node can be split among tasks (adaptive skew join).
    Edges with a NULL end are no edges; edges that repeat count once; an empty table gives no rows."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _state(now)
    while before[0]:
        # of every node the least among itself and all its neighbours; each greater neighbour is joined to that
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = now.join(least, F.col("v") == F.col("w")).select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        last, now = now, materialize(small.where("u <> v").distinct(), "cc")
        discard(last)
        after = _state(now)
        if after == before:
            break
        before = after
    out = now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
    out.written_at = now.written_at  # for discard
    return out
