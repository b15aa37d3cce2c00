"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAP_BITS, fresh, in_map, repeated_keys_map


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, map_bits: int = MAP_BITS) -> DataFrame:
    """One row ``(doc_id, keep_id)`` for each document whose text another one has too.

    Three scans, each shuffling less than the text. The first groups by length;
    the second hashes the prefixes of those whose length repeats; the third hashes
    the full content of those whose length and prefix repeat. What a scan needs
    to know of the one before is a bitmap, sized by the number of keys that repeat (of 256 MB at most; beyond some
    hundred million such keys more texts are hashed in full than need be); the last grouping (length and SHA-256) decides alone.
    It counts before the shuffle and joins the least id back, so no task holds a group.

    In each group the document with the least id stays (NULL ids come last) and has
    no row. NULL texts equal nothing; empty texts equal each other. A row that
    repeats with its id yields ``(id, id)`` for each repetition. Other columns,
    whatever their names, aren't looked at. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    base = base.withColumn("len", F.octet_length("text").cast("bigint"))
    lengths, bits = repeated_keys_map(base.select("len"), "len", map_bits)
    same_len = in_map(base, F.col("len"), lengths, bits)
    same_len = same_len.withColumn("prefix", F.xxhash64("len", F.substring("text", 1, prefix_chars)))
    prefixes, bits = repeated_keys_map(same_len.select("prefix"), "prefix", map_bits)
    last = in_map(same_len, F.col("prefix"), prefixes, bits)
    full = last.select("id", "len", F.unhex(F.sha2("text", 256)).alias("full"))
    rows = full.groupBy("len", "full", "id").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id")
    firsts = rows.groupBy("len", "full").agg(F.min(place)["id"].alias("keep"), F.sum("n").alias("all")).where("all > 1").drop("all")
    # every row but one of the id that stays
    gone = rows.join(firsts, ["len", "full"]).withColumn("n", F.col("n") - F.col("id").eqNullSafe(F.col("keep")).cast("int")).where("n > 0")
    # in two steps, as one id may be on any number of rows
    gone = gone.select("id", "keep", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n") - 1).cast("bigint"), F.lit(4096).cast("bigint"))).alias("at"))
    gone = gone.select("id", "keep", F.explode(F.array_repeat(F.lit(1), F.least(F.lit(4096), F.col("n") - F.col("at")).cast("int"))))
    return gone.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the documents that exact_duplicates lists; ids must be unique. Rows with NULL id or NULL text stay."""
    gone = exact_duplicates(docs, id_col, text_col, **params).select(F.col(id_col).alias("gone"))
    (key,) = fresh(docs, "gone")
    return docs.join(gone.withColumnRenamed("gone", key), F.col(id_col) == F.col(key), "left_anti")


def op3_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
select doc_id, keep_id from (
    select doc_id, first_value(doc_id) over w as keep_id, row_number() over w as nth
    from documents where text is not null
    window w as (partition by text order by doc_id nulls last)
) where nth > 1
"""
