"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_dir

#: Bits of a membership map at least (1 MB) and at most (256 MB); between them it has eight bits for each key.
MAP_BITS, MOST_BITS = 1 << 23, 1 << 31
_SEGMENT = 32768  # bits of one row of bitmap_construct_agg
_written: dict[str, SparkSession] = {}  # what discard hasn't deleted


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is
    cut, and the loss of an executor costs nothing that was written. What a lazy result still reads is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    _written[path] = spark
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote, once nothing reads it any more."""
    for df in tables:
        delete(df.sparkSession, df.written_at)
        _written.pop(df.written_at, None)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    _written[path] = spark


@atexit.register
def _delete_rest() -> None:
    for path, spark in _written.items():
        try:
            delete(spark, path)
        except Exception:  # the JVM is gone, or the session's folder
            return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` doesn't have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_hashes(text: Column) -> Column:
    """array<bigint>: one 64-bit hash for each word between ASCII white space.

    Hashing in the JVM lets Python see whole Arrow batches as flat int64 arrays.
    NULL counts as no words."""
    words = F.split(F.coalesce(text, F.lit("")), r"\s+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def bits_for(keys: int, least: int = MAP_BITS) -> int:
    """Size of a map for that many keys: a power of two, eight bits a key, between ``least`` and MOST_BITS.
    Only far beyond (some hundred million keys) do more and more other keys pass too."""
    return max(least, min(MOST_BITS, 1 << max(0, 8 * keys - 1).bit_length()))


def repeated_keys_map(keys: DataFrame, key: str, least: int = MAP_BITS) -> tuple[DataFrame, int]:
    """A bitmap of the 64-bit keys that occur at least twice in ``keys[key]``, and its bits.

    It is sized by how many there are and has ``bits / 32768`` rows of 4 KB; a bit may stand for
    several keys, so a later test can only let too much through, never too little."""
    twice = materialize(keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    bits = bits_for(twice.count(), least)
    out = materialize(keys_map(twice, key, bits), "map")
    discard(twice)
    return out, bits


def keys_map(keys: DataFrame, key: str, bits: int = MAP_BITS) -> DataFrame:
    """A bitmap of the 64-bit keys in ``keys[key]``, as rows of 4 KB."""
    slot = F.pmod(F.col(key), F.lit(bits)) + 1
    return (
        keys.select(F.bitmap_bucket_number(slot).alias("map_no"), F.bitmap_bit_position(slot).alias("bit"))
        .groupBy("map_no")
        .agg(F.bitmap_construct_agg("bit").alias("map"))
    )


def may_be_in_map(df: DataFrame, key: Column, bitmap: DataFrame, flag: str, bits: int = MAP_BITS) -> DataFrame:
    """``df`` with a boolean column ``flag``: false where the key isn't in the bitmap.

    The map is broadcast: it never has more than MOST_BITS."""
    no, bit, seg = fresh(df.withColumn(flag, F.lit(True)), "map_no", "map_bit", "map")
    slot = F.pmod(key, F.lit(bits))
    at = F.col(bit)
    byte = F.conv(F.hex(F.substring(F.col(seg), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")) != 0
    return (
        df.withColumn(no, (F.floor(slot / _SEGMENT) + 1).cast("bigint"))
        .withColumn(bit, F.pmod(slot, F.lit(_SEGMENT)).cast("int"))
        .join(F.broadcast(bitmap.select(F.col("map_no").alias(no), F.col("map").alias(seg))), no, "left")
        .withColumn(flag, F.coalesce(hit, F.lit(False)))
        .drop(no, bit, seg)
    )


def in_map(df: DataFrame, key: Column, bitmap: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """The rows of ``df`` whose key may be in the bitmap; see may_be_in_map."""
    (flag,) = fresh(df, "map_hit")
    return may_be_in_map(df, key, bitmap, flag, bits).where(F.col(flag)).drop(flag)
