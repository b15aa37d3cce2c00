"""Row ids: 16 bytes in the layout of UUID version 7, made in the JVM."""

from __future__ import annotations

import secrets
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_ID = "_row_id"


def row_id() -> Column:
    """A new id for each row, ascending within a partition and by partition.

    48 bits of time and 22 random bits are drawn once for the plan; 20 bits of partition
    and 32 of place follow. As the plan's rows decide the place, use it only where
    the result is written."""
    salt = secrets.randbits(22)
    head = f"{time.time_ns() // 1_000_000:012x}7{salt >> 10:03x}"
    seq = F.monotonically_increasing_id()
    place = F.shiftleft(F.shiftright(seq, 33), 32).bitwiseOR(seq.bitwiseAND(F.lit((1 << 32) - 1)))
    low = place.bitwiseOR(F.lit(-(1 << 63) | ((salt & 1023) << 52)))
    return F.unhex(F.concat(F.lit(head), F.lpad(F.hex(low), 16, "0")))


def with_row_ids(df: DataFrame) -> DataFrame:
    return df.withColumn(ROW_ID, row_id())
