"""Streams into tables: each micro-batch is one insert, and inline rows are dumped as the tier fills."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.table import Table
from ..sources.storage import Storage


def insert_stream(stream: DataFrame, table: Table, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that inserts every micro-batch once: the table notes the number of a stream's last batch in the same version as its
    rows, so a batch that is tried again after a failure inserts nothing. ``checkpoint`` is a folder all executors share, whose
    id names the stream; ``trigger`` as for writeStream.trigger (by default what is there, then stop)."""
    folder = Storage(table.spark, checkpoint)

    def insert(batch: DataFrame, number: int) -> None:
        name = json.loads(folder.read("metadata").splitlines()[-1])["id"]
        table.refresh().insert(batch, batch=(name, number))

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
