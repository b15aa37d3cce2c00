"""Streaming ingestion."""

from __future__ import annotations

import uuid

from ..sources.storage import shared_dir
from ..streaming.ingest import insert_stream
from .loading import client, source
from .registry import query


@query("stream_insert", "select * from events")
def stream_insert(spark, sf_dir):
    """Read ``events`` as a stream and insert each micro-batch."""
    c, schema = client(spark), source(spark, sf_dir, "events").schema
    t = c.create_table("main", f"events_{len(c.tables('main'))}", schema)
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    insert_stream(stream, t, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").awaitTermination()
    return t.refresh().df()
