"""Tables that queries run on, loaded whole from Parquet into a warehouse in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table import Table
from ..sources.catalog import Client

_clients: dict[str, Client] = {}
_loaded: dict[tuple, Table] = {}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def client(spark: SparkSession) -> Client:
    app = spark.sparkContext.applicationId
    if app not in _clients:
        _clients[app] = Client(spark)
        _clients[app].create_namespace("main")
    return _clients[app]


def fresh_table(spark: SparkSession, sf_dir: str, name: str, **options) -> Table:
    """A table of its own for a query that changes it."""
    rows = source(spark, sf_dir, name)
    c = client(spark)
    table = c.create_table("main", f"{name}_{len(c.tables('main'))}", rows.schema, **options)
    table.bypass_insert(rows)
    return table


def in_parts(table: Table, rows: DataFrame, key: str, files: Sequence[int] | None = None) -> list[list[str]]:
    """Insert rows by the remainder of ``key`` by 4, each into files of its own, by default as its tasks come, or into so many
    of equal size; the names of each remainder's files."""
    out, seen = [], set()
    for i in range(4):
        part = rows.where(F.col(key) % 4 == i)
        table.bypass_insert(part.repartition(files[i]) if files else part)
        names = [f["name"] for f in table.data_file_records() if f["name"] not in seen]
        seen |= set(names)
        out.append(names)
    return out


def shared_table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    """One table for all queries that only read it, while its folder is there."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _loaded or not _loaded[key].storage.exists(_loaded[key].path):
        _loaded[key] = fresh_table(spark, sf_dir, name)
    return _loaded[key]
