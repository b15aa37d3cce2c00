"""SQL over tables: views for SELECT, and statements that return one row with their count."""

from __future__ import annotations

import re
from collections import Counter
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..errors import NotSupported
from ..functions import geometry
from ..functions.expressions import as_column, conjunction
from ..functions.rowid import ROW_ID
from .indexes import anded, as_intersects
from .table import Table, counted

#: Estimated rows of an INSERT from which they go straight to data files.
BYPASS_ABOVE = 1000


def execute(client, text: str, namespace: str = "main") -> DataFrame:
    """One SQL statement over the newest versions of a namespace's tables: a query, or INSERT INTO / OVERWRITE, UPDATE, DELETE,
    TRUNCATE, DROP TABLE, which run at once and return their count. Filters right above a table rule out
    files by its indexes, ``st_intersects(column, X'...')`` too; ``count(*)`` of a whole table comes from its manifest."""
    spark = client.spark
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    kind = plan.getClass().getSimpleName()
    if kind in ("DeleteFromTable", "UpdateTable"):
        table = client.load_table(namespace, _relation(plan.table()))
        if kind == "DeleteFromTable":
            return delete_from(table, _column(spark, plan.condition()))
        changes = [plan.assignments().apply(i) for i in range(plan.assignments().size())]
        where = [_column(spark, plan.condition().get())] if plan.condition().isDefined() else []
        return update_table(table, {a.key().nameParts().last(): a.value().sql() for a in changes}, *where)
    if kind == "InsertIntoStatement":
        table = client.load_table(namespace, _relation(plan.table()))
        if plan.partitionSpec().size() or plan.byName() or plan.ifPartitionNotExists():
            raise NotSupported("INSERT by name or partition")
        with _views(client, namespace, text, plan.query()):
            rows = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.query()), spark)
        named = [plan.userSpecifiedCols().apply(i) for i in range(plan.userSpecifiedCols().size())]
        return insert_into(table, rows, named or [f.name for f in table.fields], "overwrite" if plan.overwrite() else "append", BYPASS_ABOVE, _estimate(rows))
    if kind == "TruncateTable":
        return counted(spark, client.load_table(namespace, plan.table().multipartIdentifier().last()).truncate())
    if kind == "DropTable":
        table = client.load_table(namespace, plan.child().nameParts().last())
        n = table.count()
        table.drop()
        return counted(spark, n)
    if whole := re.fullmatch(r"\s*select\s+count\(\s*(?:\*|1)\s*\)(?:\s+(?:as\s+)?(\w+))?\s+from\s+(\w+)\s*;?\s*", text, re.I):
        found = [t for t in client.tables(namespace) if t.lower() == whole[2].lower()]
        if found:
            return counted(spark, client.load_table(namespace, found[0]).count()).toDF(whole[1] or "count(1)")
    with _views(client, namespace, text, plan):
        return spark.sql(text)


def _relation(node) -> str:
    while node.getClass().getSimpleName() == "SubqueryAlias":
        node = node.child()
    return node.multipartIdentifier().last()


def _column(spark, tree) -> Column:
    return Column(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(tree))


def _estimate(rows: DataFrame) -> int:
    """Rows by the planner's statistics, or by bytes where it counts none."""
    stats = rows._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.rowCount().get() if stats.rowCount().isDefined() else stats.sizeInBytes())) // (1 if stats.rowCount().isDefined() else 100)


def _nodes(node):
    """A parsed plan with its common table expressions and subqueries."""
    yield node
    for inner in (node.children(), node.innerChildren()):
        for i in range(inner.size()):
            if hasattr(inner.apply(i), "getClass"):
                yield from _nodes(inner.apply(i))


@contextmanager
def _views(client, namespace: str, text: str, plan):
    """Temporary views of the tables that a statement names, each over the files that its filters leave; views that had
    their names come back afterwards."""
    spark, before = client.spark, {}
    named = [t for t in client.tables(namespace) if re.search(rf"\b{re.escape(t)}\b", text, re.I)]
    if named:
        nodes = list(_nodes(plan))
        uses = Counter(_relation(n).lower() for n in nodes if n.getClass().getSimpleName() == "UnresolvedRelation")
        above = {}
        for n in nodes:
            if n.getClass().getSimpleName() == "Filter":
                below, alias = n.child(), None
                if below.getClass().getSimpleName() == "SubqueryAlias":
                    below, alias = below.child(), below.alias()
                if below.getClass().getSimpleName() == "UnresolvedRelation":
                    above[_relation(below).lower()] = (anded(n.condition()), alias)
        spark.udf.register("st_intersects", _boxes_touch)
    try:
        for name in named:
            table = client.load_table(namespace, name)
            files = table.doc["files"]
            parts, alias = above.get(name.lower(), ([], None))
            for part in parts if uses[name.lower()] == 1 else []:
                try:
                    files = table.pruned(files, [as_intersects(part) or part.sql()], alias)
                except AnalysisException:  # of subqueries or other functions: no index knows it
                    continue
            if spark.catalog.tableExists(name):
                before[name] = spark.table(name)
            table.rows(files).drop(ROW_ID).createOrReplaceTempView(name)
        yield
    finally:
        for name in named:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


@F.pandas_udf(BooleanType())
def _boxes_touch(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether bounding boxes of WKB geometries touch; false where there is no geometry."""

    def boxes(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(geometry.boxes_of(values), columns=["x0", "y0", "x1", "y1"], index=values.index)

    a, b = boxes(a), boxes(b)
    return (a.x0 <= b.x1) & (a.x1 >= b.x0) & (a.y0 <= b.y1) & (a.y1 >= b.y0)


def register(table: Table, view: str | None = None, row_id: bool = False) -> None:
    """Make the newest version a temporary view; its row id is hidden unless asked for."""
    df = table.rows() if row_id else table.rows().drop(ROW_ID)
    df.createOrReplaceTempView(view or table.name)


def register_search(table: Table, view: str, query, projection: list[str] | None = None, dynamic_fields: tuple[str, ...] = (), limit: int = 10) -> None:
    """Make the result of a top-k search a temporary view, for use in SQL."""
    table.search(query, projection, dynamic_fields, limit).createOrReplaceTempView(view)


def insert_into(table: Table, rows: DataFrame, columns: list[str] | None = None, mode: str = "append", bypass_above: int = 1000, estimate: int | None = None) -> DataFrame:
    """INSERT: ``columns`` names the rows' columns in order. ``overwrite`` replaces all rows in one version, and nothing changes if it fails; many
    rows (``estimate`` above ``bypass_above``) go straight to data files."""
    if mode not in ("append", "overwrite"):
        raise NotSupported(f"insert mode {mode}")
    rows = rows.toDF(*columns) if columns else rows
    over = mode == "overwrite"
    n = table.bypass_insert(rows, overwrite=over) if estimate is not None and estimate > bypass_above else table.insert(rows, overwrite=over)
    return counted(table.spark, n)


def delete_from(table: Table, *filters: Column | str) -> DataFrame:
    """DELETE with ANDed filters; none deletes everything."""
    return counted(table.spark, table.delete(_all(filters)))


def update_table(table: Table, set_map: dict[str, Column | str], *filters: Column | str) -> DataFrame:
    return counted(table.spark, table.update(set_map, _all(filters)))


def _all(filters: tuple) -> Column | str | bool:
    return True if not filters else filters[0] if len(filters) == 1 else conjunction([as_column(f) for f in filters])
