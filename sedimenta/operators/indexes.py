"""Secondary indexes: what they store for each data file, and how scans and searches use them.

An index is a set of Parquet tables keyed by (file name, row id), each for some
data files. Files without entries (and the inline tier) are searched directly, so an index
never changes a result. Entries of rows that are gone are dropped by the tables' deletes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, ByteType, DateType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from ..errors import InvalidInput, NotFound, NotSupported
from ..functions import geometry, vectors
from ..functions.expressions import as_column
from ..functions.rowid import ROW_ID
from ..functions.text import posting_lists, tokens

FILE = "_file"
KEYS = [FILE, ROW_ID]
K1, B = 1.2, 0.75
#: Rows (about 100 bytes each) up to which a side of a join is broadcast, or the best rows of a search come to the driver.
FEW = 10_000
#: Up to so many row ids are looked up by value, so that Parquet skips row groups without them.
NAMED = 64
_OPS = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
_FLIPPED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Compare:
    """``column op value``, the filter that an ordered index answers."""

    column: str
    op: str
    value: object

    def as_column(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.op == "in":  # a tuple of values
            return c.isin(*self.value)
        v = self.value if isinstance(self.value, Column) else F.lit(self.value)
        return {"=": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[self.op]


@dataclass(frozen=True)
class Intersects:
    """The row's bounding box touches that of a geometry (no exact geometry is tested)."""

    column: str
    geometry: bytes


@dataclass(frozen=True)
class BM25Query:
    text: str
    per_segment: bool = False  # document frequencies within each segment instead of over the table
    segments: Sequence[Sequence[str]] = ()  # names of files that are one segment; any other file is one by itself

    kind = "bm25"
    dynamic = ("score",)


@dataclass(frozen=True)
class VectorQuery:
    vector: Sequence[float]
    ef_search: int = 0  # the search is exact, so no beam is needed

    kind = "hnsw"
    dynamic = ("distance",)


@dataclass(frozen=True)
class RabitqQuery:
    vector: Sequence[float]
    rerank: int = 4  # candidates for each result that are compared exactly; 0: order by the estimates

    kind = "rabitq"
    dynamic = ("score",)


@dataclass
class Kind:
    """An index kind: the key types it takes, its parameters with their defaults, its entries and what they answer. One that
    is made known by ``register_kind`` is used by scans and searches like those that are here."""

    name: str
    params: dict = field(default_factory=dict)

    def check(self, kind, params: dict) -> None:
        raise NotImplementedError

    def entries(self, rows: DataFrame, params: dict) -> DataFrame | None:
        """Entries of rows (FILE, ROW_ID, key); None if the kind keeps none."""
        return None

    def layout(self, entries: DataFrame) -> DataFrame:
        """Entries in the order in which they are stored, so that look-ups read few row groups."""
        return entries

    def unpacked(self, entries: DataFrame) -> DataFrame:
        """Entries with one row for each row of the table and whatever else they are keyed by."""
        return entries

    def supports(self, condition) -> str | None:
        """What entries say of a filter on the key: "exact" (which rows), "inexact" (which files may have some), or None."""
        return None

    def matching(self, entries: DataFrame, params: dict, condition) -> DataFrame:
        """Entries that the filter may select."""
        raise NotSupported(f"filters of {self.name}")

    def search(self, table, index: dict, query, limit: int) -> tuple[DataFrame, bool]:
        """FILE, ROW_ID and ``_score`` of at least the ``limit`` best rows, and whether smaller is better."""
        raise NotSupported(f"search by {self.name}")


class BTree(Kind):
    def check(self, kind, params):
        if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType, StringType, DateType, TimestampType, TimestampNTZType)) and kind.typeName() != "time":
            raise NotSupported(f"an ordered index on {kind.simpleString()}")

    def entries(self, rows, params):
        return rows.where("key is not null").select(*KEYS, "key")

    def layout(self, entries):
        return entries.orderBy("key", ROW_ID)  # with the row id a key of many rows is split among tasks

    def supports(self, condition):
        return "inexact" if isinstance(condition, Compare) else None

    def matching(self, entries, params, condition):
        return entries.where(Compare("key", condition.op, condition.value).as_column())


class FullText(Kind):
    def check(self, kind, params):
        if not isinstance(kind, StringType):
            raise NotSupported(f"full-text search on {kind.simpleString()}")
        if params["avgdl"] <= 0:
            raise InvalidInput("avgdl must be positive")

    def entries(self, rows, params):
        return postings(rows)

    def layout(self, entries):
        return entries.sortWithinPartitions("term")  # a task's texts are a file sorted by term, so nothing is shuffled

    def unpacked(self, entries):
        return entries.select(FILE, "term", F.explode("rows").alias("r")).select(FILE, f"r.{ROW_ID}", "term", "r.tf", "r.len")

    def search(self, table, index, query, limit):
        """BM25 of the rows that have a term of the query; only their postings are read."""
        entries = table._all_entries(index, table.doc["files"])
        if entries is None:
            entries = self.unpacked(postings(table._keyed(index, [])))
        terms = [r[0] for r in table.spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query.text))))).collect()]
        hits = entries.where(F.col("term").isin(*terms))
        if query.per_segment:
            sizes = table.spark.createDataFrame(segments(table.doc["files"], query.segments), f"{FILE} string, segment string, n bigint")
            hits = hits.join(F.broadcast(sizes) if len(table.doc["files"]) <= FEW else sizes, FILE)
            df = hits.groupBy("segment", "term").agg(F.count(F.lit(1)).alias("df"))
            hits = hits.join(F.broadcast(df) if len(table.doc["files"]) * len(terms) <= FEW else df, ["segment", "term"])
        else:
            df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("n", F.lit(table.count()))
            hits = hits.join(F.broadcast(df) if len(terms) <= FEW else df, "term")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / index["params"]["avgdl"]))
        return hits.groupBy(*KEYS).agg(F.sum(idf * weight).alias("_score")), False


class Vectors(Kind):
    def check(self, kind, params):
        if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, FloatType):
            raise NotSupported(f"vector search on {kind.simpleString()}")

    def search(self, table, index, query, limit):
        rows = vectors.candidates(table._keyed(index, table.doc["files"]), KEYS, "key", list(query.vector), "l2", max(limit, 1))
        return rows.select(*KEYS, vectors.l2_distance(F.col("key"), list(query.vector)).alias("_score")).where("_score is not null"), True


class Rabitq(Vectors):
    def check(self, kind, params):
        super().check(kind, params)
        if params["metric"] not in ("l2", "ip") or not 1 <= params["total_bits"] <= 16:
            raise InvalidInput("metric is l2 or ip, total_bits 1 to 16")

    def entries(self, rows, params):
        return vectors.encode_vectors(rows, KEYS, "key", params["total_bits"])

    def search(self, table, index, query, limit):
        metric, q = index["params"]["metric"], list(query.vector)
        many = limit * max(query.rerank, 1)
        codes = table._all_entries(index, table.doc["files"])
        if codes is None:
            codes = vectors.encode_vectors(table._keyed(index, []), KEYS, "key", index["params"]["total_bits"])
        best = vectors.estimated(codes, KEYS, q, index["params"]["total_bits"], metric, many)
        best = best.orderBy(F.col("score").desc() if metric == "ip" else F.col("score"), ROW_ID).limit(many)
        if not query.rerank:
            return best.withColumnRenamed("score", "_score"), metric == "l2"
        exact = vectors.inner_product if metric == "ip" else vectors.l2_distance
        rows = table._keyed(index, table.doc["files"]).join(F.broadcast(best.select(*KEYS)) if many <= FEW else best.select(*KEYS), KEYS)
        return rows.select(*KEYS, exact(F.col("key"), q).alias("_score")), metric == "l2"


class RTree(Kind):
    def check(self, kind, params):
        if not isinstance(kind, BinaryType):
            raise NotSupported(f"geometries in {kind.simpleString()}")
        if params["dialect"] not in geometry.DIALECTS:
            raise InvalidInput(f"dialect {params['dialect']}")

    def entries(self, rows, params):
        return boxes(rows, params["dialect"]).where("xmin is not null")

    def layout(self, entries):
        # row groups are tiles of what a task has, so nothing is shuffled
        return entries.withColumn("tile", geometry.tile(F.col("xmin"), F.col("ymin"))).sortWithinPartitions("tile").drop("tile")

    def supports(self, condition):
        return "exact" if isinstance(condition, Intersects) else None

    def matching(self, entries, params, condition):
        want = geometry.bounding_box(condition.geometry, params["dialect"])
        if want is None:
            return entries.where("false")
        x0, y0, x1, y1 = want
        return entries.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))


KINDS: dict[str, Kind] = {}


def register_kind(kind: Kind) -> None:
    """Make an index kind known to all tables."""
    KINDS[kind.name] = kind


for _kind in (BTree("btree"), FullText("bm25", {"avgdl": 256.0}), Vectors("hnsw", {"ef_construction": 400}), Rabitq("rabitq", {"metric": "l2", "total_bits": 7}), RTree("rstar", {"dialect": "wkb"})):
    register_kind(_kind)


def anded(tree) -> list:
    """The parts that a parsed expression ANDs."""
    return anded(tree.left()) + anded(tree.right()) if tree.getClass().getSimpleName() == "And" else [tree]


def as_intersects(tree) -> Intersects | None:
    """``st_intersects(column, X'...')`` of a parsed expression."""
    if tree.getClass().getSimpleName() != "UnresolvedFunction" or tree.nameParts().last().lower() != "st_intersects" or tree.arguments().size() != 2:
        return None
    of, area = tree.arguments().apply(0), tree.arguments().apply(1)
    if of.getClass().getSimpleName() != "UnresolvedAttribute" or area.getClass().getSimpleName() != "Literal":
        return None
    return Intersects(of.nameParts().last(), bytes(area.value()))


def segments(files: list[dict], groups: Sequence[Sequence[str]]) -> list[tuple[str, str, int]]:
    """(file, its segment, live rows of the segment) of every file."""
    of = {name: group[0] for group in groups for name in group}
    if unknown := set(of) - {f["name"] for f in files}:
        raise NotFound(f"files {sorted(unknown)}")
    live: dict[str, int] = {}
    for f in files:
        segment = of.get(f["name"], f["name"])
        live[segment] = live.get(segment, 0) + f["live"]
    return [(f["name"], s := of.get(f["name"], f["name"]), live[s]) for f in files]


def postings(rows: DataFrame) -> DataFrame:
    """Lists of (row id, tf, len) for each term of some texts of a file."""
    return rows.select(*KEYS, "key").mapInArrow(posting_lists, f"{FILE} string, term string, rows array<struct<{ROW_ID}: binary, tf: int, len: int>>")


def boxes(rows: DataFrame, dialect: str) -> DataFrame:
    return rows.withColumn("b", geometry.box(F.col("key"), dialect)).select(*KEYS, "b.xmin", "b.ymin", "b.xmax", "b.ymax")


class IndexSet:
    """The part of a table that has to do with indexes."""

    def create_index(self, name: str, kind: str, columns: Sequence[str], params: dict | None = None, if_not_exists: bool = False) -> None:
        """Define an index and build its entries for all data files, in one job."""
        if any(i["name"] == name for i in self.doc["indexes"]):
            if if_not_exists:
                return
            raise InvalidInput(f"index {name} exists")
        if kind not in KINDS:
            raise NotFound(f"index kind {kind}")
        by_name = {f.name: f for f in self.fields}
        if len(columns) != 1 or (missing := [c for c in columns if c not in by_name]):
            raise InvalidInput("an index has one column") if len(columns) != 1 else NotFound(f"columns {missing}")
        if unknown := set(params or {}) - set(KINDS[kind].params):
            raise InvalidInput(f"parameters of {kind}: {sorted(unknown)}")
        params = KINDS[kind].params | (params or {})
        KINDS[kind].check(by_name[columns[0]].kind, params)
        index = {"name": name, "kind": kind, "columns": [by_name[columns[0]].id], "params": params, "parts": []}
        self._publish(lambda doc: doc["indexes"].append(index), rebase=False)
        self._index_files(self._tier("file"), [name])

    def drop_index(self, name: str, if_exists: bool = False) -> None:
        if not any(i["name"] == name for i in self.doc["indexes"]):
            if if_exists:
                return
            raise NotFound(f"index {name}")
        parts = [p["path"] for i in self.doc["indexes"] if i["name"] == name for p in i["parts"]]
        self._publish(lambda doc: doc.update(indexes=[i for i in doc["indexes"] if i["name"] != name]), rebase=False)
        for p in parts:
            self.storage.remove_dir_all(f"{self.path}/{p}")

    def index_definitions(self) -> list[dict]:
        ids = {f.id: f.name for f in self.fields}
        return [{"name": i["name"], "kind": i["kind"], "columns": [ids[c] for c in i["columns"]], "params": i["params"]} for i in self.doc["indexes"]]

    def _keyed(self, index: dict, files: list[dict]) -> DataFrame:
        name = next(f.name for f in self.fields if f.id == index["columns"][0])
        return self.rows(files, with_file=True).select(*KEYS, F.col(f"`{name}`").alias("key"))

    def _index_files(self, files: list[dict], names: list[str] | None = None) -> None:
        files = [f for f in self.doc["files"] if f["name"] in {x["name"] for x in files}]
        if not files:
            return
        for index in self.doc["indexes"]:
            entries = KINDS[index["kind"]].entries(self._keyed(index, files), index["params"]) if names is None or index["name"] in names else None
            if entries is None:
                continue
            path = f"index/{uuid.uuid4().hex}"
            KINDS[index["kind"]].layout(entries).write.option("parquet.block.row.count.limit", 100_000).parquet(self.storage.url(f"{self.path}/{path}"))
            part = {"path": path, "files": [f["name"] for f in files]}

            def change(doc, at=index["name"], part=part):
                for i in doc["indexes"]:
                    if i["name"] == at:
                        i["parts"] = [*i["parts"], part]

            self._publish(change, rebase=True)

    def _indexes(self, kind: str, column: str | None = None) -> list[dict]:
        ids = {f.id: f.name for f in self.fields}
        return [i for i in self.doc["indexes"] if i["kind"] == kind and column in (None, ids.get(i["columns"][0]))]

    def _entries(self, index: dict, files: list[dict]) -> DataFrame | None:
        """Entries of live rows of those of ``files`` that the index has."""
        names = {f["name"] for f in files}
        parts = [p for p in index["parts"] if names & set(p["files"])]
        if not parts:
            return None
        out = KINDS[index["kind"]].unpacked(self.spark.read.parquet(*[self.storage.url(f"{self.path}/{p['path']}") for p in parts]))
        if not {n for p in parts for n in p["files"]} <= names:
            out = out.where(F.col(FILE).isin(*sorted(names)))
        gone, n = self._deletes(names)
        if gone is not None:
            out = out.join(F.broadcast(gone) if n <= 100_000 else gone, KEYS, "left_anti")
        return out

    def _split(self, index: dict, files: list[dict]) -> tuple[list[dict], list[dict]]:
        """Files that the index has, and the others."""
        have = {n for p in index["parts"] for n in p["files"]}
        return [f for f in files if f["name"] in have], [f for f in files if f["name"] not in have]

    def _all_entries(self, index: dict, files: list[dict]) -> DataFrame | None:
        """Entries of all live rows: stored ones, and the others' made now."""
        known, rest = self._split(index, files)
        out = self._entries(index, known) if known else None
        live = [f for f in rest if f["live"]]
        if live:
            made = KINDS[index["kind"]].unpacked(KINDS[index["kind"]].entries(self._keyed(index, live), index["params"]))
            out = made if out is None else out.unionByName(made)
        return out

    # -- filters

    def spatial(self, filters: Sequence) -> list:
        """Filters with every ``st_intersects(column, literal)`` that SQL text ANDs as an ``Intersects``."""
        out, parser = [], self.spark._jsparkSession.sessionState().sqlParser()
        for f in filters:
            if isinstance(f, str) and "st_intersects" in f.lower():
                for part in anded(parser.parseExpression(f)):
                    out.append(as_intersects(part) or part.sql())
            else:
                out.append(f)
        return out

    def conjuncts(self, filters: Sequence, alias: str | None = None) -> list:
        """What the filters AND together, as far as indexes understand it: ``Compare`` and ``Intersects``. SQL text and
        columns are resolved against the table (as ``alias``), so literals may stand on either side and types are coerced."""
        out = []
        for f in filters:
            if isinstance(f, (Column, str)):
                empty = self.spark.createDataFrame([], StructType([StructField(ROW_ID, BinaryType()), *self.schema])).alias(alias or self.name)
                tree = empty.select(as_column(f).alias("c"))._jdf.queryExecution().analyzed().projectList().head().child()
                out.extend(self._understood(tree))
            elif not isinstance(f, bool):
                out.append(f)
        return out

    def _understood(self, tree, shared=None) -> list[Compare]:
        """Comparisons that an analysed expression ANDs; ``shared`` is what BETWEEN refers to twice."""
        kind = tree.getClass().getSimpleName()
        if kind == "Between":
            return self._understood(tree.replacement())
        if kind == "With" and tree.defs().size() == 1:
            return self._understood(tree.child(), tree.defs().apply(0).child())
        if kind == "And":
            return self._understood(tree.left(), shared) + self._understood(tree.right(), shared)
        if kind == "In":
            name, items = self._attribute(tree.value(), shared), [tree.list().apply(i) for i in range(tree.list().size())]
            return [Compare(name, "in", tuple(F.expr(i.sql()) for i in items))] if name and all(i.foldable() for i in items) else []
        if kind not in _OPS:
            return []
        for side, other, op in ((tree.left(), tree.right(), _OPS[kind]), (tree.right(), tree.left(), _FLIPPED[_OPS[kind]])):
            if other.foldable() and (name := self._attribute(side, shared)):
                return [Compare(name, op, F.expr(other.sql()))]
        return []

    @staticmethod
    def _attribute(tree, shared=None) -> str | None:
        """The column that an expression is; wider integers of it compare alike."""
        if tree.getClass().getSimpleName() == "CommonExpressionRef" and shared is not None:
            tree = shared
        if tree.getClass().getSimpleName() == "Cast" and {tree.dataType().simpleString(), tree.child().dataType().simpleString()} <= set(_WHOLE):
            tree = tree.child()
        return tree.name() if tree.getClass().getSimpleName() == "AttributeReference" else None

    def pruned(self, files: list[dict], filters: Sequence, alias: str | None = None) -> list[dict]:
        """The files that may have rows for the filters, by the indexes. Entries are stored in an order
        that suits the look-up, so it reads few row groups; what it collects is names of files."""
        if not any(i["parts"] for i in self.doc["indexes"]):
            return files
        ids = {f.id: f.name for f in self.fields}
        for c in self.conjuncts(filters, alias):
            for index in self.doc["indexes"]:
                kind = KINDS[index["kind"]]
                if ids.get(index["columns"][0]) != c.column or not kind.supports(c):
                    continue
                known, rest = self._split(index, files)
                entries = self._entries(index, known) if known else None
                if entries is not None:
                    names = {r[0] for r in kind.matching(entries, index["params"], c).select(FILE).distinct().collect()}
                    files = [f for f in known if f["name"] in names] + rest
                break
        return files

    def intersecting(self, files: list[dict], filters: Sequence[Intersects]) -> DataFrame:
        """Live rows whose box touches each geometry's, inclusive; rows without geometry never do. A few hits are taken from
        the index; many aren't joined, which would shuffle both sides: rows are tested where they are read."""
        rows = self.rows(files, with_file=True)
        for f in filters:
            indexes = self._indexes("rstar", f.column)
            dialect = indexes[0]["params"]["dialect"] if indexes else "wkb"
            hits = None
            if indexes and files and not self._split(indexes[0], files)[1]:
                entries = self._entries(indexes[0], files)
                hits = KINDS["rstar"].matching(entries, indexes[0]["params"], f).select(*KEYS)
            if hits is not None and hits.limit(FEW + 1).count() <= FEW:
                rows = rows.join(F.broadcast(hits), KEYS, "left_semi")
            else:
                rows = rows.where(geometry.touches(F.col(f"`{f.column}`"), geometry.bounding_box(f.geometry, dialect), dialect))
        return rows

    # -- top-k search

    def search(self, query, projection: Sequence[str] | None = None, dynamic_fields: Sequence[str] = (), limit: int = 10, row_id: bool = False) -> DataFrame:
        """The ``limit`` best rows, best first (ties by row id), by the first index of the query's kind.
        ``dynamic_fields`` adds the score under its name. Better is larger for bm25 and inner products,
        smaller for distances."""
        if unknown := set(dynamic_fields) - set(query.dynamic):
            raise NotFound(f"dynamic fields {sorted(unknown)}")
        if limit < 0:
            raise InvalidInput("limit")
        indexes = self._indexes(query.kind)
        if not indexes:
            raise NotFound(f"an index of kind {query.kind}")
        index = indexes[0]
        scored, ascending = KINDS[query.kind].search(self, index, query, limit)
        wanted = list(projection) if projection is not None else [f.name for f in self.fields]
        wanted = ([ROW_ID] if row_id and ROW_ID not in wanted else []) + wanted
        order = [F.col("_score").asc() if ascending else F.col("_score").desc(), F.col(ROW_ID)]
        # all rows need no order before they are joined, which would bring them to one task
        top = scored.orderBy(*order).limit(limit) if limit < self.count() or limit <= FEW else scored
        if limit <= FEW:  # few enough for the driver, which then reads their files alone
            best = top.select(*KEYS, "_score").collect()
            names, ids = {r[FILE] for r in best}, [bytes(r[ROW_ID]) for r in best]
            rows = self.rows([f for f in self.doc["files"] if f["name"] in names], with_file=True)
            if len(ids) <= NAMED:
                rows = rows.where(F.col(ROW_ID).isin(*[F.lit(i) for i in ids]))
            top = F.broadcast(self.spark.createDataFrame(best, top.select(*KEYS, "_score").schema))
        else:
            rows = self.rows(with_file=True)
        found = rows.join(top, KEYS).orderBy(*order)
        return found.select(*[F.col(f"`{c}`") for c in wanted], *[F.col("_score").alias(d) for d in dynamic_fields])
