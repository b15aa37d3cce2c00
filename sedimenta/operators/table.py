"""Tables: scans, counts, row-level writes and schema changes, each a Spark plan over one manifest version.

A table is a set of immutable Parquet files in two tiers (``inline`` for what small inserts left,
``file``) and a set of deletes, (file name, row id) pairs that are subtracted when
reading. A writer adds files and deletes and publishes a new manifest; of two writers
that delete or rewrite at the same time, one gets a Conflict.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..errors import Conflict, InvalidInput, NotFound
from ..functions.expressions import as_column
from ..functions.rowid import ROW_ID, with_row_ids
from ..sources.schema import aligned, from_json, logical_schema, make_field, physical_schema, to_json
from ..sources.storage import Versioned
from .indexes import FEW, FILE, Compare, Intersects, IndexSet

#: Deletes up to this many rows (about 100 bytes each) are broadcast; more are shuffled.
BROADCAST_DELETES = 100_000


@dataclass(frozen=True)
class Partition:
    """A share of a scan: part ``index`` of ``count``, or files by name with or without the inline tier."""

    index: int = 0
    count: int = 1
    files: tuple[str, ...] | None = None
    inline: bool = False

    def __post_init__(self):
        if self.files is None and (self.count < 1 or not 0 <= self.index < self.count):
            raise InvalidInput(f"partition {self.index} of {self.count}")


class Table(IndexSet):
    def __init__(self, client, namespace: str, name: str, path: str):
        self.client, self.namespace, self.name, self.path = client, namespace, name, path
        self.spark, self.storage = client.spark, client.storage
        self._manifest = Versioned(self.storage, f"{path}/manifest")
        self.refresh()

    # -- metadata

    def refresh(self) -> Table:
        self.version, self.doc = self._manifest.load()
        if self.doc is None:
            raise NotFound(f"table {self.namespace}.{self.name}")
        self.fields = from_json(self.doc["fields"])
        return self

    def _publish(self, change: Callable[[dict], None], rebase: bool) -> None:
        """Publish the manifest that ``change`` makes. Appends are made again on top of another
        writer's version (``rebase``); what was computed from rows that may have changed isn't."""
        for _ in range(20):
            doc = {**self.doc, "files": [dict(f) for f in self.doc["files"]], "deletes": list(self.doc["deletes"]), "indexes": [dict(i) for i in self.doc["indexes"]]}
            change(doc)
            try:
                self._manifest.publish(self.version, doc)
                self.refresh()
                return
            except Conflict:
                if not rebase:
                    raise
                self.refresh()
        raise Conflict(self.name)

    @property
    def schema(self) -> StructType:
        return logical_schema(self.fields)

    @property
    def config(self) -> dict:
        return self.doc["config"]

    def _tier(self, tier: str) -> list[dict]:
        return [f for f in self.doc["files"] if f["tier"] == tier]

    def data_file_records(self) -> list[dict]:
        """Name, row count, live row count, bytes and format of each data file, in order of age."""
        return [{k: f[k] for k in ("name", "rows", "live", "bytes", "format")} for f in self._tier("file")]

    def data_file_count(self) -> int:
        return len(self._tier("file"))

    def inline_row_count(self) -> int:
        return sum(f["live"] for f in self._tier("inline"))

    def size(self) -> int:
        """Bytes of all files that the newest version refers to."""
        return sum(f["bytes"] for f in self.doc["files"])

    def count(self, partitions: Sequence[Partition] | None = None) -> int | list[int]:
        """Live rows from the manifest alone; with partitions, of each."""
        if partitions is None:
            return sum(f["live"] for f in self.doc["files"])
        return [sum(f["live"] for f in self._chosen(p)) for p in partitions]

    # -- reading

    def _chosen(self, p: Partition | None) -> list[dict]:
        """Files of a partition: contiguous shares, the last takes the rest, the first the inline tier."""
        if p is None:
            return self.doc["files"]
        files = self._tier("file")
        if p.files is not None:
            if unknown := set(p.files) - {f["name"] for f in files}:
                raise NotFound(f"data files {sorted(unknown)}")
            return [f for f in files if f["name"] in p.files] + (self._tier("inline") if p.inline else [])
        step = max(len(files) // p.count, 1)
        last = len(files) if p.index == p.count - 1 else (p.index + 1) * step
        return files[p.index * step : last] + (self._tier("inline") if p.index == 0 else [])

    def partitions(self, count: int = 16, most_files: int = 1000) -> list[Partition]:
        """``count`` parts of the files whose sizes differ by one file at most, the first with the inline
        tier; beyond ``most_files`` contiguous shares, which don't list names."""
        files = [f["name"] for f in self._tier("file")]
        if len(files) > most_files:
            return [Partition(i, count) for i in range(count)]
        step, more = divmod(len(files), count)
        cuts = [i * step + min(i, more) for i in range(count + 1)]
        return [Partition(files=tuple(files[a:b]), inline=i == 0) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def _deletes(self, names: set[str]) -> tuple[DataFrame | None, int]:
        hit = [d for d in self.doc["deletes"] if names & set(d["files"])]
        if not hit:
            return None, 0
        out = self.spark.read.schema(f"{FILE} string, {ROW_ID} binary").parquet(*[self.storage.url(f"{self.path}/{d['path']}") for d in hit])
        return out, sum(d["rows"] for d in hit)

    def rows(self, files: list[dict] | None = None, with_file: bool = False) -> DataFrame:
        """Live rows with row id (and file name): one scan for each set of columns that files have;
        files without deletes need no join."""
        files = self.doc["files"] if files is None else files
        names = [ROW_ID] + [f.name for f in self.fields] + ([FILE] if with_file else [])
        kinds = StructType([StructField(ROW_ID, physical_schema([])[0].dataType), *self.schema, *([StructField(FILE, StringType())] if with_file else [])])
        parts = []
        groups: dict[tuple, list[dict]] = {}
        for f in files:
            if f["live"]:
                groups.setdefault((tuple(f["columns"]), f["live"] < f["rows"]), []).append(f)
        for (columns, dirty), own in groups.items():
            have = [f for f in self.fields if f.id in columns]
            df = self.spark.read.schema(physical_schema(have)).parquet(*[self.storage.url(f"{self.path}/{f['path']}") for f in own])
            if with_file or dirty:
                df = df.withColumn(FILE, F.col("_metadata.file_name"))
            if dirty:
                gone, n = self._deletes({f["name"] for f in own})
                if gone is not None:
                    df = df.join(F.broadcast(gone) if n <= BROADCAST_DELETES else gone, [FILE, ROW_ID], "left_anti")
            # columns that were added after the file was written have their default
            extra = [FILE] if with_file else []
            df = df.select(ROW_ID, *[F.col(f.physical).alias(f.name, metadata=f.metadata) for f in have], *extra)
            missing = {f.name: F.expr(f.default or "null").cast(f.kind).alias(f.name, metadata=f.metadata) for f in self.fields if f.id not in columns}
            df = df.select(ROW_ID, *[missing.get(f.name, F.col(f"`{f.name}`")) for f in self.fields], *extra) if missing else df
            parts.append(df)
        if not parts:
            return self.spark.createDataFrame([], kinds)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(*[F.col(f"`{n}`") for n in names]).alias(self.name)

    def df(self) -> DataFrame:
        """All live rows without their ids."""
        return self.rows().drop(ROW_ID)

    def scan(self, projection: Sequence[str] | None = None, filters: Sequence[Column | str] = (), partition: Partition | None = None, offset: int = 0, limit: int | None = None, row_id: bool = False, batch_size: int = 1024) -> DataFrame:
        """Filter, then project, then page. NULL conditions select nothing. Pages are in the order of the row ids.
        Files that an index rules out, or whose rows lie before or after the page, aren't read."""
        if projection is not None and not projection:
            raise InvalidInput("an empty projection")
        if batch_size < 1 or offset < 0 or (limit is not None and limit < 0):
            raise InvalidInput("batch_size, offset or limit")
        names = [f.name for f in self.fields]
        wanted = list(projection) if projection is not None else ([ROW_ID] if row_id else []) + names
        if missing := [c for c in wanted if c != ROW_ID and c not in names]:
            raise NotFound(f"columns {missing}")
        filters = self.spatial(filters)
        files = self.pruned(self._chosen(partition), filters)
        paged, apart = bool(offset) or limit is not None, False
        if not filters and paged:
            apart = self._apart(files) is not None
            files, offset = self._paged(files, offset, limit)
        boxed = [f for f in filters if isinstance(f, Intersects)]
        out = self.intersecting(files, boxed) if boxed else self.rows(files)
        for f in filters:
            if not isinstance(f, Intersects):
                out = out.where(self._condition(f.as_column() if isinstance(f, Compare) else f))
        if paged:
            out = self._page(out, files if apart else None, offset, limit)
        return out.select(*[F.col(f"`{c}`") for c in wanted])

    def _condition(self, c: Column | str | bool) -> Column:
        c = F.lit(c) if isinstance(c, bool) else as_column(c)
        kinds = StructType([StructField(ROW_ID, physical_schema([])[0].dataType), *self.schema])
        kind = self.spark.createDataFrame([], kinds).alias(self.name).select(c.alias("c")).schema["c"].dataType
        if not isinstance(kind, BooleanType) and kind.typeName() != "void":
            raise InvalidInput(f"a condition of {kind.simpleString()}")
        return c.cast("boolean")

    def _paged(self, files: list[dict], offset: int, limit: int | None) -> tuple[list[dict], int]:
        """Files that a page without filter may touch, and how much of the offset is left: by counts alone files are
        skipped whose rows come before it or after it, where files are apart in row ids."""
        ranges = self._apart(files)
        if ranges is None:
            return files, offset
        chosen, at = [], 0
        for f in ranges:
            if at + f["live"] <= offset and not chosen:
                at += f["live"]
            elif limit is None or at < offset + limit:
                chosen.append(f)
                at += f["live"]
        return chosen, offset - (at - sum(f["live"] for f in chosen))

    @staticmethod
    def _apart(files: list[dict]) -> list[dict] | None:
        """Files with rows in the order of their ranges of row ids; None where these aren't known or overlap."""
        ranges = sorted((f for f in files if f["live"]), key=lambda f: f.get("ids", ["", ""]))
        if any("ids" not in f for f in ranges) or any(a["ids"][1] >= b["ids"][0] for a, b in zip(ranges, ranges[1:])):
            return None
        return ranges

    def _page(self, rows: DataFrame, apart: list[dict] | None, offset: int, limit: int | None) -> DataFrame:
        """A page of rows in the order of their ids. A limit would bring a large one to one task, so the ids where it begins and ends are
        looked up: in its first and last file where all of ``apart`` are whole and apart, else by counts of all rows."""
        if limit is not None and offset + limit <= FEW:
            return rows.orderBy(ROW_ID).offset(offset).limit(limit)
        end, total = None if limit is None else offset + limit, None
        first = last = rows
        before = 0
        if apart is not None:
            total = sum(f["live"] for f in apart)
            if apart:
                first, last, before = self.rows(apart[:1]), self.rows(apart[-1:]), total - apart[-1]["live"]
        if total is not None and offset >= total:
            return rows.where("false")
        try:
            low = nth_id(first, offset) if offset else b""
            high = None if end is None or (total is not None and end >= total) else nth_id(last, end - before)
        except InvalidInput:  # rows that share the id where the page begins or ends
            page = rows.orderBy(ROW_ID).offset(offset)
            return page if limit is None else page.limit(limit)
        if low is None:
            return rows.where("false")
        rows = rows.where(F.col(ROW_ID) >= F.lit(low)) if low else rows
        return (rows if high is None else rows.where(F.col(ROW_ID) < F.lit(high))).orderBy(ROW_ID)

    def fetch(self, ids: DataFrame, projection: Sequence[str] | None = None) -> DataFrame:
        """The rows whose ids ``ids`` holds, by a semi join over the files whose range of ids reaches those asked for."""
        out = self.rows(self._reached(ids)).join(ids.select(ROW_ID), ROW_ID, "left_semi")
        return out.select(*(projection or [f.name for f in self.fields]))

    def _reached(self, ids: DataFrame) -> list[dict]:
        """Files whose range of row ids reaches those of ``ids``."""
        lo, hi = (r and bytes(r).hex() for r in ids.agg(F.min(ROW_ID), F.max(ROW_ID)).first())
        return [f for f in self.doc["files"] if lo and f.get("ids", [lo, hi])[0] <= hi and lo <= f.get("ids", [lo, hi])[1]]

    # -- writing

    def _write(self, df: DataFrame, tier: str, per_file: int | None = None) -> list[dict]:
        """Write rows under physical names; a record for each file, with its rows and its range of row ids."""
        folder = f"data/{uuid.uuid4().hex}"
        url = self.storage.url(f"{self.path}/{folder}")
        writer = df.write.option("parquet.writer.version", "v2" if self.config["preferred_data_file_format"] == "v2" else "v1")
        if self.config["parquet_row_group_size"]:
            writer = writer.option("parquet.block.row.count.limit", self.config["parquet_row_group_size"])
        if per_file:
            writer = writer.option("maxRecordsPerFile", per_file)
        writer.parquet(url)
        written = self.spark.read.schema(f"{ROW_ID} binary").parquet(url).groupBy(F.col("_metadata.file_name")).agg(F.count(F.lit(1)), F.min(ROW_ID), F.max(ROW_ID)).collect()
        counts = {r[0]: r[1] for r in written}
        ids = {r[0]: [bytes(x).hex() for x in r[2:]] for r in written}
        sizes = {name: n for name, n, *_ in self.storage.list(f"{self.path}/{folder}")}
        columns = [c[1:] for c in df.columns if c not in (ROW_ID, FILE)]
        return [
            {"name": name, "path": f"{folder}/{name}", "tier": tier, "rows": n, "live": n, "bytes": sizes[name], "ids": ids[name], "columns": columns, "format": self.config["preferred_data_file_format"]}
            for name, n in sorted(counts.items())
        ]

    def _write_deletes(self, df: DataFrame) -> tuple[list[dict], dict[str, int]]:
        """Write (file, row id) pairs; the record, and how many rows each file lost."""
        path = f"deletes/{uuid.uuid4().hex}"
        df.select(FILE, ROW_ID).write.parquet(self.storage.url(f"{self.path}/{path}"))
        lost = {r[0]: r[1] for r in self.spark.read.schema(f"{FILE} string, {ROW_ID} binary").parquet(self.storage.url(f"{self.path}/{path}")).groupBy(FILE).count().collect()}
        return ([{"path": path, "rows": sum(lost.values()), "files": sorted(lost)}] if lost else []), lost

    @staticmethod
    def _lose(doc: dict, lost: dict[str, int]) -> None:
        for f in doc["files"]:
            f["live"] -= lost.get(f["name"], 0)
        doc["files"] = [f for f in doc["files"] if f["live"]]
        forget(doc)

    def _add(self, files: list[dict], overwrite: bool = False, batch: tuple[str, int] | None = None) -> bool:
        """Publish new files; ``overwrite`` puts them in the place of all that the handle's version has. A ``batch`` (stream, number) that
        the table has already is left out: false. It is noted in the same version as its rows."""
        done = False

        def change(doc):
            nonlocal done
            if batch and doc.get("streams", {}).get(batch[0], -1) >= batch[1]:
                done = True
                return
            if batch:
                doc["streams"] = doc.get("streams", {}) | {batch[0]: batch[1]}
            if overwrite:
                doc["files"] = []
            doc["files"].extend(files)
            forget(doc)

        self._publish(change, rebase=not overwrite)
        return not done

    def insert(self, df: DataFrame, keep_row_ids: bool = False, try_dump: bool = True, overwrite: bool = False, batch: tuple[str, int] | None = None) -> int:
        """Append to the inline tier; returns the number of rows. Then dump() if the tier is full. ``overwrite``: instead of all
        rows there are, in one version, once the new ones are written. ``batch``: see _add; one that repeats inserts nothing."""
        rows = aligned(df, self.fields, keep_row_ids)
        files = self._write(rows if keep_row_ids else with_row_ids(rows), "inline")
        if not self._add(files, overwrite, batch):
            return 0
        if try_dump and self.inline_row_count() >= self.config["inline_row_count_limit"]:
            from .maintenance import dump

            dump(self)
        return sum(f["rows"] for f in files)

    def bypass_insert(self, df: DataFrame, overwrite: bool = False) -> int:
        """Append straight to data files of at most ``inline_row_count_limit`` rows each; ``overwrite`` as for insert."""
        files = self._write(with_row_ids(aligned(df, self.fields, False)), "file", self.config["inline_row_count_limit"])
        self._add(files, overwrite)
        self._index_files(files)
        return sum(f["rows"] for f in files)

    def update(self, set_map: dict[str, Column | str], condition: Column | str | bool = True) -> int:
        """SET columns (expressions see the old row) where the condition is true; row ids stay.
        Changed rows move to the inline tier in the same write that lists what they replace; as many as would fill it become data
        files. Files that an index rules out aren't read."""
        by_name = {f.name: f for f in self.fields}
        if not set_map or (unknown := set(set_map) - set(by_name)):
            raise InvalidInput(f"columns to set: {sorted(set_map)}") if not set_map else NotFound(f"columns {sorted(unknown)}")
        hit = self.rows(self.pruned(self.doc["files"], [condition]), with_file=True).where(self._condition(condition))
        values = []
        for f in self.fields:
            v = as_column(set_map[f.name]) if f.name in set_map else F.col(f"`{f.name}`")
            if f.name in set_map:
                got = hit.select(v.alias("v")).schema["v"].dataType
                v = v.cast(f.kind) if got != f.kind else v
                if not f.nullable:
                    v = F.when(v.isNull(), F.raise_error(F.lit(f"{f.name} is NULL")).cast(f.kind)).otherwise(v)
            values.append(v.alias(f.physical))
        # the new rows carry the file they come from, so matching runs once and its result is durable
        files = self._write(hit.select(ROW_ID, *values, FILE), "inline", self.config["inline_row_count_limit"])
        if not files:
            return 0
        large = sum(f["rows"] for f in files) >= self.config["inline_row_count_limit"]
        if large:  # nothing would be gained by moving them once more
            files = [f | {"tier": "file"} for f in files]
        written = self.spark.read.schema(f"{ROW_ID} binary, {FILE} string").parquet(*[self.storage.url(f"{self.path}/{f['path']}") for f in files])
        deletes, lost = self._write_deletes(written)

        def change(doc):
            self._lose(doc, lost)
            doc["files"].extend(files)
            doc["deletes"].extend(deletes)

        self._publish(change, rebase=False)
        if large:
            self._index_files(files)
        return sum(lost.values())

    def delete(self, condition: Column | str | bool) -> int:
        """Delete where the condition is true. A constant TRUE truncates, FALSE and NULL do nothing."""
        c = self._condition(condition)
        constant = None if ROW_ID in str(c) else self._constant(c)
        if constant is True:
            return self.truncate()
        if constant is False:
            return 0
        files = self.pruned(self.doc["files"], [condition])
        return self._delete(self.rows(files, with_file=True).where(c))

    def delete_ids(self, ids: DataFrame) -> int:
        """Delete the rows whose ids ``ids`` holds; others and ids that repeat are ignored."""
        return self._delete(self.rows(self._reached(ids), with_file=True).join(ids.select(ROW_ID), ROW_ID, "left_semi"))

    def _delete(self, rows: DataFrame) -> int:
        deletes, lost = self._write_deletes(rows.select(FILE, ROW_ID))
        if not lost:
            return 0

        def change(doc):
            self._lose(doc, lost)
            doc["deletes"].extend(deletes)

        self._publish(change, rebase=False)
        return sum(lost.values())

    def _constant(self, condition: Column) -> bool | None:
        """The value of a condition that uses no column; NULL counts as false."""
        plan = self.spark.createDataFrame([], self.schema).alias(self.name).select(condition)._jdf.queryExecution().analyzed()
        if not plan.projectList().head().references().isEmpty() or not plan.projectList().head().deterministic():
            return None
        return bool(self.spark.range(1).select(condition).first()[0])

    def truncate(self) -> int:
        gone = self.count()

        def change(doc):
            doc["files"] = []
            forget(doc)

        self._publish(change, rebase=False)
        return gone

    def drop(self) -> None:
        self.client.forget_table(self.namespace, self.name)
        self.storage.remove_dir_all(self.path)

    # -- schema changes

    def rename(self, new: str) -> None:
        self.client.rename_table(self.namespace, self.name, new)
        self.name = new

    def rename_column(self, old: str, new: str) -> None:
        names = [f.name for f in self.fields]
        if old not in names:
            raise NotFound(f"column {old}")
        if new in names or new == ROW_ID:
            raise InvalidInput(f"column {new} exists")
        fields = [f if f.name != old else type(f)(**{**vars(f), "name": new}) for f in self.fields]
        self._publish(lambda doc: doc.update(fields=to_json(fields)), rebase=False)

    def add_column(self, column: StructField, default: str | None = None) -> None:
        """A new last column. Rows that are there have its default, filled in when they are read."""
        if column.name in [f.name for f in self.fields] or column.name == ROW_ID:
            raise InvalidInput(f"column {column.name} exists")
        if default is None and not column.nullable:
            raise InvalidInput(f"{column.name} needs a default")
        new = make_field(self.spark, column, default, StructType([*self.schema, column]))
        self._publish(lambda doc: doc.update(fields=to_json([*self.fields, new])), rebase=False)

    def drop_column(self, name: str) -> None:
        """Forget a column (nothing happens if there is none of that name); an indexed one is refused."""
        gone = next((f for f in self.fields if f.name == name), None)
        if gone is None:
            return
        if any(gone.id in i["columns"] for i in self.doc["indexes"]):
            raise InvalidInput(f"{name} is indexed")
        if len(self.fields) == 1:
            raise InvalidInput("a table needs a column")
        self._publish(lambda doc: doc.update(fields=to_json([f for f in self.fields if f.id != gone.id])), rebase=False)


def nth_id(rows: DataFrame, n: int) -> bytes | None:
    """The beginning of the row id that has ``n`` before it, which none before it reaches; None if there are no more. Ids are counted by
    their beginnings, two bytes more at a time, so no task sorts them and at most 65,537 counts come to the driver."""
    ids = rows.select(ROW_ID)
    ends = [r and bytes(r) for r in ids.agg(F.min(ROW_ID), F.max(ROW_ID)).first()]
    if ends[0] is None:
        return None
    begin = os.path.commonprefix(ends)
    while True:
        some = ids.where(F.substring(ROW_ID, 1, len(begin)) == F.lit(begin)) if begin else ids
        size = len(begin) + 2
        for part, count in sorted((bytes(r[0]), r[1]) for r in some.groupBy(F.substring(ROW_ID, 1, size)).count().collect()):
            if n < count:
                break
            n -= count
        else:
            return None
        if not n:
            return part
        if len(part) < size:
            raise InvalidInput(f"{count} rows of one id")
        begin = part


def forget(doc: dict) -> None:
    """Drop deletes and index parts of which no file is left."""
    left = {f["name"] for f in doc["files"]}
    doc["deletes"] = [d for d in doc["deletes"] if left & set(d["files"])]
    for i in doc["indexes"]:
        i["parts"] = [p for p in i["parts"] if left & set(p["files"])]


def counted(spark, n: int) -> DataFrame:
    """The one row that a statement returns."""
    return spark.createDataFrame([(n,)], StructType([StructField("count", LongType(), False)]))

