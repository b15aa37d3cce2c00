"""Background work on a table: moving inline rows to files, merging small files, removing orphans.

None changes what a scan returns. A lease keeps two workers from doing the same work at once.
"""

from __future__ import annotations

import time
from contextlib import contextmanager, suppress

from pyspark.sql import functions as F

from ..errors import Conflict
from ..functions.rowid import ROW_ID
from ..sources.storage import Versioned
from .table import forget


@contextmanager
def lease(table, task: str, seconds: float = 3600):
    """True if this worker holds the task; false if another one does. A lease is a version of a document, so of two workers that
    take over one that ran out only one gets it, and only its holder gives it back."""
    held, doc = None, Versioned(table.storage, f"{table.path}/leases/{task}")
    version, now = doc.load()
    if (now or {}).get("until", 0) < time.time():
        with suppress(Conflict):
            held = doc.publish(version, {"until": time.time() + seconds})
    try:
        yield held is not None
    finally:
        if held is not None:
            with suppress(Conflict):  # it ran out and another worker has it
                doc.publish(held, {"until": 0})


def dump(table) -> int:
    """If the inline tier has ``inline_row_count_limit`` live rows or more, move the first by row id, as many lots of that
    size as there are, to data files of at most one lot each, in one job. Returns the number of rows moved."""
    with lease(table, "dump") as held:
        limit, live = table.config["inline_row_count_limit"], table.inline_row_count()
        lots, left = divmod(live, limit)
        if not held or not lots:
            return 0
        inline = table._tier("inline")
        rows = physical(table, inline)
        rest = []
        if left:  # fewer than a lot: the greatest ids stay
            edge = rows.select(ROW_ID).orderBy(F.col(ROW_ID).desc()).limit(left).agg(F.min(ROW_ID)).first()[0]
            rest = table._write(rows.where(F.col(ROW_ID) >= F.lit(edge)), "inline")
            rows = rows.where(F.col(ROW_ID) < F.lit(edge))
        files = table._write(_ordered(rows, lots), "file", limit)
        _replace(table, inline, files + rest)
        table._index_files(files)
        return live - left


def _ordered(rows, parts: int):
    """Rows in ``parts`` ranges of row ids, sorted."""
    return (rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, ROW_ID)).sortWithinPartitions(ROW_ID)


def physical(table, files: list[dict]):
    """Live rows of files under physical names."""
    df = table.rows(files)
    return df.select(ROW_ID, *[df[f"`{f.name}`"].alias(f.physical) for f in table.fields])


def _replace(table, old: list[dict], new: list[dict]) -> None:
    gone = {f["name"] for f in old}

    def change(doc):
        doc["files"] = [f for f in doc["files"] if f["name"] not in gone] + new
        forget(doc)

    table._publish(change, rebase=False)


def merge(table, valid_row_threshold: int | None = None) -> int:
    """Rewrite data files that have fewer live rows than the threshold (half of
    ``inline_row_count_limit``), in order, in groups of at least ``inline_row_count_limit`` live rows, all in one job; a last group that
    doesn't reach it stays as it is. Returns the number of files that were replaced."""
    limit = table.config["inline_row_count_limit"]
    threshold = limit // 2 if valid_row_threshold is None else valid_row_threshold
    with lease(table, "merge") as held:
        if not held:
            return 0
        old, group, groups, size = [], [], 0, 0
        for f in [f for f in table._tier("file") if f["live"] < threshold]:
            group.append(f)
            size += f["live"]
            if size >= limit:
                old, groups = old + group, groups + 1
                group, size = [], 0
        if not old:
            return 0
        files = table._write(_ordered(physical(table, old), groups), "file")
        _replace(table, old, files)
        table._index_files(files)
        return len(old)


def cleanup(table, older_than: float) -> list[str]:
    """Delete files of the table that are older than a time (seconds since 1970) and that the newest manifest doesn't
    use; returns their paths."""
    table.refresh()
    used = {f["path"] for f in table.doc["files"]}
    whole = {d["path"] for d in table.doc["deletes"]} | {part["path"] for i in table.doc["indexes"] for part in i["parts"]}
    gone = []
    with lease(table, "cleanup") as held:
        if not held:
            return []
        for kind in ("data", "deletes", "index"):
            for folder, _, changed, _ in table.storage.list(f"{table.path}/{kind}"):
                path = f"{kind}/{folder}"
                inside = table.storage.list(f"{table.path}/{path}")
                if path in whole or max([changed, *(c for _, _, c, _ in inside)]) / 1000 >= older_than:
                    continue
                if not any(f"{path}/{name}" in used for name, *_ in inside):
                    table.storage.remove_dir_all(f"{table.path}/{path}")
                    gone.append(path)
                    continue
                for name, _, _, _ in inside:
                    if name.endswith(".parquet") and f"{path}/{name}" not in used:
                        table.storage.delete(f"{table.path}/{path}/{name}")
                        gone.append(f"{path}/{name}")
    return gone


def rebuild_inline_indexes(table, names: list[str] | None = None) -> int:
    """Inline rows are searched directly, so there is nothing to rebuild: the number of indexes that would be."""
    known = [i["name"] for i in table.doc["indexes"]]
    return len([n for n in known if names is None or n in names])
