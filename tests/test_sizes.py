"""Queries where a table is many files, as large ones are."""

import re
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import connect, same
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from sedimenta.functions import geometry, text
from sedimenta.functions.rowid import ROW_ID
from sedimenta.operators import indexes, table
from sedimenta.operators.indexes import BM25Query, Intersects
from sedimenta.plans import registry, scans
from sedimenta.sources import catalog
from sedimenta.sources.catalog import Client


@pytest.fixture(scope="module")
def client(spark):
    c = Client(spark)
    c.create_namespace("test")
    return c


def test_segments_of_several_files(spark, sf, monkeypatch):
    monkeypatch.setitem(catalog.DEFAULTS, "inline_row_count_limit", 20)
    same(registry.QUERIES["bm25_per_segment_idf"](spark, sf), connect(sf), registry.ORACLES["bm25_per_segment_idf"])


def test_line_ends_are_tokens(client, spark):
    t = client.create_table("test", "ends", StructType([StructField("id", LongType()), StructField("text", StringType())]))
    t.bypass_insert(spark.createDataFrame([(1, "a\rb \u0085"), (2, "a\n\nb"), (3, None)], t.schema))
    t.create_index("words", "bm25", ["text"])
    lengths = t._all_entries(t.doc["indexes"][0], t.doc["files"]).where("term = 'a'").select("len").collect()
    assert sorted(r[0] for r in lengths) == [2, 5]
    assert [r[0] for r in t.search(BM25Query("\r"), ["id"]).collect()] == [1]


TEXTS = ["the cat and the dog", "", None, "\n\n", "a\n", "über, the naïve x \r\n 7z", "日本 and 🎉🎉", "word9" * 50, " ", "tail the"]


def test_postings_are_the_tokens(client, spark, monkeypatch):
    schema = StructType([StructField("id", LongType()), StructField("text", StringType())])
    t = client.create_table("test", "posted", schema, config={"inline_row_count_limit": 4})
    t.bypass_insert(spark.createDataFrame(list(enumerate(TEXTS)), schema).coalesce(1))
    t.create_index("words", "bm25", ["text"])
    want = sorted((i, w, found.count(w), len(found)) for i, s in enumerate(TEXTS) if s for found in [re.findall("[A-Za-z0-9]+|[^\n]", s)] for w in set(found))
    entries = t._all_entries(t.doc["indexes"][0], t.doc["files"])
    got = entries.join(t.rows(with_file=True), ["_file", "_row_id"]).select("id", "term", "tf", "len")
    assert sorted(map(tuple, got.collect())) == want
    for at_once in (1, 7, 40):  # texts in lots, long ones in pieces
        monkeypatch.setattr(text, "AT_ONCE", at_once)
        rows = pa.RecordBatch.from_arrays([pa.array(["f"] * 5 + ["g"] * 5), pa.array([bytes([i]) for i in range(10)]), pa.array(TEXTS)], names=["_file", "_row_id", "key"])
        lists = [(p["_file"], r["_row_id"][0], p["term"], r["tf"], r["len"]) for b in text.posting_lists([rows.slice(0, 10)]) for p in b.to_pylist() for r in p["rows"]]
        assert sorted(r[1:] for r in lists) == want and all(f == "fg"[i // 5] for f, i, *_ in lists)


def test_postings_are_made_without_a_shuffle_and_all_rows_without_one_task(client, spark):
    t = client.create_table("test", "spread", StructType([StructField("id", LongType()), StructField("text", StringType())]))
    t.bypass_insert(spark.createDataFrame([(i, "the cat") for i in range(20)], t.schema))
    t.create_index("words", "bm25", ["text"])
    kind, index = indexes.KINDS["bm25"], t.doc["indexes"][0]
    assert "Exchange" not in kind.layout(kind.entries(t._keyed(index, t.doc["files"]), {}))._jdf.queryExecution().executedPlan().toString()
    monkey = pytest.MonkeyPatch()
    monkey.setattr(indexes, "FEW", 10)
    found = t.search(BM25Query("the"), ["id"], ["score"], 20)
    monkey.undo()
    assert found.count() == 20 and "Limit" not in found._jdf.queryExecution().executedPlan().toString()


def test_last_places_by_key(spark, tmp_path):
    rows = [(100 - i, "the cat and the dog", "en", "s", i) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("bm25_top10_rows", "bm25_search"):
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        same(registry.QUERIES[name](spark, str(tmp_path)), con, registry.ORACLES[name])


def test_many_boxes_are_neither_shuffled_nor_joined(client, spark, monkeypatch):
    t = client.create_table("test", "placed", StructType([StructField("id", LongType()), StructField("geom", BinaryType())]), config={"inline_row_count_limit": 20})
    x, y = F.col("id") % 10, -F.col("id") / 10.0
    points = spark.range(100).select("id", geometry.point_wkb(F.when(F.col("id") != 7, x), y).alias("geom"))
    t.bypass_insert(points)
    assert [bytes(r[0]) if r[0] else None for r in points.orderBy("id").select("geom").collect()] == [struct.pack("<BIdd", 1, 1, i % 10, -i / 10) if i != 7 else None for i in range(100)]
    t.create_index("boxes", "rstar", ["geom"])
    kind, index = indexes.KINDS["rstar"], t.doc["indexes"][0]
    assert "Exchange" not in kind.layout(kind.entries(t._keyed(index, t.doc["files"]), index["params"]))._jdf.queryExecution().executedPlan().toString()
    t.delete("id = 15")
    area, other = (struct.pack("<BIII10d", 1, 3, 1, 5, *b) for b in ((3, -5, 6, -5, 6, -1, 3, -1, 3, -5), (5, -9, 9, -9, 9, 0, 5, 0, 5, -9)))
    for few in (indexes.FEW, 3):
        monkeypatch.setattr(indexes, "FEW", few)
        for filters, want in (([Intersects("geom", area)], {i for i in range(10, 51) if 3 <= i % 10 <= 6} - {15}), ([Intersects("geom", area), Intersects("geom", other)], {i for i in range(10, 51) if 5 <= i % 10 <= 6} - {15})):
            found = t.scan(["id"], filters)
            assert {r[0] for r in found.collect()} == want
        assert few > 3 or "SemiJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "LeftSemi" not in plan


def test_boxes_of_arrow_arrays():
    point = lambda x, y, order="<": struct.pack(f"{order}BIdd", order == "<", 1, x, y)
    line = struct.pack("<BII4d", 1, 2, 2, 0, 5, 3, -1)
    values = pa.array([b"", point(9, 9), None, point(1, 2), line, point(3, 4, ">"), point(-0.5, 1e300)][1:], pa.binary())
    got = geometry.arrow_boxes(values.slice(1))
    assert np.array_equal(got, [[np.nan] * 4, [1, 2, 1, 2], [0, -1, 3, 5], [3, 4, 3, 4], [-0.5, 1e300, -0.5, 1e300]], equal_nan=True)


@pytest.mark.parametrize("apart", [True, False])
def test_large_pages_pass_no_single_task(client, spark, monkeypatch, apart):
    monkeypatch.setattr(table, "FEW", 0)
    t = client.create_table("test", f"pages_{apart}", StructType([StructField("id", LongType(), False)]), config={"inline_row_count_limit": 10})
    for i in range(4):
        t.bypass_insert(spark.range(10 * i, 10 * i + 10).coalesce(1))
    t.delete("id in (3, 15)")
    if not apart:
        t.update({"id": "id + 100"}, "id % 5 = 1")  # keeps ids, so the new file reaches over the others
    assert (t._apart(t.doc["files"]) is not None) == apart
    ordered = [(r["id"]) for r in t.rows().orderBy(ROW_ID).collect()]
    for offset, limit in ((0, 3), (9, 1), (8, 20), (12, 0), (37, None), (36, 5), (38, 5), (99, 1)):
        page = t.scan(offset=offset, limit=limit)
        assert [r[0] for r in page.collect()] == ordered[offset:][:limit]
        assert "Limit" not in page._jdf.queryExecution().executedPlan().toString()
    even = [i for i in ordered if i % 2 == 0]
    assert [r[0] for r in t.scan(filters=["id % 2 = 0"], offset=5, limit=7).collect()] == even[5:12]
    assert [r[0] for r in t.scan(filters=["id % 2 = 0"], offset=50, limit=7).collect()] == []


def test_pages_where_rows_share_ids(client, spark, monkeypatch):
    monkeypatch.setattr(table, "FEW", 0)
    t = client.create_table("test", "shared_ids", StructType([StructField("id", LongType(), False)]))
    rows = [(i, bytearray([0] * 14 + [i // 3, 0])) for i in range(12)] + [(12, bytearray(b"\x01")), (13, bytearray(b""))]
    t.insert(spark.createDataFrame(rows, f"id long, {ROW_ID} binary"), keep_row_ids=True)
    for offset, limit in ((0, 1), (2, 3), (4, 6), (7, 1), (13, 2)):
        want = sorted(bytes(r[1]) for r in rows)[offset:][:limit]
        assert [bytes(r[0]) for r in t.scan([ROW_ID], offset=offset, limit=limit, row_id=True).collect()] == want


@pytest.mark.parametrize("name", ["scan_pages", "scan_parts", "scan_balanced_parts", "scan_some_files", "count_each_part"])
def test_parts_of_several_files(spark, sf, monkeypatch, name):
    for rows in (200, 130):
        monkeypatch.setattr(scans, "ROWS_A_FILE", rows)
        monkeypatch.setattr(table, "FEW", 10)
        t, names = scans.parted(spark, sf)
        assert max(f["rows"] for f in t.data_file_records()) < 2 * rows and len({len(n) for n in names}) == 1
        same(registry.QUERIES[name](spark, sf), connect(sf), registry.ORACLES[name])
