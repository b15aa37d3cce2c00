"""Index kinds on small fixtures."""

import struct

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from sedimenta.errors import InvalidInput, NotFound, NotSupported
from sedimenta.functions import geometry, vectors
from sedimenta.functions.rowid import ROW_ID
from sedimenta.operators import maintenance, sql
from sedimenta.operators.indexes import BM25Query, Intersects, RabitqQuery, VectorQuery
from sedimenta.sources.catalog import Client


@pytest.fixture(scope="module")
def make(spark):
    c = Client(spark)
    c.create_namespace("test")

    def run(name, schema, rows, split=3):
        t = c.create_table("test", name, schema)
        t.bypass_insert(spark.createDataFrame(rows[:split], schema).coalesce(1))
        if rows[split:]:
            t.insert(spark.createDataFrame(rows[split:], schema))
        return t

    return run


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_btree(make, spark):
    schema = StructType([StructField("id", IntegerType()), StructField("n", IntegerType()), StructField("s", StringType())])
    t = make("ordered", schema, list(zip(range(1, 7), (100, 50, 75, 25, 90, 75), ("apple", "banana", "cherry", "date", "elderberry", "cherry"))) + [(7, None, None)])
    t.create_index("by_n", "btree", ["n"])
    t.create_index("by_s", "btree", ["s"])
    assert ids(t.scan(["id"], ["n = 75"])) == [3, 6]
    assert ids(t.scan(["id"], ["n >= 50", "n <= 90"])) == [2, 3, 5, 6]
    assert ids(t.scan(["id"], ["s = 'cherry'"])) == [3, 6]
    assert ids(t.scan(["id"], ["s >= 'banana'", "s <= 'date'", "n > 60"])) == [3, 6]
    assert ids(t.scan(["id"], ["n > cast(null as int)"])) == []
    assert {f["tier"] for f in t.pruned(t.doc["files"], ["n = 1"])} == {"inline"}  # the file is ruled out
    t.update({"n": "n + 1"}, "n = 75")
    t.delete("id = 6")
    assert ids(t.scan(["id"], ["n = 76"])) == [3]
    with pytest.raises(InvalidInput):
        t.drop_column("n")
    t.drop_index("by_n")
    t.drop_index("by_n", if_exists=True)
    with pytest.raises(NotFound):
        t.drop_index("by_n")
    assert ids(t.scan(["id"], ["n = 76"])) == [3]


def test_definitions(make):
    t = make("defined", StructType([StructField("d", DoubleType()), StructField("s", StringType())]), [(1.0, "x")])
    t.create_index("i", "bm25", ["s"])
    t.create_index("i", "bm25", ["s"], if_not_exists=True)
    assert t.index_definitions() == [{"name": "i", "kind": "bm25", "columns": ["s"], "params": {"avgdl": 256.0}}]
    with pytest.raises(InvalidInput):
        t.create_index("i", "bm25", ["s"])
    with pytest.raises(NotFound):
        t.create_index("j", "nothing", ["s"])
    with pytest.raises(NotSupported):
        t.create_index("j", "btree", ["d"])
    with pytest.raises(InvalidInput):
        t.create_index("j", "bm25", ["s"], {"nothing": 1})
    with pytest.raises(NotFound):
        t.search(VectorQuery([1.0]))
    with pytest.raises(NotFound):
        t.search(BM25Query("x"), dynamic_fields=["distance"])


VECTORS = StructType([StructField("id", IntegerType(), False), StructField("vector", ArrayType(FloatType()))])


def test_vectors(make):
    t = make("vectors", VECTORS, [(i, [10.0 * i] * 3) for i in range(1, 5)] + [(5, None)])
    t.create_index("v", "hnsw", ["vector"])
    found = t.search(VectorQuery([26.0, 26.0, 26.0]), ["id"], ["distance"], 2).collect()
    assert [r["id"] for r in found] == [3, 2]
    assert np.allclose([r["distance"] for r in found], [6.928203105926514, 10.392304420471191], atol=1e-6)
    t.create_index("q", "rabitq", ["vector"])
    assert [r[0] for r in t.search(RabitqQuery([26.0, 26.0, 26.0]), ["id"], limit=2).collect()] == [3, 2]
    assert {r[0] for r in t.search(RabitqQuery([26.0, 26.0, 26.0], rerank=0), ["id"], limit=2).collect()} & {2, 3}
    t.delete("id = 3")
    assert [r[0] for r in t.search(RabitqQuery([26.0, 26.0, 26.0]), ["id"], limit=2).collect()] == [2, 4]


def test_vector_ties_and_odd_rows(make):
    rows = [(i, [1.0, 1.0, 1.0]) for i in range(30)] + [(30, [0.0]), (31, []), (32, None), (33, [float("nan")] * 3), (34, [None, 1.0, 1.0])]
    t = make("tied", VECTORS, rows, 20)
    t.create_index("v", "hnsw", ["vector"])
    first = [r["id"] for r in t.rows().orderBy(ROW_ID).where("id < 30").limit(4).collect()]
    assert [r["id"] for r in t.search(VectorQuery([0.0, 0.0, 0.0]), ["id"], limit=4).collect()] == first
    assert t.search(VectorQuery([0.0, 0.0, 0.0]), ["id"], limit=0).count() == 0


def test_rabitq_recall(make):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(400, 24)).astype(np.float32)
    t = make("recall", VECTORS, [(i, v.tolist()) for i, v in enumerate(data)], 300)
    for metric in ("l2", "ip"):
        t.create_index(metric, "rabitq", ["vector"], {"metric": metric})
        hits = 0
        for q in rng.normal(size=(5, 24)):
            score = -(data @ q) if metric == "ip" else ((data - q) ** 2).sum(axis=1)
            want = set(np.argsort(score, kind="stable")[:10].tolist())
            hits += len(want & {r[0] for r in t.search(RabitqQuery(q.tolist()), ["id"], limit=10).collect()})
        assert hits >= 45
        t.drop_index(metric)


def test_quantiser_estimates():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(200, 50)), rng.normal(size=50)
    codes, factor, norm2 = vectors.quantise(x, 7)
    estimate = (codes + 0.5 - 64) @ vectors.rotate(q[None])[0] * factor
    assert np.abs(estimate - x @ q).max() < 0.5 and np.allclose(norm2, (x**2).sum(axis=1))


def test_full_text(make):
    schema = StructType([StructField("title", StringType()), StructField("content", StringType())])
    docs = [("a", "pink roses and pink wine"), ("b", "blue sky"), ("c", "the pink panther"), ("d", None), ("e", "Pink")]
    t = make("texts", schema, docs)
    t.create_index("t", "bm25", ["content"])
    found = t.search(BM25Query("pink"), ["title"], ["score"], 5).collect()
    assert [r["title"] for r in found] == ["a", "c"]

    def score(tf, length, n=5, df=2):
        return np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 256))

    assert np.allclose([r["score"] for r in found], [score(2, 9), score(1, 5)])
    sql.register_search(t, "pink", BM25Query("pink"), ["title"], ("score",), 1)
    assert [r["title"] for r in t.spark.sql("select title from pink where score > 0.5").collect()] == ["a"]
    t.insert(t.df().where("title = 'a'"), try_dump=False)
    t.delete("title = 'c'")
    assert [r["title"] for r in t.search(BM25Query("pink"), ["title"], limit=5).collect()] == ["a", "a"]
    maintenance.merge(t)
    assert t.search(BM25Query("nothing"), ["title"]).count() == 0


def point(x, y):
    return struct.pack("<BIdd", 1, 1, x, y)


def test_boxes(make):
    schema = StructType([StructField("id", IntegerType()), StructField("geom", BinaryType())])
    empty = struct.pack("<BII", 1, 4, 0)
    t = make("shapes", schema, [(i, bytearray(point(9.0 + i, 9.0 + i))) for i in range(1, 5)] + [(5, bytearray(empty)), (6, None)])
    want = bytes.fromhex("010100000000000000000026400000000000002640")
    assert ids(t.scan(["id"], [Intersects("geom", want)])) == [2]
    t.create_index("g", "rstar", ["geom"])
    assert ids(t.scan(["id"], [Intersects("geom", want)])) == [2]
    area = struct.pack("<BIII10d", 1, 3, 1, 5, 10, 10, 12, 10, 12, 12, 10, 12, 10, 10)
    assert ids(t.scan(["id"], [Intersects("geom", area), "id > 1"])) == [2, 3]
    assert ids(t.scan(["id"], [Intersects("geom", empty)])) == []


def test_dialects():
    flat = point(1.0, 2.0)
    assert geometry.bounding_box(flat) == (1, 2, 1, 2)
    assert geometry.bounding_box(struct.pack("<BIIdd", 1, 0x20000001, 4326, 1, 2), "ewkb") == (1, 2, 1, 2)
    assert geometry.bounding_box(struct.pack(">BIddd", 0, 1001, 1, 2, 3)) == (1, 2, 1, 2)
    assert geometry.bounding_box(b"GP\0\x01" + b"\0" * 4 + flat, "geopackage") == (1, 2, 1, 2)
    assert geometry.bounding_box(b"\0\0\0\0" + flat, "mysql") == (1, 2, 1, 2)
    assert geometry.bounding_box(b"\0\x01" + b"\0" * 36 + b"\x7c" + flat[1:] + b"\xfe", "spatialite") == (1, 2, 1, 2)
    multi = struct.pack("<BII", 1, 4, 2) + point(0, 5) + point(3, -1)
    assert geometry.bounding_box(struct.pack("<BII", 1, 7, 1) + multi) == (0, -1, 3, 5)
    assert geometry.bounding_box(None) is None and geometry.bounding_box(point(float("nan"), float("nan"))) is None
