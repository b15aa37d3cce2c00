"""Index look-ups and top-k searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..functions import geometry, vectors
from ..operators.indexes import BM25Query, Compare, Intersects, RabitqQuery, VectorQuery
from .loading import client, fresh_table, in_parts, shared_table, source
from .registry import query

ORDER = ["o_orderkey", "o_custkey", "o_totalprice"]


def indexed(spark, sf_dir, name: str, indexes: dict[str, tuple[str, str, dict]]):
    """The shared table with indexes (name -> kind, column, parameters)."""
    t = shared_table(spark, sf_dir, name).refresh()
    for index, (kind, column, params) in indexes.items():
        t.create_index(index, kind, [column], params, if_not_exists=True)
    return t


@query("btree_point", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 100")
def btree_point(spark, sf_dir):
    return indexed(spark, sf_dir, "orders", {"by_key": ("btree", "o_orderkey", {})}).scan(ORDER, ["o_orderkey = 100"])


@query("btree_range", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey >= 100 and o_orderkey <= 200")
def btree_range(spark, sf_dir):
    return indexed(spark, sf_dir, "orders", {"by_key": ("btree", "o_orderkey", {})}).scan(ORDER, ["o_orderkey >= 100", "o_orderkey <= 200"])


@query("btree_string", "select p_partkey, p_name from part where p_name >= 'b' and p_name < 'd'")
def btree_string(spark, sf_dir):
    return indexed(spark, sf_dir, "part", {"by_name": ("btree", "p_name", {})}).scan(["p_partkey", "p_name"], [Compare("p_name", ">=", "b"), Compare("p_name", "<", "d")])


@query("btree_date", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderdate < timestamp '1996-01-01'")
def btree_date(spark, sf_dir):
    return indexed(spark, sf_dir, "orders", {"by_date": ("btree", "o_orderdate", {})}).scan(ORDER, ["o_orderdate < timestamp_ntz'1996-01-01'"])


@query("btree_text", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey in (7, 100, 5000) or o_orderkey between 200 and 230 and o_custkey > 3")
def btree_text(spark, sf_dir):
    t = indexed(spark, sf_dir, "orders", {"by_key": ("btree", "o_orderkey", {})})
    low = t.scan(ORDER, ["230 >= o_orderkey and o_orderkey between 200 and 4000 and o_custkey > 3"])
    return low.unionByName(t.scan(ORDER, [F.col("o_orderkey").isin(7, 100, 5000)]))


@query("two_indexes_intersect", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey < 5000 and o_custkey > 50")
def two_indexes_intersect(spark, sf_dir):
    t = indexed(spark, sf_dir, "orders", {"by_key": ("btree", "o_orderkey", {}), "by_customer": ("btree", "o_custkey", {})})
    return t.scan(ORDER, ["o_orderkey < 5000", "o_custkey > 50"])


@query("btree_after_update", "select o_orderkey, -1 - o_custkey as o_custkey from orders where o_orderkey between 100 and 300")
def btree_after_update(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    t.create_index("by_customer", "btree", ["o_custkey"])
    t.update({"o_custkey": "-1 - o_custkey"}, "o_orderkey between 100 and 300")
    return t.scan(["o_orderkey", "o_custkey"], ["o_custkey < 0"])


QUERY = "(select cast(embedding as double[]) from embeddings where vec_id = 7)"


def _vector(spark, sf_dir, vec_id: int = 7) -> list[float]:
    return list(source(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


@query("knn_l2_top10", f"select vec_id, round(list_distance(cast(embedding as double[]), {QUERY}), 9) as distance from embeddings order by list_distance(cast(embedding as double[]), {QUERY}), vec_id limit 10")
def knn_l2_top10(spark, sf_dir):
    t = indexed(spark, sf_dir, "embeddings", {"near": ("hnsw", "embedding", {})})
    found = t.search(VectorQuery(_vector(spark, sf_dir)), ["vec_id"], ["distance"], 10)
    return found.select("vec_id", F.round("distance", 9).alias("distance"))


@query("knn_ip_top10", f"select vec_id, round(list_inner_product(cast(embedding as double[]), {QUERY}), 9) as score from embeddings order by list_inner_product(cast(embedding as double[]), {QUERY}) desc, vec_id limit 10")
def knn_ip_top10(spark, sf_dir):
    q = _vector(spark, sf_dir)
    best = vectors.candidates(shared_table(spark, sf_dir, "embeddings").df(), ["vec_id"], "embedding", q, "ip", 10)
    scored = best.select("vec_id", vectors.inner_product(F.col("embedding"), q).alias("s"))
    return scored.orderBy(F.col("s").desc(), "vec_id").limit(10).select("vec_id", F.round("s", 9).alias("score"))


@query("knn_after_delete", f"select vec_id from embeddings where vec_id % 2 = 0 order by list_distance(cast(embedding as double[]), {QUERY}), vec_id limit 10")
def knn_after_delete(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "embeddings")
    t.create_index("near", "hnsw", ["embedding"])
    t.delete("vec_id % 2 <> 0")
    return t.search(VectorQuery(_vector(spark, sf_dir)), ["vec_id"], limit=10)


@query("knn_per_label", f"select label, vec_id, n from (select label, vec_id, row_number() over (partition by label order by list_distance(cast(embedding as double[]), {QUERY}), vec_id) as n from embeddings) where n <= 3")
def knn_per_label(spark, sf_dir):
    t = shared_table(spark, sf_dir, "embeddings").df().withColumn("d", vectors.l2_distance(F.col("embedding"), _vector(spark, sf_dir)))
    return t.select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("d", "vec_id")).cast("bigint").alias("n")).where("n <= 3")


@query("rabitq_top10", f"select vec_id from embeddings order by list_distance(cast(embedding as double[]), {QUERY}), vec_id limit 10")
def rabitq_top10(spark, sf_dir):
    t = indexed(spark, sf_dir, "embeddings", {"codes": ("rabitq", "embedding", {})})
    return t.search(RabitqQuery(_vector(spark, sf_dir)), ["vec_id"], limit=10)


@query("rabitq_ip_top10", f"select vec_id from embeddings order by list_inner_product(cast(embedding as double[]), {QUERY}) desc, vec_id limit 10")
def rabitq_ip_top10(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "embeddings")
    t.create_index("codes", "rabitq", ["embedding"], {"metric": "ip"})
    return t.search(RabitqQuery(_vector(spark, sf_dir)), ["vec_id"], limit=10)


BM25 = """
with t as (select doc_id, {part} as part, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|.')) as term from documents),
l as (select doc_id, count(*) as len from t group by 1),
tf as (select doc_id, part, term, count(*) as tf from t where term in ('the', ' ', 'and') group by 1, 2, 3),
df as (select part, term, count(*) as df from tf group by 1, 2),
n as (select {part} as part, count(*) as n from documents group by 1)
select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / 256.0))), 6) as score
from tf join df using (part, term) join l using (doc_id) join n using (part) group by 1 order by score desc, doc_id limit 10
"""


@query("bm25_search", BM25.format(part="0"))
def bm25_search(spark, sf_dir):
    t = indexed(spark, sf_dir, "documents", {"words": ("bm25", "text", {"avgdl": 256.0})})
    found = t.search(BM25Query("the and"), ["doc_id"], ["score"], t.count())
    return found.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(10)


@query("bm25_top10_rows", f"select doc_id, source, n_chars from documents where doc_id in (select doc_id from ({BM25.format(part='0')}))")
def bm25_top10_rows(spark, sf_dir):
    t = indexed(spark, sf_dir, "documents", {"words": ("bm25", "text", {"avgdl": 256.0})})
    # the last places go by rounded scores, then by key, so all that score are asked for
    found = t.search(BM25Query("the and"), ["doc_id", "source", "n_chars"], ["score"], t.count())
    return found.orderBy(F.round("score", 6).desc(), "doc_id").limit(10).select("doc_id", "source", "n_chars")


@query("bm25_per_segment_idf", BM25.format(part="doc_id % 4"))
def bm25_per_segment_idf(spark, sf_dir):
    c = client(spark)
    docs = source(spark, sf_dir, "documents")
    t = c.create_table("main", f"segments_{len(c.tables('main'))}", docs.schema)
    parts = in_parts(t, docs, "doc_id")
    t.create_index("words", "bm25", ["text"])
    found = t.search(BM25Query("the and", per_segment=True, segments=[p for p in parts if p]), ["doc_id"], ["score"], t.count())
    return found.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(10)


@query("bbox_intersects", "select l_orderkey * 10 + l_linenumber as id from lineitem where l_quantity between 10 and 20 and l_discount between 0.02 and 0.05")
def bbox_intersects(spark, sf_dir):
    c = client(spark)
    points = source(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), geometry.point_wkb(F.col("l_quantity"), F.col("l_discount")).alias("geom"))
    t = c.create_table("main", f"points_{len(c.tables('main'))}", StructType([StructField("id", LongType()), StructField("geom", BinaryType())]))
    t.bypass_insert(points)
    t.create_index("boxes", "rstar", ["geom"])
    area = spark.range(1).select(geometry.box_wkb(F.lit(10), F.lit(0.02), F.lit(20), F.lit(0.05)).alias("g")).first()["g"]
    return t.scan(["id"], [Intersects("geom", bytes(area))])
