"""Row-level writes, schema changes and maintenance; what the table holds afterwards is the result."""

from __future__ import annotations

import time

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from ..functions.rowid import ROW_ID
from ..operators import maintenance, sql
from .loading import client, fresh_table, shared_table, source
from .registry import query

PLAIN = "select * from orders"


@query("insert_append", "select * from region union all select 100, 'one' union all select 101, 'it''s \"two\"'")
def insert_append(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "region")
    t.insert(spark.createDataFrame([(100, "one"), (101, "it's \"two\"")], t.schema))
    return t.df()


@query("insert_partial_default", "select r_regionkey, r_name from region union all select 100, 'none'")
def insert_partial_default(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "region", defaults={"r_name": "'none'"})
    t.insert(spark.createDataFrame([(100,)], "r_regionkey int"))
    return t.df()


@query("insert_reordered", "select * from region union all select 100, 'x'")
def insert_reordered(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "region")
    sql.insert_into(t, spark.createDataFrame([("x", 100)], "a string, b int"), ["r_name", "r_regionkey"])
    return t.df()


@query("insert_overwrite", "select 7 as r_regionkey, 'only' as r_name")
def insert_overwrite(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "region")
    sql.insert_into(t, spark.createDataFrame([(7, "only")], t.schema), mode="overwrite")
    return t.df()


@query("insert_kept_row_ids", "select * from nation where n_nationkey >= 10 union all select n_nationkey, lower(n_name), n_regionkey from nation where n_nationkey < 10")
def insert_kept_row_ids(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "nation")
    moved = t.rows().where("n_nationkey < 10").withColumn("n_name", F.lower("n_name"))
    t.insert(moved, keep_row_ids=True)
    t.delete("n_nationkey < 10 and n_name <> lower(n_name)")
    return t.df()


@query("bypass_insert_multi_file", "select * from lineitem")
def bypass_insert_multi_file(spark, sf_dir):
    return fresh_table(spark, sf_dir, "lineitem", config={"inline_row_count_limit": 50_000}).df()


@query("update_cond", "select o_orderkey, o_custkey, o_orderstatus, case when o_totalprice > 150000 then 0.0 else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders")
def update_cond(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    t.update({"o_totalprice": F.lit(0.0)}, "o_totalprice > 150000")
    return t.df()


@query("update_one_key", "select o_orderkey, o_custkey, case when o_orderkey = 100 then 'Z' else o_orderstatus end as o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def update_one_key(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    t.update({"o_orderstatus": F.lit("Z")}, "o_orderkey = 100")
    return t.df()


@query("update_multi_set", "select o_orderkey, case when o_orderstatus = 'F' then o_orderkey else o_custkey end as o_custkey, case when o_orderstatus = 'F' then 'X' else o_orderstatus end as o_orderstatus, case when o_orderstatus = 'F' then o_totalprice + o_custkey else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders")
def update_multi_set(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    sql.update_table(t, {"o_custkey": "o_orderkey", "o_orderstatus": "'X'", "o_totalprice": "o_totalprice + o_custkey"}, "o_orderstatus = 'F'")
    return t.df()


@query("update_keeps_row_ids", "select count(*) as n from orders")
def update_keeps_row_ids(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    before = t.rows().select(ROW_ID, "o_orderkey")
    t.update({"o_totalprice": "o_totalprice + 1"}, "o_orderkey % 3 = 0")
    return t.rows().select(ROW_ID, "o_orderkey").join(before, [ROW_ID, "o_orderkey"]).agg(F.count(F.lit(1)).alias("n"))


@query("update_then_dump", "select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 2 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders")
def update_then_dump(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders", config={"inline_row_count_limit": 10_000})
    t.update({"o_totalprice": "o_totalprice + 1"}, "o_orderkey % 2 = 0")
    maintenance.dump(t)
    return t.df()


@query("dump_merge_scan", "select * from orders where o_orderkey % 3 <> 0 or o_orderkey < 50")
def dump_merge_scan(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders", config={"inline_row_count_limit": 5_000})
    t.delete("o_orderkey % 3 = 0 and o_orderkey >= 50")
    maintenance.merge(t, 5_000)
    maintenance.cleanup(t, time.time() + 60)
    return t.df()


@query("delete_cond", "select * from orders where not coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
def delete_cond(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    t.delete("nullif(o_orderstatus, 'P') = 'F'")
    return t.df()


@query("delete_count", "select count(*) as count from orders where o_totalprice < 100000")
def delete_count(spark, sf_dir):
    return sql.delete_from(fresh_table(spark, sf_dir, "orders"), "o_totalprice < 100000")


@query("delete_row_ids", "select * from orders where o_orderkey % 5 <> 0")
def delete_row_ids(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    t.delete_ids(t.rows().where("o_orderkey % 5 = 0").select(ROW_ID))
    return t.df()


@query("delete_one_row_id", "select count(*) - 1 as n from nation")
def delete_one_row_id(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "nation")
    first = t.rows().orderBy(ROW_ID).first()[ROW_ID]
    t.delete(F.col(ROW_ID) == F.lit(bytes(first)))
    return t.df().agg(F.count(F.lit(1)).alias("n"))


@query("delete_true", "select * from orders where false")
def delete_true(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    t.delete("1 = 1")
    return t.df()


@query("delete_false", PLAIN)
def delete_false(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    t.delete("1 = 2")
    return t.df()


@query("truncate_insert", "select * from region")
def truncate_insert(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "region")
    t.truncate()
    t.insert(source(spark, sf_dir, "region"))
    return t.df()


@query("alter_add_column", "select *, 'new' as tag from orders")
def alter_add_column(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    t.add_column(StructField("tag", StringType()), "'new'")
    return t.df()


@query("alter_rename_column", "select o_orderkey as id, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def alter_rename_column(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    t.rename_column("o_orderkey", "id")
    return t.df()


@query("alter_drop_middle_column", "select o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority from orders")
def alter_drop_middle_column(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    t.drop_column("o_orderstatus")
    return t.df()


@query("alter_rename_table", "select * from nation")
def alter_rename_table(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "nation")
    t.rename(f"{t.name}_renamed")
    return client(spark).load_table("main", t.name).df()


@query("sql_dml_view", "select o_orderstatus, count(*) as n, cast(sum(o_custkey) as bigint) as s from (select case when o_orderkey % 4 = 0 then 'N' else o_orderstatus end as o_orderstatus, o_custkey from orders where o_custkey % 7 <> 0) group by o_orderstatus")
def sql_dml_view(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    sql.delete_from(t, "o_custkey % 7 = 0")
    sql.update_table(t, {"o_orderstatus": "'N'"}, "o_orderkey % 4 = 0")
    sql.register(t, "orders_now")
    return spark.sql("select o_orderstatus, count(*) as n, sum(o_custkey) as s from orders_now group by o_orderstatus")


@query("sql_text_dml", "select o_orderstatus, count(*) as n, cast(sum(o_custkey) as bigint) as s from (select case when o_orderkey % 4 = 0 then 'N' else o_orderstatus end as o_orderstatus, o_custkey from orders where o_custkey % 7 <> 0 union all select 'I', o_custkey from orders where o_orderkey % 10 = 1 and o_custkey % 7 <> 0) group by o_orderstatus")
def sql_text_dml(spark, sf_dir):
    t, c = fresh_table(spark, sf_dir, "orders"), client(spark)
    sql.execute(c, f"delete from {t.name} where o_custkey % 7 = 0")
    sql.execute(c, f"update {t.name} set o_orderstatus = 'N' where o_orderkey % 4 = 0")
    sql.execute(c, f"insert into {t.name} (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) select -o_orderkey, o_custkey, 'I', o_totalprice, o_orderdate, o_orderpriority from {t.name} where o_orderkey % 10 = 1")
    return sql.execute(c, f"select o_orderstatus, count(*) as n, sum(o_custkey) as s from {t.name} group by o_orderstatus")


@query("sql_text_overwrite", "select n_nationkey, upper(n_name) as n_name, n_regionkey from nation where n_regionkey = 1")
def sql_text_overwrite(spark, sf_dir):
    t, c = fresh_table(spark, sf_dir, "nation"), client(spark)
    sql.execute(c, f"insert overwrite {t.name} select n_nationkey, upper(n_name), n_regionkey from {t.name} where n_regionkey = 1")
    return sql.execute(c, f"select * from {t.name}")


@query("sql_text_count", "select count(*) as n from lineitem")
def sql_text_count(spark, sf_dir):
    t = shared_table(spark, sf_dir, "lineitem")
    return sql.execute(client(spark), f"select count(*) as n from {t.name}")


@query("sql_text_indexed", "select o_custkey, count(*) as n from orders where o_orderkey between 100 and 900 and o_custkey in (1, 5, 7, 20) group by o_custkey")
def sql_text_indexed(spark, sf_dir):
    t = shared_table(spark, sf_dir, "orders").refresh()
    t.create_index("by_key", "btree", ["o_orderkey"], if_not_exists=True)
    return sql.execute(client(spark), f"select o_custkey, count(*) as n from {t.name} where o_orderkey between 100 and 900 and o_custkey in (1, 5, 7, 20) group by o_custkey")


@query("create_drop_table", "select 'kept' as name, count(*) as rows from region")
def create_drop_table(spark, sf_dir):
    c, rows = client(spark), source(spark, sf_dir, "region")
    space = f"tables_{len(c.namespaces())}"
    c.create_namespace(space)
    for name in ("kept", "gone"):
        c.create_table(space, name, rows.schema).insert(rows)
    c.load_table(space, "gone").drop()
    return spark.createDataFrame([(n, c.load_table(space, n).count()) for n in c.tables(space)], "name string, rows bigint")


@query("drop_index", "select o_orderkey, o_custkey from orders where o_orderkey < 700")
def drop_index(spark, sf_dir):
    t = fresh_table(spark, sf_dir, "orders")
    for name in ("a", "b"):
        t.create_index(name, "btree", ["o_orderkey"])
    t.drop_index("a")
    if [i["name"] for i in t.index_definitions()] != ["b"]:
        raise AssertionError(t.index_definitions())
    t.drop_index("b")
    return t.scan(["o_orderkey", "o_custkey"], ["o_orderkey < 700"])
