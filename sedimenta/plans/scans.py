"""Scans, filters, projections, expressions and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import expressions as x
from ..operators.table import Partition
from .loading import client, in_parts, shared_table, source
from .registry import query

ORDER = ["o_orderkey", "o_custkey", "o_totalprice"]


def _scan(name: str, table: str, columns: list[str], condition, sql_condition: str):
    """Register a filtered scan and its SQL."""

    @query(name, f"select {', '.join(columns)} from {table} where {sql_condition}")
    def run(spark, sf_dir):
        return shared_table(spark, sf_dir, table).scan(columns, [condition if isinstance(condition, str) else condition()])

    return run


@query("scan_full", "select * from lineitem")
def scan_full(spark, sf_dir):
    return shared_table(spark, sf_dir, "lineitem").df()


@query("scan_project", "select o_orderkey, o_custkey, o_totalprice from orders")
def scan_project(spark, sf_dir):
    return shared_table(spark, sf_dir, "orders").scan(ORDER)


@query("scan_filter_conj", "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus = 'F'")
def scan_filter_conj(spark, sf_dir):
    return shared_table(spark, sf_dir, "orders").scan(ORDER, ["o_totalprice > 100000", "o_orderstatus = 'F'"])


_scan("scan_filter_or_null", "orders", ORDER, "nullif(o_orderstatus, 'F') = 'O' or o_totalprice > 200000", "nullif(o_orderstatus, 'F') = 'O' or o_totalprice > 200000")
_scan("scan_filter_and_null", "orders", ORDER, "not (nullif(o_orderstatus, 'F') = 'O' and o_totalprice > 200000)", "not (nullif(o_orderstatus, 'F') = 'O' and o_totalprice > 200000)")
_scan("scan_in", "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"], lambda: x.in_list(F.col("l_returnflag"), ["A", "R"]), "l_returnflag in ('A', 'R')")
_scan("scan_not_in", "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"], lambda: x.in_list(F.expr("nullif(l_returnflag, 'N')"), ["A"], negated=True), "nullif(l_returnflag, 'N') not in ('A')")
_scan("scan_like", "part", ["p_partkey", "p_name"], lambda: F.col("p_name").like("%a%e%"), "p_name like '%a%e%'")
_scan("scan_not_like", "part", ["p_partkey", "p_name"], lambda: ~F.col("p_name").like("_a%"), "p_name not like '_a%'")
_scan("scan_ilike", "customer", ["c_custkey", "c_name"], lambda: F.col("c_name").ilike("CUST%1"), "c_name ilike 'CUST%1'")
_scan("scan_not_ilike", "customer", ["c_custkey", "c_name"], lambda: ~F.col("c_name").ilike("cust%1"), "c_name not ilike 'cust%1'")
_scan("scan_between", "orders", ORDER, lambda: F.col("o_totalprice").between(50000, 150000), "o_totalprice between 50000 and 150000")
_scan("scan_not_between", "orders", ORDER, lambda: ~F.col("o_totalprice").between(50000, 150000), "o_totalprice not between 50000 and 150000")
_scan("scan_distinct_from", "orders", ORDER, lambda: x.is_distinct_from(F.expr("nullif(o_orderstatus, 'F')"), F.lit("O")), "nullif(o_orderstatus, 'F') is distinct from 'O'")
_scan("scan_not_distinct_from", "orders", ORDER, lambda: F.expr("nullif(o_orderstatus, 'F')").eqNullSafe(F.lit(None).cast("string")), "nullif(o_orderstatus, 'F') is not distinct from null")
_scan("scan_is_null", "orders", ORDER, lambda: F.expr("nullif(o_orderstatus, 'F')").isNull(), "nullif(o_orderstatus, 'F') is null")
_scan("scan_is_not_null", "orders", ORDER, lambda: F.expr("nullif(o_orderstatus, 'F')").isNotNull(), "nullif(o_orderstatus, 'F') is not null")
_scan("scan_is_true", "orders", ORDER, lambda: x.is_true(F.expr("nullif(o_orderstatus, 'F') = 'O'")), "(nullif(o_orderstatus, 'F') = 'O') is true")
_scan("scan_is_not_false", "orders", ORDER, lambda: ~x.is_false(F.expr("nullif(o_orderstatus, 'F') = 'O'")), "(nullif(o_orderstatus, 'F') = 'O') is not false")
_scan("scan_is_unknown", "orders", ORDER, lambda: x.is_unknown(F.expr("nullif(o_orderstatus, 'F') = 'O'")), "(nullif(o_orderstatus, 'F') = 'O') is null")
_scan("scan_not", "orders", ORDER, lambda: ~(F.col("o_orderstatus") == "F"), "not (o_orderstatus = 'F')")
_scan("list_compare", "embeddings", ["vec_id", "label"], "embedding > array(cast(0.05 as float))", "embedding > [0.05]::float[]")
_scan("scan_comparisons", "lineitem", ["l_orderkey", "l_linenumber"], "l_quantity <= 10 and l_quantity >= 2 and l_discount < 0.05 and l_tax > 0.01 and l_linestatus != 'F'", "l_quantity <= 10 and l_quantity >= 2 and l_discount < 0.05 and l_tax > 0.01 and l_linestatus != 'F'")


@query("expr_arith", "select l_orderkey, l_linenumber, l_orderkey + l_partkey as s, l_orderkey - l_partkey as d, l_orderkey * l_suppkey as m, (l_orderkey - l_partkey) // 7 as q, (l_orderkey - l_partkey) % 7 as r, -l_orderkey as n from lineitem")
def expr_arith(spark, sf_dir):
    t = shared_table(spark, sf_dir, "lineitem").df()
    diff = F.col("l_orderkey") - F.col("l_partkey")
    return t.select("l_orderkey", "l_linenumber", F.expr("l_orderkey + l_partkey").alias("s"), diff.alias("d"), F.expr("l_orderkey * l_suppkey").alias("m"), x.int_div(diff, F.lit(7)).alias("q"), (diff % 7).alias("r"), (-F.col("l_orderkey")).alias("n"))


@query("expr_wrapping", "select o_orderkey, cast((((o_custkey % 2 * 2147483647 + o_orderkey % 1000 + 2147483648) % 4294967296) - 2147483648) as int) as w from orders")
def expr_wrapping(spark, sf_dir):
    t = shared_table(spark, sf_dir, "orders").df()
    return t.select("o_orderkey", x.wrapping("+", F.expr("o_custkey % 2 * 2147483647").cast("int"), F.expr("o_orderkey % 1000").cast("int"), IntegerType()).alias("w"))


@query("expr_float_div", "select o_orderkey, o_totalprice / nullif(o_custkey % 3, 0) as q from orders")
def expr_float_div(spark, sf_dir):
    t = shared_table(spark, sf_dir, "orders").df()
    return t.select("o_orderkey", x.safe_div(F.col("o_totalprice"), F.expr("nullif(o_custkey % 3, 0)")).alias("q"))


@query("expr_case", "select o_orderkey, case when o_orderstatus = 'F' then 1 when nullif(o_orderstatus, 'O') = 'P' then 2 else 9 end as c from orders")
def expr_case(spark, sf_dir):
    t = shared_table(spark, sf_dir, "orders").df()
    return t.select("o_orderkey", x.case([(F.col("o_orderstatus") == "F", F.lit(1)), (F.expr("nullif(o_orderstatus, 'O') = 'P'"), F.lit(2))], F.lit("9"), "int").alias("c"))


@query("expr_simple_case", "select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'part' end as c from orders")
def expr_simple_case(spark, sf_dir):
    t = shared_table(spark, sf_dir, "orders").df()
    return t.select("o_orderkey", x.simple_case(F.col("o_orderstatus"), [(F.lit("F"), F.lit("done")), (F.lit("O"), F.lit("open"))], F.lit("part")).alias("c"))


@query("expr_case_no_else", "select o_orderkey, case when o_orderstatus = 'F' then 1 end as c from orders")
def expr_case_no_else(spark, sf_dir):
    return shared_table(spark, sf_dir, "orders").df().select("o_orderkey", x.case([(F.col("o_orderstatus") == "F", F.lit(1))]).alias("c"))


@query("expr_cast", "select o_orderkey, cast(o_orderkey as varchar) as s, cast(o_orderdate as date) as d, cast(o_custkey as int) as i from orders")
def expr_cast(spark, sf_dir):
    return shared_table(spark, sf_dir, "orders").df().selectExpr("o_orderkey", "cast(o_orderkey as string) as s", "cast(o_orderdate as date) as d", "cast(o_custkey as int) as i")


@query("expr_try_cast", "select p_partkey, try_cast(p_name as int) as i, try_cast(cast(p_size as varchar) as int) as n from part")
def expr_try_cast(spark, sf_dir):
    return shared_table(spark, sf_dir, "part").df().selectExpr("p_partkey", "try_cast(p_name as int) as i", "try_cast(cast(p_size as string) as int) as n")


@query("expr_parsed", "select o_orderkey, o_orderkey + 1 as n from orders where o_custkey % 2 = 0")
def expr_parsed(spark, sf_dir):
    t = shared_table(spark, sf_dir, "orders").df()
    return t.where(x.parse("o_custkey % 2 = 0")).select("o_orderkey", x.parse("o_orderkey + 1").alias("n"))


@query("scan_limit_offset", "select o_orderkey, o_custkey from orders order by o_orderkey limit 25 offset 10")
def scan_limit_offset(spark, sf_dir):
    return shared_table(spark, sf_dir, "orders").scan(["o_orderkey", "o_custkey"]).orderBy("o_orderkey").offset(10).limit(25)


@query("scan_partitions_union", "select o_orderkey, o_custkey, o_totalprice from orders")
def scan_partitions_union(spark, sf_dir):
    t = shared_table(spark, sf_dir, "orders")
    out = t.scan(ORDER, partition=Partition(0, 4))
    for i in range(1, 4):
        out = out.unionByName(t.scan(ORDER, partition=Partition(i, 4)))
    return out


@query("scan_provided_files", "select l_orderkey, l_linenumber from lineitem")
def scan_provided_files(spark, sf_dir):
    t = shared_table(spark, sf_dir, "lineitem")
    names = tuple(f["name"] for f in t.data_file_records())
    return t.scan(["l_orderkey", "l_linenumber"], partition=Partition(files=names, inline=True))


@query("fetch_by_row_id", "select o_orderkey, o_custkey from orders where o_orderkey % 10 = 3")
def fetch_by_row_id(spark, sf_dir):
    t = shared_table(spark, sf_dir, "orders")
    return t.fetch(t.scan(filters=["o_orderkey % 10 = 3"], row_id=True), ["o_orderkey", "o_custkey"])


@query("count_all", "select count(*) as n from lineitem")
def count_all(spark, sf_dir):
    return spark.createDataFrame([(shared_table(spark, sf_dir, "lineitem").count(),)], "n bigint")


@query("count_filter", "select count(*) as n from orders where o_totalprice > 100000")
def count_filter(spark, sf_dir):
    return shared_table(spark, sf_dir, "orders").scan(["o_orderkey"], ["o_totalprice > 100000"]).agg(F.count(F.lit(1)).alias("n"))


@query("count_partitions", "select count(*) as n from orders")
def count_partitions(spark, sf_dir):
    parts = shared_table(spark, sf_dir, "orders").count([Partition(i, 3) for i in range(3)])
    return spark.createDataFrame([(sum(parts),)], "n bigint")


@query("table_metadata", "select count(*) as live, 0 as inline_rows from orders")
def table_metadata(spark, sf_dir):
    t = shared_table(spark, sf_dir, "orders")
    assert t.size() > 0 and t.data_file_count() == len(t.data_file_records())
    return spark.createDataFrame([(sum(f["live"] for f in t.data_file_records()), t.inline_row_count())], "live bigint, inline_rows int")


#: Rows of a file of ``parted``, about; no task writes or reads much more.
ROWS_A_FILE = 500_000


def parted(spark, sf_dir, balanced: bool = False):
    """Orders in files by the key's remainder by 4, and the names of each remainder's files: as many of each, one up to ``ROWS_A_FILE``
    rows. ``balanced``: as many files of remainders 0 and 1 together as of 2 and of 3, and one more."""
    rows, c = source(spark, sf_dir, "orders"), client(spark)
    t = c.create_table("main", f"parted_{len(c.tables('main'))}", rows.schema, config={"inline_row_count_limit": 1 << 40})
    many = max(-(-rows.count() // (4 * ROWS_A_FILE)), 1)
    return t, in_parts(t, rows, "o_orderkey", [many // 2 + 1, (many + 1) // 2, many, many] if balanced else [many] * 4)


@query("scan_pages", "select o_orderkey, o_custkey, o_totalprice from orders")
def scan_pages(spark, sf_dir):
    t, _ = parted(spark, sf_dir)
    size = t.count() // 3 + 1
    out = t.scan(ORDER, offset=0, limit=size)
    for i in (1, 2):
        out = out.unionByName(t.scan(ORDER, offset=i * size, limit=size))
    return out


@query("scan_parts", "select o_orderkey % 4 as part, o_orderkey, o_custkey from orders")
def scan_parts(spark, sf_dir):
    t, _ = parted(spark, sf_dir)
    parts = [t.scan(["o_orderkey", "o_custkey"], partition=Partition(i, 4)).withColumn("part", F.lit(i).cast("bigint")) for i in range(4)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("scan_balanced_parts", "select greatest(o_orderkey % 4 - 1, 0) as part, o_orderkey, o_custkey from orders")
def scan_balanced_parts(spark, sf_dir):
    t, _ = parted(spark, sf_dir, balanced=True)
    parts = [t.scan(["o_orderkey", "o_custkey"], partition=p).withColumn("part", F.lit(i).cast("bigint")) for i, p in enumerate(t.partitions(3))]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("scan_some_files", "select o_orderkey, o_custkey from orders where o_orderkey % 4 in (1, 3)")
def scan_some_files(spark, sf_dir):
    t, names = parted(spark, sf_dir)
    return t.scan(["o_orderkey", "o_custkey"], partition=Partition(files=(*names[1], *names[3])))


@query("count_each_part", "select o_orderkey % 4 as part, count(*) as n from orders group by 1")
def count_each_part(spark, sf_dir):
    counts = parted(spark, sf_dir)[0].count([Partition(i, 4) for i in range(4)])
    return spark.createDataFrame(list(enumerate(counts)), "part bigint, n bigint")
