"""SQL over registered tables: joins, aggregates, windows, set operations. Each statement is its own
oracle in another engine, so both texts are written in their common dialect."""

from __future__ import annotations

from ..operators.sql import register
from .loading import shared_table
from .registry import query

STATEMENTS = {
    "sql_join": "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 50000",
    "sql_left_join": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F'",
    "sql_right_join": "select c_custkey, o_orderkey from orders right join customer on c_custkey = o_custkey and o_totalprice > 200000",
    "sql_full_join": "select s_suppkey, n_nationkey from supplier full join nation on s_nationkey = n_nationkey",
    "sql_semi": "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)",
    "sql_anti": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "sql_theta": "select r_regionkey, n_nationkey from region join nation on n_regionkey < r_regionkey",
    "sql_cross": "select r_name, n_name from region cross join nation",
    "sql_group_by": "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(avg(l_discount), 6) as disc, min(l_tax) as lo, max(l_tax) as hi from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus",
    "sql_having": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 10",
    "sql_distinct": "select distinct o_orderstatus, o_orderpriority from orders",
    "sql_count_distinct": "select l_returnflag, count(distinct l_suppkey) as n from lineitem group by l_returnflag",
    "sql_grouping_sets": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())",
    "sql_cube": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)",
    "sql_rollup": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)",
    "sql_window_rank": "select o_orderkey, rank() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r from orders",
    "sql_window_frame": "select o_orderkey, cast(sum(o_custkey) over (partition by o_orderstatus order by o_orderkey rows between 2 preceding and current row) as bigint) as s, lag(o_custkey) over (partition by o_orderstatus order by o_orderkey) as p from orders",
    "sql_union": "select n_name as name from nation union select r_name as name from region",
    "sql_union_all": "select c_nationkey as k from customer union all select s_nationkey as k from supplier",
    "sql_intersect": "select c_nationkey as k from customer intersect select s_nationkey as k from supplier",
    "sql_except": "select n_nationkey as k from nation except select s_nationkey as k from supplier",
    "sql_order_by_topk": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
    "sql_scalar_subquery": "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)",
    "sql_with": "with big as (select l_orderkey, sum(l_quantity) as q from lineitem group by l_orderkey) select o_orderkey, q from orders join big on o_orderkey = l_orderkey where q > 150",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _add(name: str, text: str) -> None:
    @query(name, text)
    def run(spark, sf_dir):
        for t in TABLES:
            if t in text:
                register(shared_table(spark, sf_dir, t), t)
        return spark.sql(text)


for _name, _text in STATEMENTS.items():
    _add(_name, _text)
