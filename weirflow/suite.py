"""The queries that the engine is checked by, and the same in SQL.

Three kinds: batch queries run as they are written; maintained queries are
compiled to plans, get their inputs as two insert batches and a retraction, and
must equal the query over the rows that survive; the rest exercise an API.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow import suite_features as more
from weirflow.functions import text
from weirflow.functions.udf import UdfRegistry, macro
from weirflow.operators import batch
from weirflow.operators import zset as z
from weirflow.plans import nodes as p
from weirflow.plans.frontend import compile_sql
from weirflow.plans.graph import StreamGraph
from weirflow.sources import changelog
from weirflow.sources.connectors import UpsertSink, pair_id
from weirflow.streaming.runner import MaterializedView

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: The key of each table, by which rows are dealt to batches.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}
FIRST, SECOND, GONE, LEFT = "{} % 3 <> 0", "{} % 3 = 0", "{} % 7 = 0", "{} % 7 <> 0"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(sql: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in sql:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    return run


def in_batches(graph: StreamGraph, tables: dict[str, DataFrame]) -> StreamGraph:
    """Push two thirds of each table's rows, then the rest, then take back every seventh."""
    for cut in (FIRST, SECOND, GONE):
        deltas = {}
        for name, df in tables.items():
            df = df.where(cut.format(KEYS[name]))
            deltas[name] = z.weighted(df, -1 if cut is GONE else 1)
        graph.push(deltas)
    return graph


def maintain(sql: str, **options: object) -> Query:
    """A query with tables in braces, kept up to date over the batches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [t for t in TABLES if f"{{{t}}}" in sql]
        tables = {t: table(spark, sf_dir, t) for t in names}
        plan = compile_sql(spark, sql.format(**{t: t for t in names}), tables, **options)
        return in_batches(StreamGraph(plan, spark), tables).result()

    return run


def survivors(sql: str) -> str:
    """The same query over the rows that are not taken back."""
    names = [t for t in TABLES if f"{{{t}}}" in sql]
    named = ", ".join(f"s_{t} AS (SELECT * FROM {t} WHERE {LEFT.format(KEYS[t])})" for t in names)
    body = sql.format(**{t: f"s_{t}" for t in names}).strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {named}, {body[15:]}"
    return f"WITH {named}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {named} {body}"


def maintained_plan(nodes: tuple[p.Node, ...], tables: tuple[str, ...], prepare: dict[str, str] | None = None) -> Query:
    """A plan of nodes over whole tables, or over `prepare`d selections of them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = p.Plan(nodes, nodes[-1].id)
        held = {t: table(spark, sf_dir, t) for t in tables}
        graph = StreamGraph(plan, spark)
        for cut in (FIRST, SECOND, GONE):
            deltas = {}
            for t, df in held.items():
                df = df.where(cut.format(KEYS[t]))
                df = df.selectExpr(*(prepare or {}).get(t, "*").split(" ; "))
                deltas[t] = z.weighted(df, -1 if cut is GONE else 1)
            graph.push(deltas)
        return graph.result()

    return run


MONEY = "CAST({} AS DECIMAL(14,2))"
PRICE = "CAST(l_extendedprice AS DECIMAL(14,2))"
REVENUE = "CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT) * (100 - CAST(ROUND(l_discount * 100) AS BIGINT))) AS BIGINT)"

FLAGSHIP = f"""
SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, CAST(SUM({PRICE}) AS DOUBLE) AS sum_price,
  {REVENUE} AS revenue, ROUND(AVG(l_quantity), 6) AS avg_qty, COUNT(*) AS n
FROM {{lineitem}} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""

#: Text that both engines read alike.
BATCH: dict[str, str] = {
    "filter_project": f"SELECT l_orderkey, l_linenumber, CAST({PRICE} * 2 AS DOUBLE) AS twice FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
    "filter_or": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' OR o_custkey % 10 = 3",
    "filter_predicates": "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_name LIKE '%a%' AND p_type IS NOT NULL",
    "agg_count_sum_avg": f"SELECT l_returnflag, COUNT(*) AS n, CAST(SUM({PRICE}) AS DOUBLE) AS total, ROUND(AVG(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag",
    "agg_global": f"SELECT COUNT(*) AS n, CAST(SUM({MONEY.format('o_totalprice')}) AS DOUBLE) AS total, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high FROM orders",
    "agg_global_empty": "SELECT COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS total FROM orders WHERE o_orderkey < 0",
    "agg_min_max_distinct": "SELECT o_orderpriority, MIN(o_custkey) AS low, MAX(o_custkey) AS high, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
    "agg_stddev": "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "agg_expression_key": "SELECT o_custkey % 7 AS bucket, COUNT(*) + 1 AS n1, CAST(SUM(o_custkey * 2) AS BIGINT) AS s FROM orders GROUP BY o_custkey % 7",
    "agg_filter_clause": "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_custkey % 2 = 0) AS even FROM orders GROUP BY o_orderstatus",
    "agg_case_sum": "SELECT o_orderstatus, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent FROM orders GROUP BY o_orderstatus",
    "rollup": "SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderpriority) AS INT) AS g, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "group_no_agg": "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_full": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey",
    "join_theta_left": "SELECT r_regionkey, n_nationkey FROM region LEFT JOIN nation ON n_nationkey > r_regionkey * 6",
    "join_multi": "SELECT r_name, COUNT(*) AS n FROM region, nation, customer, orders WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY r_name",
    "join_self": "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_using": "SELECT COUNT(*) AS n FROM (SELECT o_custkey AS k FROM orders) a JOIN (SELECT c_custkey AS k FROM customer) b USING (k)",
    "join_expr_key": "SELECT COUNT(*) AS n FROM orders JOIN supplier ON o_custkey % 100 = s_suppkey - 1",
    "join_or_common": "SELECT COUNT(*) AS n FROM orders, customer WHERE (o_custkey = c_custkey AND o_orderstatus = 'F') OR (o_custkey = c_custkey AND c_mktsegment = 'MACHINERY')",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "in_sub": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "not_in_sub": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')",
    "not_in_null": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey = 1 THEN NULL ELSE o_custkey END FROM orders)",
    "scalar_sub_uncorr": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.9 FROM orders)",
    "scalar_sub_corr": "SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT MAX(x.o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)",
    "scalar_sub_select": "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
    "win_rank": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER w AS INT) AS rn, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INT) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_ntile": "SELECT o_orderkey, CAST(NTILE(4) OVER w AS INT) AS q, ROUND(PERCENT_RANK() OVER w, 6) AS pr, ROUND(CUME_DIST() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)",
    "win_lag_lead": "SELECT o_orderkey, LAG(o_orderkey) OVER w AS prev, LEAD(o_orderkey, 2) OVER w AS next2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_sum_rows": "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders",
    "win_range": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS n FROM orders",
    "win_first_last": "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l, NTH_VALUE(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_over_agg": "SELECT o_custkey, COUNT(*) AS n, CAST(RANK() OVER (ORDER BY COUNT(*) DESC) AS INT) AS r FROM orders GROUP BY o_custkey",
    "qualify_topk": "SELECT o_orderkey, CAST(rn AS INT) AS rn FROM (SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2",
    "topn": "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20",
    "distinct_topn": "SELECT DISTINCT c_nationkey FROM customer ORDER BY c_nationkey DESC NULLS LAST LIMIT 5",
    "cte": "WITH t AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT a.k, a.n FROM t a JOIN (SELECT MAX(n) AS m FROM t) b ON a.n = b.m",
    "derived_table": "SELECT k, v FROM (SELECT c_custkey, c_nationkey FROM customer) AS t(k, v) WHERE v < 3",
    "scalar_functions": "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, CAST(LENGTH(c_name) AS INT) AS n, SUBSTRING(c_name, 3, 5) AS s, REPLACE(c_name, '#', '-') AS r, c_name || '!' AS cc, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS co, LPAD(CAST(c_custkey AS STRING), 8, '0') AS lp, TRIM('  x ') AS t FROM customer",
    "math_functions": "SELECT o_orderkey, ABS(o_custkey - 500) AS a, CAST(FLOOR(o_totalprice) AS BIGINT) AS f, CAST(CEIL(o_totalprice) AS BIGINT) AS c, ROUND(SQRT(o_totalprice), 6) AS s, ROUND(POWER(o_custkey, 2), 6) AS p, o_orderkey % 13 AS m, GREATEST(o_custkey, o_orderkey) AS g, LEAST(o_custkey, o_orderkey) AS l, CAST(SIGN(o_custkey - 700) AS INT) AS sg FROM orders",
    "date_functions": "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INT) AS y, CAST(MONTH(o_orderdate) AS INT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS INT) AS d, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS mo, CAST(o_orderdate + INTERVAL '7' DAY AS DATE) AS wk FROM orders",
    "case_if": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS s FROM part",
    "tpch_q1_like": FLAGSHIP.format(lineitem="lineitem"),
    "tpch_q3_like": f"SELECT l_orderkey, {REVENUE} AS revenue FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00' GROUP BY l_orderkey ORDER BY revenue DESC NULLS LAST, l_orderkey LIMIT 10",
    "tpch_q4_like": "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1993-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-10-01 00:00:00' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority",
    "tpch_q5_like": f"SELECT n_name, {REVENUE} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name",
    "tpch_q6_like": f"SELECT CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT) * CAST(ROUND(l_discount * 100) AS BIGINT)) AS BIGINT) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24",
    "tpch_q10_like": f"SELECT c_custkey, c_name, {REVENUE} AS revenue FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY c_custkey, c_name ORDER BY revenue DESC NULLS LAST, c_custkey LIMIT 20",
    "tpch_q12_like": "SELECT l_linestatus, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders, lineitem WHERE o_orderkey = l_orderkey GROUP BY l_linestatus",
    "tpch_q13_like": "SELECT n, COUNT(*) AS customers FROM (SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) t GROUP BY n",
    "tpch_q14_like": "SELECT ROUND(100.0 * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN CAST(ROUND(l_extendedprice * 100) AS BIGINT) ELSE 0 END) / SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)), 4) + 0e0 AS promo FROM lineitem, part WHERE l_partkey = p_partkey",
    "tpch_q17_like": "SELECT COUNT(*) AS n FROM lineitem l, part WHERE p_partkey = l_partkey AND p_size < 20 AND l_quantity < (SELECT 0.5 * AVG(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)",
    "tpch_q18_like": "SELECT c_name, o_orderkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(CAST(l_quantity AS BIGINT)) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, o_orderkey",
    "tpch_q21_like": "SELECT s_suppkey, COUNT(*) AS n FROM supplier, lineitem a WHERE s_suppkey = a.l_suppkey AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R') GROUP BY s_suppkey",
    "tpch_q22_like": "SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey",
    "bids_currency": "SELECT event_id, user_id, ROUND(value * 0.908, 4) AS euro FROM events",
    "bids_selected": "SELECT event_id, value FROM events WHERE user_id % 123 = 5 OR user_id % 77 = 1",
    "bids_by_channel": "SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "bids_local": "SELECT c_name, n_name, event_id FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
    "bids_top_by_user": "SELECT event_id, user_id FROM (SELECT event_id, user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) t WHERE r = 1",
}

#: Queries kept up to date; tables stand in braces.
MAINTAINED: dict[str, str] = {
    "inc_agg": f"SELECT l_returnflag, COUNT(*) AS n, CAST(SUM({PRICE}) AS DOUBLE) AS total, ROUND(AVG(l_quantity), 6) AS mean FROM {{lineitem}} WHERE l_quantity > 5 GROUP BY l_returnflag",
    "inc_agg_global": "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s FROM {orders}",
    "inc_stddev": "SELECT l_linestatus, ROUND(STDDEV_SAMP(l_quantity), 4) AS sd FROM {lineitem} GROUP BY l_linestatus",
    "inc_minmax": "SELECT o_orderpriority, MIN(o_custkey) AS low, MAX(o_custkey) AS high, COUNT(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderpriority",
    "inc_join_inner": "SELECT o_orderkey, c_name FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey WHERE c_nationkey < 12",
    "inc_join_left": "SELECT c_custkey, o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "inc_join_full": "SELECT c_custkey, s_suppkey FROM {customer} c FULL JOIN {supplier} s ON c_custkey = s_suppkey",
    "inc_semi": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30)",
    "inc_anti": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "inc_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey",
    "inc_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "inc_intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "inc_except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "inc_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}",
    "inc_rollup": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "inc_over": "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS s FROM {orders}",
    "inc_topn": "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 15",
    "inc_scalar_sub": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.9 FROM {orders})",
    "inc_cte": "WITH t AS (SELECT o_custkey AS k, COUNT(*) AS n FROM {orders} GROUP BY o_custkey) SELECT a.k, a.n FROM t a JOIN (SELECT MAX(n) AS m FROM t) b ON a.n = b.m",
    "inc_tpch_q3_like": f"SELECT l_orderkey, {REVENUE} AS revenue FROM {{customer}} c, {{orders}} o, {{lineitem}} l WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey GROUP BY l_orderkey ORDER BY revenue DESC NULLS LAST, l_orderkey LIMIT 10",
    "inc_recursive": "WITH RECURSIVE reach(k) AS (SELECT n_regionkey FROM {nation} WHERE n_nationkey = 1 UNION SELECT n_nationkey FROM reach JOIN {nation} n ON n_regionkey = k) SELECT k FROM reach",
}

#: Batch queries that are maintained too.
ALSO_MAINTAINED = ("tpch_q4_like", "tpch_q12_like", "tpch_q13_like", "tpch_q22_like", "win_rank", "qualify_topk", "grouping_sets", "scalar_sub_corr", "join_expr_key", "bids_by_channel", "bids_top_by_user")


def in_braces(sql: str) -> str:
    """The query with its tables in braces."""
    return re.sub(rf"\b({'|'.join(TABLES)})\b", r"{\1}", sql)


MAINTAINED |= {f"inc_{k}": in_braces(BATCH[k]) for k in ALSO_MAINTAINED}

TIMES = "event_id ; user_id ; event_type ; value ; unix_millis(cast(ts as timestamp)) AS t"
EVENT_TIMES = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS t FROM events WHERE event_id % 7 <> 0)"
COUNT_SUM = (p.Agg("n", "count"), p.Agg("users", "sum", "user_id"))
MINUTE, HOUR = 60_000, 3_600_000


def _windowed(kind: str, **lengths: int) -> Query:
    nodes = (p.Input("e", "events"), p.TimeWindow("w", "e", kind, "t", keys=("event_type",), aggregates=COUNT_SUM, **lengths))
    return maintained_plan(nodes, ("events",), {"events": TIMES})


def tumble_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own window() over timestamps."""
    w = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.unix_millis(F.col("w.start").cast("timestamp")).alias("w_start"), "n")


def _watermarked(policy: str) -> Query:
    """Two batches, the second of which has rows from before the first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").selectExpr(*TIMES.split(" ; "))
        graph = StreamGraph(p.Plan((p.Input("e", "events"), p.Watermark("w", "e", "t", HOUR, policy)), "w"), spark)
        graph.push({"events": rows.where("event_id % 2 = 0")})
        graph.push({"events": rows.where("event_id % 2 = 1")})
        return graph.result().select("event_id", *(["_late"] if policy == "side" else []))

    return run


_LATE = f"""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS t, event_id % 2 AS b FROM events),
m AS (SELECT *, CASE WHEN b = 0 THEN (SELECT MAX(t) FROM e WHERE b = 0) ELSE (SELECT MAX(t) FROM e) END - {HOUR} AS wm FROM e) """

RATES = "s_suppkey ; s_suppkey % 10 AS k ; (s_suppkey * 37) % 900 AS lo ; (s_suppkey * 37) % 900 + 60 AS hi"
SPANS = "o_orderkey ; o_custkey % 10 AS j ; o_custkey AS at ; o_custkey + 20 AS til"


def _interval(mode: str) -> Query:
    join = p.IntervalJoin("j", "o", "s", (("j", "k"),), mode, "at", "lo", "hi", "til" if mode == "overlap" else None)
    nodes = (p.Input("o", "orders"), p.Input("s", "supplier"), join, p.Project("x", "j", (("o_orderkey", "o_orderkey"), ("s_suppkey", "s_suppkey"))))
    return maintained_plan(nodes, ("orders", "supplier"), {"orders": SPANS, "supplier": RATES})


def interval_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join without equal keys, cut at stretches so that it shuffles on equality."""
    left = table(spark, sf_dir, "orders").selectExpr(*SPANS.split(" ; "))
    right = table(spark, sf_dir, "supplier").selectExpr(*RATES.split(" ; "))
    node = p.IntervalJoin("j", "l", "r", (), "overlap", "at", "lo", "hi", "til")
    return batch.bucketed_interval_join(left, right, node, 100).select("o_orderkey", "s_suppkey")


def string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = p.Agg("keys", "string_agg", "o_orderkey", "|", (p.Order("o_orderkey", True),))
    return maintained_plan((p.Input("o", "orders"), p.Aggregate("a", "o", ("o_custkey",), (agg,))), ("orders",))(spark, sf_dir)


def topn_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = p.TopN("t", "o", (p.Order("o_totalprice", True), p.Order("o_orderkey")), 3, ("o_orderpriority",))
    return maintained_plan((p.Input("o", "orders", ("o_orderkey", "o_orderpriority", "o_totalprice")), top), ("orders",))(spark, sf_dir).select("o_orderpriority", "o_orderkey")


def recompute_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate that sums can't keep: the whole query is recomputed and compared."""
    return maintain("SELECT o_orderstatus, MEDIAN(o_custkey) AS m FROM {orders} GROUP BY o_orderstatus", on_unsupported="recompute")(spark, sf_dir)


# -- changes, versions, views ---------------------------------------------------


def _order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as they came, then a price change for each fifth, then deletes of each seventh."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("v"))
    a = o.withColumns({"_sync_op": F.lit(0), "_sync_order": F.lit(1).cast("long")})
    b = o.where("o_orderkey % 5 = 0").withColumns({"v": F.col("v") + 1_000_000, "_sync_op": F.lit(0), "_sync_order": F.lit(2).cast("long")})
    c = o.where("o_orderkey % 7 = 0").withColumns({"_sync_op": F.lit(1), "_sync_order": F.lit(3).cast("long")})
    return a.unionAll(b).unionAll(c)


def keyed_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    mirror = changelog.KeyedMirror(["o_orderkey"], spark)
    changes = _order_changes(spark, sf_dir)
    for k in (1, 2, 3):
        mirror.apply(changes.where(F.col("_sync_order") == k))
    return mirror.snapshot()


def snapshot_cdc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _order_changes(spark, sf_dir)
    snapshot = changes.where("_sync_order = 1").drop("_sync_op", "_sync_order")
    return changelog.merge_snapshot(snapshot, changes.where("_sync_order > 1"), ["o_orderkey"])


def fixed_version_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _order_changes(spark, sf_dir).withColumn("commit_seq", F.col("_sync_order"))
    return changelog.as_of(changelog.row_versions(changes, ["o_orderkey"]), 2)


def view_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lower = StreamGraph(compile_sql(spark, "SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey", {"orders": orders}), spark)
    schema = spark.sql("SELECT CAST(1 AS BIGINT) AS k, CAST(1 AS BIGINT) AS n").schema
    upper = StreamGraph(compile_sql(spark, "SELECT n, COUNT(*) AS customers FROM counts GROUP BY n", {"counts": schema}), spark)
    view = MaterializedView(lower, upper, "counts")
    for i, cut in enumerate((FIRST, SECOND, GONE), 1):
        view.push({"orders": z.weighted(orders.where(cut.format("o_orderkey")), -1 if cut is GONE else 1)}, i)
    return upper.result()


def upsert_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    graph = StreamGraph(compile_sql(spark, "SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey", {"orders": orders}), spark)
    sink = UpsertSink(spark, ["k"])
    for i, cut in enumerate((FIRST, SECOND, GONE)):
        delta = graph.push({"orders": z.weighted(orders.where(cut.format("o_orderkey")), -1 if cut is GONE else 1)})
        sink.write(f"d{i}", delta)
        sink.write(f"d{i}", delta)
    return sink.read()


def pair_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", pair_id("o_orderkey", "c_custkey").alias("pair"))


# -- user functions --------------------------------------------------------------


def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    UdfRegistry(spark).register("wf_halve", "scalar", "def call(x):\n    return None if x is None else x // 2", "long")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("wf_halve(o_custkey)").alias("h"))


def udaf_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = UdfRegistry(spark)
    source = "def accumulate(s, v):\n    return s + v\ndef retract(s, v):\n    return s - v\ndef finish(s):\n    return s"
    registry.register("wf_total", "aggregate", source, "long")
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", "o_orderkey")
    rows = z.weighted(o).unionAll(z.weighted(o.where("o_orderkey % 7 = 0"), -1))
    return registry.aggregate("wf_total", rows, ["o_orderstatus"], "o_custkey", "total")


def udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    UdfRegistry(spark).register("wf_upto", "table", "def rows(n):\n    return [(i,) for i in range(n)]", "i int")
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, i FROM nation, LATERAL wf_upto(n_regionkey)")


def sql_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    macro(spark, "wf_band", "x BIGINT", "STRING", "CASE WHEN x < 500 THEN 'low' ELSE 'high' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("wf_band(o_custkey)").alias("band"))


def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), text.byte_length(F.col("event_type")).cast("long").alias("bytes"), text.truncate_bytes(F.col("event_type"), 3).alias("short"))


def join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.pairs_within(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", ("x", "y"))


#: Batch queries that do not run by their SQL, which Spark would plan as one task or as all compared with all.
FORMS: dict[str, Query] = {"join_self": join_self, "star_returned_or_inactive": run_sql(more.RETURNED_OR_INACTIVE)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain(FLAGSHIP)(spark, sf_dir)


APIS: dict[str, tuple[Query, str]] = {
    "flagship": (flagship, survivors(FLAGSHIP)),
    "tumble": (_windowed("tumble", size=HOUR), f"SELECT event_type, t - t % {HOUR} AS w_start, t - t % {HOUR} + {HOUR} AS w_end, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS users FROM {EVENT_TIMES} GROUP BY ALL"),
    "tumble_batch": (tumble_batch, f"SELECT event_type, epoch_us(ts) // 1000 - epoch_us(ts) // 1000 % {HOUR} AS w_start, COUNT(*) AS n FROM events GROUP BY ALL"),
    "hop": (
        _windowed("hop", size=HOUR, slide=20 * MINUTE),
        f"SELECT event_type, w_start, w_start + {HOUR} AS w_end, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS users FROM (SELECT *, t - t % {20 * MINUTE} - {20 * MINUTE} * unnest([0, 1, 2]) AS w_start FROM {EVENT_TIMES}) GROUP BY ALL",
    ),
    "cumulate": (
        _windowed("cumulate", size=HOUR, step=20 * MINUTE),
        f"SELECT event_type, w_start, w_end, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS users FROM (SELECT *, t - t % {HOUR} AS w_start, t - t % {HOUR} + {20 * MINUTE} * unnest([1, 2, 3]) AS w_end FROM {EVENT_TIMES}) WHERE t < w_end GROUP BY ALL",
    ),
    "session": (
        _windowed("session", gap=10 * MINUTE),
        f"SELECT event_type, MIN(t) AS w_start, MAX(t) AS w_end, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS users FROM (SELECT *, SUM(o) OVER (PARTITION BY event_type ORDER BY t, event_id) AS s FROM (SELECT *, CASE WHEN t - LAG(t) OVER (PARTITION BY event_type ORDER BY t, event_id) <= {10 * MINUTE} THEN 0 ELSE 1 END AS o FROM {EVENT_TIMES})) GROUP BY event_type, s",
    ),
    "watermark_drop": (_watermarked("drop"), _LATE + "SELECT event_id FROM m WHERE t >= wm"),
    "watermark_side": (_watermarked("side"), _LATE + "SELECT event_id, CAST(t < wm AS INT) AS _late FROM m"),
    "watermark_recompute": (_watermarked("recompute"), "SELECT event_id FROM events"),
    "interval_contains_point": (_interval("contains_point"), "SELECT o_orderkey, s_suppkey FROM orders, supplier WHERE o_orderkey % 7 <> 0 AND s_suppkey % 7 <> 0 AND o_custkey % 10 = s_suppkey % 10 AND (s_suppkey * 37) % 900 <= o_custkey AND o_custkey < (s_suppkey * 37) % 900 + 60"),
    "interval_overlap": (_interval("overlap"), "SELECT o_orderkey, s_suppkey FROM orders, supplier WHERE o_orderkey % 7 <> 0 AND s_suppkey % 7 <> 0 AND o_custkey % 10 = s_suppkey % 10 AND o_custkey < (s_suppkey * 37) % 900 + 60 AND (s_suppkey * 37) % 900 < o_custkey + 20"),
    "interval_bucketed": (interval_bucketed, "SELECT o_orderkey, s_suppkey FROM orders, supplier WHERE o_custkey < (s_suppkey * 37) % 900 + 60 AND (s_suppkey * 37) % 900 < o_custkey + 20"),
    "agg_string_agg": (string_agg, "SELECT o_custkey, STRING_AGG(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey DESC) AS keys FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey"),
    "topn_partition": (topn_partition, "SELECT o_orderpriority, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderkey % 7 <> 0) WHERE r <= 3"),
    "recompute_fallback": (recompute_fallback, "SELECT o_orderstatus, MEDIAN(o_custkey) AS m FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_orderstatus"),
    "keyed_mirror": (keyed_mirror, "SELECT o_orderkey, o_custkey, o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000 ELSE 0 END AS v FROM orders WHERE o_orderkey % 7 <> 0"),
    "snapshot_cdc_merge": (snapshot_cdc_merge, "SELECT o_orderkey, o_custkey, o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000 ELSE 0 END AS v FROM orders WHERE o_orderkey % 7 <> 0"),
    "fixed_version_snapshot": (fixed_version_snapshot, "SELECT o_orderkey, o_custkey, o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000 ELSE 0 END AS v FROM orders"),
    "view_chain": (view_chain, "SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey) GROUP BY n"),
    "upsert_sink": (upsert_sink, "SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey"),
    "pair_identity": (pair_identity, "SELECT o_orderkey, c_custkey, sha256(length(o_orderkey::VARCHAR) || ':' || o_orderkey || '|' || length(c_custkey::VARCHAR) || ':' || c_custkey) AS pair FROM orders JOIN customer ON o_custkey = c_custkey"),
    "udf_scalar": (udf_scalar, "SELECT o_orderkey, o_custkey // 2 AS h FROM orders"),
    "udaf_retract": (udaf_retract, "SELECT o_orderstatus, CAST(SUM(o_custkey) AS BIGINT) AS total FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_orderstatus"),
    "udtf": (udtf, "SELECT n_nationkey, CAST(i AS INT) AS i FROM (SELECT n_nationkey, unnest(range(n_regionkey)) AS i FROM nation)"),
    "sql_macro": (sql_macro, "SELECT o_orderkey, CASE WHEN o_custkey < 500 THEN 'low' ELSE 'high' END AS band FROM orders"),
    "json_text": (json_text, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(strlen(event_type) AS BIGINT) AS bytes, event_type[1:3] AS short FROM events"),
}


BATCH |= more.SHAPES
MAINTAINED |= more.MAINTAINED_SHAPES | {f"inc_{k}": in_braces(BATCH[k]) for k in more.ALSO_MAINTAINED}
APIS |= more.APIS | {k: (run_sql(ours), theirs) for k, (ours, theirs) in more.PAIRS.items()}
APIS |= {k: (maintain(ours, dialect="mysql"), theirs) for k, (ours, theirs) in more.MAINTAINED_PAIRS.items()}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in APIS.items()} | {k: FORMS.get(k) or run_sql(s) for k, s in BATCH.items()} | {k: maintain(s) for k, s in MAINTAINED.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in APIS.items()} | dict(BATCH) | {k: survivors(s) for k, s in MAINTAINED.items()}
