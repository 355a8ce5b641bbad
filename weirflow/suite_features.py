"""More queries for the suite: other shapes of star-schema queries, functions that the engines spell differently, and the engine's own parts at work."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.catalog import Catalog, Rebuild
from weirflow.functions import text
from weirflow.functions.udf import UdfError, UdfRegistry
from weirflow.operators import zset as z
from weirflow.plans import nodes as p
from weirflow.plans.frontend import compile_sql
from weirflow.plans.graph import StreamGraph
from weirflow.plans.sharing import Admission, Cost, pareto, reuse
from weirflow.sources import changelog
from weirflow.sources import connectors as cn
from weirflow.sources.folders import Folder, shared_root
from weirflow.streaming.checkpoint import CheckpointCoordinator
from weirflow.streaming.metrics import Trace, explain_analyze, scraped
from weirflow.streaming.runner import Epochs, Job, batch_limit, verify

CENTS = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"

#: Text that both engines read alike.
SHAPES: dict[str, str] = {
    "tpch_q2_like": f"SELECT DISTINCT s_suppkey, p_partkey FROM part, lineitem, supplier, nation WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND s_nationkey = n_nationkey AND p_size = 15 AND {CENTS} = (SELECT MIN(CAST(ROUND(x.l_extendedprice * 100) AS BIGINT)) FROM lineitem x WHERE x.l_partkey = p_partkey)",
    "tpch_q7_like": f"SELECT a.n_name AS supp, b.n_name AS cust, CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS y, CAST(SUM({CENTS}) AS BIGINT) AS volume FROM supplier, lineitem, orders, customer, nation a, nation b WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = a.n_nationkey AND c_nationkey = b.n_nationkey AND a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_name, b.n_name, CAST(EXTRACT(YEAR FROM l_shipdate) AS INT)",
    "tpch_q8_like": f"SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, CAST(SUM(CASE WHEN s_nationkey = 3 THEN {CENTS} ELSE 0 END) AS BIGINT) AS own, CAST(SUM({CENTS}) AS BIGINT) AS total FROM part, supplier, lineitem, orders, customer, nation WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = 1 GROUP BY CAST(EXTRACT(YEAR FROM o_orderdate) AS INT)",
    "tpch_q9_like": f"SELECT n_name, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, CAST(SUM({CENTS} - CAST(l_quantity AS BIGINT)) AS BIGINT) AS profit FROM part, supplier, lineitem, orders, nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%a%' GROUP BY n_name, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT)",
    "tpch_q11_like": f"SELECT l_partkey, CAST(SUM({CENTS}) AS BIGINT) AS v FROM lineitem, supplier WHERE l_suppkey = s_suppkey AND s_nationkey < 5 GROUP BY l_partkey HAVING SUM({CENTS}) > (SELECT SUM(CAST(ROUND(x.l_extendedprice * 100) AS BIGINT)) / 1000 FROM lineitem x, supplier y WHERE x.l_suppkey = y.s_suppkey AND y.s_nationkey < 5)",
    "tpch_q15_like": f"WITH r AS (SELECT l_suppkey AS k, CAST(SUM({CENTS}) AS BIGINT) AS total FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier, r WHERE s_suppkey = k AND total = (SELECT MAX(total) FROM r)",
    "tpch_q16_like": "SELECT p_brand, p_size, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_size",
    "tpch_q19_like": f"SELECT CAST(SUM({CENTS}) AS BIGINT) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 1 AND 10 AND l_quantity BETWEEN 10 AND 20) OR (p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 20 AND 30))",
    "tpch_q20_like": "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%a%') GROUP BY l_suppkey, l_partkey HAVING SUM(CAST(l_quantity AS BIGINT)) > 60)",
    "star_returns_above_average": f"WITH t AS (SELECT o_custkey AS c, c_nationkey AS n, CAST(SUM({CENTS}) AS BIGINT) AS v FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_returnflag = 'R' GROUP BY o_custkey, c_nationkey) SELECT c, v FROM t a WHERE v > (SELECT AVG(v) * 1.2 FROM t b WHERE a.n = b.n)",
    "star_channels": f"SELECT k, channel, COUNT(*) AS n, CAST(SUM(v) AS BIGINT) AS v FROM (SELECT c_nationkey AS k, 'web' AS channel, o_custkey AS v FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT s_nationkey, 'lines', l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT c_nationkey, 'clicks', user_id FROM events JOIN customer ON user_id = c_custkey) t GROUP BY ROLLUP (k, channel)",
    "star_year_over_year": f"WITH t AS (SELECT l_suppkey AS s, CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS y, CAST(SUM({CENTS}) AS BIGINT) AS v FROM lineitem GROUP BY l_suppkey, CAST(EXTRACT(YEAR FROM l_shipdate) AS INT)) SELECT a.s, a.y, a.v - b.v AS more FROM t a JOIN t b ON a.s = b.s AND a.y = b.y + 1 WHERE a.v > b.v",
    "star_share_of_class": f"SELECT p_brand, p_type, v, ROUND(v * 100.0 / SUM(v) OVER (PARTITION BY p_brand), 4) + 0e0 AS share FROM (SELECT p_brand, p_type, CAST(SUM({CENTS}) AS BIGINT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_type) t",
    "star_bought_in_all": "SELECT c FROM (SELECT o_custkey AS c FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT user_id FROM events) t",
    "star_only_orders": "SELECT COUNT(*) AS n FROM (SELECT o_custkey AS c FROM orders EXCEPT SELECT user_id FROM events) t",
    "star_best_and_worst": "SELECT r, a.s AS best, b.s AS worst FROM (SELECT l_suppkey AS s, CAST(RANK() OVER (ORDER BY COUNT(*) DESC, l_suppkey) AS INT) AS r FROM lineitem GROUP BY l_suppkey) a JOIN (SELECT l_suppkey AS s, CAST(RANK() OVER (ORDER BY COUNT(*), l_suppkey) AS INT) AS r2 FROM lineitem GROUP BY l_suppkey) b ON r = r2 WHERE r <= 10",
    "star_pivot": "SELECT c_mktsegment, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CAST(SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "star_running": "SELECT k, d, CAST(SUM(n) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM (SELECT o_orderpriority AS k, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS d, COUNT(*) AS n FROM orders GROUP BY o_orderpriority, CAST(DATE_TRUNC('month', o_orderdate) AS DATE)) t",
    "star_first_order": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) t ON c_custkey = o_custkey AND r = 1",
    "star_returned_or_inactive": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders, lineitem WHERE o_custkey = c.c_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R') OR c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
    "star_gap_days": "SELECT o_custkey, MAX(gap) AS widest FROM (SELECT o_custkey, o_orderkey - LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders) t GROUP BY o_custkey HAVING MAX(gap) IS NOT NULL",
    "star_cube_share": "SELECT n_regionkey, c_mktsegment, CAST(GROUPING(n_regionkey) AS INT) + CAST(GROUPING(c_mktsegment) AS INT) AS level, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)",
    "star_distinct_by": "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS c, COUNT(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS f FROM orders GROUP BY o_orderpriority",
    "star_nested_in": "SELECT COUNT(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)))",
    "star_moving_average": "SELECT d, ROUND(AVG(n) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS m FROM (SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS d, COUNT(*) AS n FROM orders GROUP BY CAST(DATE_TRUNC('month', o_orderdate) AS DATE)) t",
    "star_outer_chain": "SELECT n_name, COUNT(c_custkey) AS customers, COUNT(o_orderkey) AS n_orders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY n_name",
    "one_row_limit": "SELECT COUNT(*) AS n FROM orders LIMIT 1",
    "order_without_limit": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name DESC NULLS LAST",
    "try_cast": "SELECT p_partkey, TRY_CAST(p_brand AS INT) AS none, TRY_CAST(CAST(p_size AS VARCHAR(9)) AS INT) AS size FROM part",
    "ilike": "SELECT p_partkey, p_name ILIKE '%A%E%' AS i FROM part",
    "string_family": "SELECT c_custkey, LEFT(c_name, 4) AS l, RIGHT(c_name, 3) AS r, CAST(POSITION('#' IN c_name) AS INT) AS p, LPAD(c_mktsegment, 12, '*') AS lp, RTRIM(c_mktsegment) AS rt, REVERSE(c_mktsegment) AS rv FROM customer",
}

#: Maintained forms, over the rows that are left.
#: star_returned_or_inactive with equalities alone: NOT IN under an OR compares every customer with every event, as the key may be null.
#: NOT IN a list without nulls holds if the list is empty, or if the key is not null and not in it.
RETURNED_OR_INACTIVE = """SELECT c_custkey FROM customer c
WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders, lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') WHERE o_custkey = c.c_custkey)
  OR NOT EXISTS (SELECT 1 FROM events WHERE user_id IS NOT NULL)
  OR (c_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id FROM events) WHERE user_id = c.c_custkey))"""

MAINTAINED_SHAPES: dict[str, str] = {
    "inc_sum_double": "SELECT o_orderpriority, ROUND(SUM(CASE WHEN o_orderkey % 49 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN o_orderkey % 77 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 63 = 0 THEN 1e300 ELSE o_totalprice END), 2) AS s FROM {orders} GROUP BY o_orderpriority",
    "inc_avg_double": "SELECT l_returnflag, l_linestatus, ROUND(AVG(CASE WHEN l_orderkey % 49 = 0 THEN 1e200 ELSE l_extendedprice END), 4) AS a FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "inc_stddev_double": "SELECT o_orderstatus, ROUND(STDDEV_SAMP(o_totalprice + 1e6), 4) AS sd, ROUND(MIN(o_totalprice), 2) AS lo FROM {orders} GROUP BY o_orderstatus",
    "inc_order_without_limit": "SELECT s_suppkey, s_name FROM {supplier} ORDER BY s_name",
    "inc_one_row_limit": "SELECT COUNT(*) AS n FROM {orders} LIMIT 1",
    "inc_recursive_all": "WITH RECURSIVE steps(k, n) AS (SELECT n_nationkey, 1 FROM {nation} WHERE n_regionkey = 1 UNION ALL SELECT k, n + 1 FROM steps WHERE n < 4) SELECT k, n FROM steps",
    "inc_union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "inc_intersect": "SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey FROM {customer} WHERE c_nationkey < 10",
    "inc_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'",
}

ALSO_MAINTAINED = ("tpch_q11_like", "tpch_q15_like", "tpch_q16_like", "tpch_q19_like", "tpch_q20_like", "star_channels", "star_pivot", "star_first_order", "star_distinct_by", "star_outer_chain", "star_cube_share", "star_bought_in_all")

#: The same in both engines' own words: (Spark, SQL for comparison).
PAIRS: dict[str, tuple[str, str]] = {
    "regexp": ("SELECT c_custkey, regexp_replace(c_name, '[0-9]+', 'N') AS r, c_name RLIKE '7$' AS m, regexp_extract(c_name, '0*([1-9][0-9]*)', 1) AS x FROM customer", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS r, regexp_matches(c_name, '7$') AS m, regexp_extract(c_name, '0*([1-9][0-9]*)', 1) AS x FROM customer"),
    "date_arithmetic": ("SELECT o_orderkey, datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS d, date_add(CAST(o_orderdate AS DATE), 10) AS later, add_months(CAST(o_orderdate AS DATE), 1) AS m, last_day(CAST(o_orderdate AS DATE)) AS l FROM orders", "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INT) AS d, CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS later, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, last_day(CAST(o_orderdate AS DATE)) AS l FROM orders"),
    "integer_division": ("SELECT o_orderkey, o_custkey div 7 AS q, o_custkey % 7 AS r FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey % 7 AS r FROM orders"),
    "arrays": ("SELECT n_nationkey, size(a) AS n, array_contains(a, 2) AS two, array_max(a) AS hi, element_at(a, 2) AS second, array_join(transform(a, x -> CAST(x * 2 AS STRING)), '-') AS j, size(filter(a, x -> x > 2)) AS big FROM (SELECT n_nationkey, array(n_regionkey, n_nationkey, 2) AS a FROM nation)", "SELECT n_nationkey, CAST(len(a) AS INT) AS n, list_contains(a, 2) AS two, list_max(a) AS hi, a[2] AS second, array_to_string([CAST(x * 2 AS VARCHAR) for x in a], '-') AS j, CAST(len([x for x in a if x > 2]) AS INT) AS big FROM (SELECT n_nationkey, [n_regionkey, n_nationkey, 2] AS a FROM nation)"),
    "maps_and_structs": ("SELECT n_nationkey, m['a'] AS a, try_element_at(m, 'z') AS z, size(map_keys(m)) AS n, s.name AS name FROM (SELECT n_nationkey, map('a', n_regionkey, 'b', n_nationkey) AS m, named_struct('name', n_name, 'k', n_nationkey) AS s FROM nation)", "SELECT n_nationkey, m['a'] AS a, m['z'] AS z, CAST(len(map_keys(m)) AS INT) AS n, s.name AS name FROM (SELECT n_nationkey, map {'a': n_regionkey, 'b': n_nationkey} AS m, {'name': n_name, 'k': n_nationkey} AS s FROM nation)"),
    "generators": ("SELECT n_nationkey, i, v FROM nation LATERAL VIEW posexplode(sequence(n_nationkey, n_nationkey + n_regionkey)) t AS i, v", "SELECT n_nationkey, CAST(i AS INT) AS i, CAST(n_nationkey + i AS INT) AS v FROM (SELECT n_nationkey, unnest(range(n_regionkey + 1)) AS i FROM nation)"),
    "json_extract": ("SELECT event_id, get_json_object(props, '$.k') AS k, from_json(props, 'k BIGINT').k AS n FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS n FROM events"),
    "epoch_seconds": ("SELECT event_id, unix_millis(CAST(ts AS TIMESTAMP)) div 1000 AS s, CAST(timestamp_millis(unix_millis(CAST(ts AS TIMESTAMP)) div 86400000 * 86400000) AS DATE) AS d FROM events", "SELECT event_id, epoch_us(ts) // 1000000 AS s, CAST(ts AS DATE) AS d FROM events"),
}

#: Maintained queries that the engines spell differently: (ours, with tables in braces; SQL over rows that are left).
MAINTAINED_PAIRS: dict[str, tuple[str, str]] = {
    "inc_qualify": ("SELECT o_orderkey, o_custkey FROM {orders} QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "inc_generator": ("SELECT s_suppkey, i FROM {supplier} LATERAL VIEW explode(sequence(1, s_nationkey)) t AS i WHERE s_nationkey > 0", "SELECT s_suppkey, CAST(unnest(range(1, s_nationkey + 1)) AS INT) AS i FROM supplier WHERE s_suppkey % 7 <> 0 AND s_nationkey > 0"),
    "inc_group_concat": ("SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name SEPARATOR ';') AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ';' ORDER BY n_name) AS names FROM nation WHERE n_nationkey % 7 <> 0 GROUP BY n_regionkey"),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _room(spark: SparkSession) -> Folder:
    """A new folder that goes with the session."""
    import uuid

    return Folder(spark, f"{shared_root(spark)}/weirflow-suite-{uuid.uuid4().hex}", passing=True)


def _thirds(df: DataFrame, key: str) -> list[DataFrame]:
    """Two insert batches and a retraction."""
    return [z.weighted(df.where(f"{key} % 3 <> 0")), z.weighted(df.where(f"{key} % 3 = 0")), z.weighted(df.where(f"{key} % 7 = 0"), -1)]


COUNTS = "SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey"
COUNTS_LEFT = "SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey"


def _counts(spark: SparkSession, orders: DataFrame) -> StreamGraph:
    return StreamGraph(compile_sql(spark, COUNTS, {"orders": orders}), spark)


def late_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink published after half of the batches, and one that has been there throughout."""
    orders = _table(spark, sf_dir, "orders")
    c = Catalog(spark, {"orders": orders})
    c.execute("SET low = 0")
    c.execute("CREATE MODEL some AS SELECT * FROM orders WHERE o_orderkey > ${low}")
    c.execute("CREATE SINK first KEY (k) AS SELECT o_custkey AS k, COUNT(*) AS n FROM some GROUP BY o_custkey")
    c.publish()
    for i, batch in enumerate(_thirds(orders, "o_orderkey")):
        c.push({"orders": batch}, f"d{i}")
        if i == 0:
            c.execute("CREATE SINK late KEY (k) AS SELECT o_custkey AS k, MAX(o_orderkey) AS m FROM some GROUP BY o_custkey")
            c.publish()
    return c.sinks["first"].read().join(c.sinks["late"].read(), "k")


def savepoint_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch applied after a savepoint, undone by restoring it, and applied again."""
    orders = _table(spark, sf_dir, "orders")
    graph = _counts(spark, orders)
    epochs, batches = Epochs(graph), _thirds(orders, "o_orderkey")
    epochs.run(0, {"orders": batches[0]})
    graph.store.savepoint("s")
    epochs.run(1, {"orders": batches[0]})
    graph.store.restore("s")
    for epoch, batch in ((1, batches[1]), (1, batches[1]), (2, batches[2])):
        epochs.run(epoch, {"orders": batch})
    return graph.result()


def barrier_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    graph, batches = _counts(spark, orders), _thirds(orders, "o_orderkey")
    c, sink = CheckpointCoordinator(graph), cn.UpsertSink(spark, ["k"])
    for epoch, batch in enumerate(batches[:2], 1):
        delta = graph.push({"orders": batch})
        c.emit(epoch, delta, lambda rows, epoch=epoch: sink.write(f"e{epoch}", rows))
        if epoch == 1:
            c.start_barrier(1, 100)
            c.commit_barrier(1)
    c = CheckpointCoordinator(graph)
    c.restore()
    for epoch, batch in enumerate(batches[1:], 2):
        delta = graph.push({"orders": batch})
        c.emit(epoch, delta, lambda rows, epoch=epoch: sink.write(f"e{epoch}", rows))
    return sink.read()


def _order_log(spark: SparkSession, sf_dir: str) -> tuple[changelog.ChangeLog, DataFrame]:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    log = changelog.ChangeLog(spark, _room(spark).root)
    change = lambda df, op, at: df.withColumns({"_sync_op": F.lit(op), "_sync_order": F.lit(at).cast("long")})
    log.append(1, change(o, 0, 1))
    log.append(1, change(o.limit(3), 1, 9))
    log.append(2, change(o.where("o_orderkey % 5 = 0").withColumn("o_custkey", -F.col("o_custkey")), 0, 2))
    log.append(3, change(o.where("o_orderkey % 7 = 0"), 1, 3))
    return log, o


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log read from its start and applied; a commit that is sent again changes nothing."""
    log, o = _order_log(spark, sf_dir)
    return changelog.apply_changes(o.limit(0), log.read().drop("commit_seq"), ["o_orderkey"])


def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that nobody may read any more go; the rest are read on from where a consumer stands."""
    log, _ = _order_log(spark, sf_dir)
    log.drop_before(changelog.retention_floor(3, {"view": 2}, {"reader": 3}))
    return log.read(after=1).select("o_orderkey", "_sync_op", "commit_seq")


def versions_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row versions less those that no read from commit 2 on sees, read at commit 3."""
    log, _ = _order_log(spark, sf_dir)
    held = changelog.row_versions(log.read(), ["o_orderkey"])
    gone = changelog.collectable(held, 2).select("o_orderkey", "valid_from")
    return changelog.as_of(held.join(gone, ["o_orderkey", "valid_from"], "left_anti"), 3)


def transaction_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("server"), F.col("user_id").cast("string").alias("gtid"), "event_id")
    return changelog.unapplied(e, e.where("event_id % 3 = 0"))


def logical_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text feed of inserts, updates and deletes, typed and applied to a mirror."""
    n = _table(spark, sf_dir, "nation")
    quoted = F.replace("n_name", F.lit("'"), F.lit("''"))
    line = lambda op, name: F.concat(F.lit(f"table public.nation: {op}: n_nationkey[integer]:"), F.col("n_nationkey").cast("string"), F.lit(" n_name[text]:'"), name, F.lit("' n_regionkey[integer]:"), F.col("n_regionkey").cast("string"))
    feed = n.select(line("INSERT", quoted).alias("value"), F.col("n_nationkey").alias("at"))
    feed = feed.unionAll(n.where("n_nationkey % 4 = 0").select(line("UPDATE", F.concat(quoted, F.lit("''s"))), F.col("n_nationkey") + 100))
    feed = feed.unionAll(n.where("n_nationkey % 7 = 0").select(F.concat(F.lit("table public.nation: DELETE: n_nationkey[integer]:"), F.col("n_nationkey").cast("string")), F.col("n_nationkey") + 200))
    feed = feed.unionAll(spark.createDataFrame([("COMMIT 5", 300), ("table public.other: INSERT: x[int]:1", 301)], "value string, at int"))
    mirror = changelog.KeyedMirror(["n_nationkey"], spark)
    mirror.apply(changelog.decoded_changes(feed, "public.nation", "n_nationkey int, n_name string, n_regionkey int", "at"))
    return mirror.snapshot()


def snapshot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as tab-separated text with escapes and nulls, and read back."""
    n = _table(spark, sf_dir, "nation")
    odd = F.when(F.col("n_nationkey") % 3 == 0, F.lit("\\N")).when(F.col("n_nationkey") % 3 == 1, F.concat("n_name", F.lit("\\\\t\\tx"))).otherwise(F.col("n_name"))
    lines = n.select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), odd, F.col("n_regionkey").cast("string")).alias("value"))
    return changelog.snapshot_rows(lines, "n_nationkey int, n_name string, n_regionkey int")


def append_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey")
    sink = cn.AppendSink(spark, _room(spark).root)
    for k in (0, 1, 1, 2, 0):
        sink.write(f"d{k}", o.where(f"o_orderkey % 3 = {k}"))
    return sink.read().select("o_orderkey")


def file_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through every file format of the registry."""
    registry, room, n = cn.default_registry(), _room(spark), _table(spark, sf_dir, "nation")
    out = []
    for f in ("parquet", "csv", "json", "orc"):
        n.write.format(f).save(room.path(f))
        read = registry.open(f, "source", spark, path=room.path(f), schema=n.schema)
        out.append(read.select(F.lit(f).alias("format"), *n.columns))
    return functools.reduce(DataFrame.unionAll, out)


def schema_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    wider = spark.createDataFrame([], "n_nationkey bigint, n_name string, n_regionkey int, n_comment string").schema
    return cn.propagate(n, wider)


def pinned_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version that is pinned outlives later pushes and the collection of garbage."""
    orders = _table(spark, sf_dir, "orders")
    graph, batches = _counts(spark, orders), _thirds(orders, "o_orderkey")
    graph.push({"orders": batches[0]})
    graph.store.pin("reader")
    graph.push({"orders": batches[1]})
    graph.push({"orders": batches[2]})
    graph.store.collect_garbage()
    return z.expand(graph.snapshot(1))


def frozen_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result at the second of three versions."""
    orders = _table(spark, sf_dir, "orders")
    graph = _counts(spark, orders)
    for batch in _thirds(orders, "o_orderkey"):
        graph.push({"orders": batch})
    return z.expand(graph.snapshot(2))


def state_outlives_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, room = _table(spark, sf_dir, "orders"), _room(spark)
    plan = compile_sql(spark, COUNTS, {"orders": orders})
    for batch in _thirds(orders, "o_orderkey"):
        StreamGraph(plan, spark, room.path("state")).push({"orders": batch})
    return StreamGraph(plan, spark, room.path("state")).result()


def job_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    job = Job.from_sql("counts", spark, COUNTS, {"orders": orders})
    for batch in _thirds(orders, "o_orderkey"):
        job.push({"orders": batch})
    said = scraped([job])
    return job.snapshot().withColumns({"batches": F.lit(job.batches), "rows_in": F.lit(job.rows_in), "scraped": F.lit(f'weirflow_rows_total{{job="counts"}} {job.rows_in}' in said)})


def shadow_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that is held against a recomputation before it is handed out."""
    orders = _table(spark, sf_dir, "orders")
    graph = _counts(spark, orders)
    for batch in _thirds(orders, "o_orderkey"):
        graph.push({"orders": batch})
    orders.where("o_orderkey % 7 <> 0").createOrReplaceTempView("wf_left_orders")
    verify(graph, spark.sql(COUNTS.replace("FROM orders", "FROM wf_left_orders")))
    return graph.result()


def online_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another plan takes over from the one in force, and its change turns the old result into the new one."""
    orders = _table(spark, sf_dir, "orders")
    old, batches = _counts(spark, orders), _thirds(orders, "o_orderkey")
    old.push({"orders": batches[0]})
    plan = compile_sql(spark, COUNTS.replace("COUNT(*)", "COUNT(*) * 10"), {"orders": orders})
    made = Rebuild(old, plan, {"orders": batches[0]}, spark, at=1)
    for i, batch in enumerate(batches[1:], 2):
        old.push({"orders": batch})
        made.catch_up(i, {"orders": batch})
    _, change = made.swap(3)
    return z.expand(z.consolidate(z.add([old.output(), change])))


def shared_subview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that reads some columns of another one's result has no state of its own."""
    orders = _table(spark, sf_dir, "orders")
    c = Catalog(spark, {"orders": orders})
    c.execute("CREATE SINK all_of_it KEY (k) AS SELECT o_custkey AS k, COUNT(*) AS n, MAX(o_orderkey) AS m FROM orders GROUP BY o_custkey")
    c.execute("CREATE SINK part KEY (k) AS SELECT o_custkey AS k, COUNT(*) AS n, MAX(o_orderkey) AS m FROM orders GROUP BY o_custkey")
    c.publish()
    for i, batch in enumerate(_thirds(orders, "o_orderkey")):
        c.push({"orders": batch}, f"d{i}")
    return c.sinks["part"].read().withColumn("states", F.lit(len({id(g) for g in c.graphs.values()})))


def _ttl(kind: str, **lengths: int) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "unix_millis(cast(ts as timestamp)) AS t")
        node = p.TimeWindow("w", "e", kind, "t", keys=("event_type",), aggregates=(p.Agg("n", "count"), p.Agg("hi", "max", "event_id")), ttl=TTL, **lengths)
        graph = StreamGraph(p.Plan((p.Input("e", "events"), node), "w"), spark)
        cut = e.agg(F.percentile("t", 0.5).cast("long")).first()[0]
        graph.push({"events": e.where(F.col("t") <= cut)})
        graph.push({"events": e.where(F.col("t") > cut)})
        bound = e.agg(F.max("t")).first()[0] - TTL
        states = [graph.store.read(n) for n in graph.store.manifest["paths"] if n.startswith("w.")]
        given_up = sum(df.where(F.col("w_end") <= bound).count() for df in states if "w_end" in df.columns)
        return graph.result().withColumn("bounded", F.lit(given_up == 0))

    return run


HOUR = 3_600_000
TTL = 5 * 24 * HOUR
_E = "(SELECT event_id, event_type, epoch_us(ts) // 1000 AS t FROM events)"


def sql_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows dropped by a predicate of the query itself."""
    e = _table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "unix_millis(cast(ts as timestamp)) AS t")
    plan = compile_sql(spark, f"SELECT event_type, COUNT(*) AS n FROM e WHERE watermark(t, {HOUR}, 'drop') AND event_id > 0 GROUP BY event_type", {"e": e})
    graph = StreamGraph(plan, spark)
    graph.push({"e": e.where("event_id % 2 = 0")})
    graph.push({"e": e.where("event_id % 2 = 1")})
    return graph.result()


def timed_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query whose result depends on when it runs, recomputed with each push."""
    orders = _table(spark, sf_dir, "orders")
    sql = "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderdate < current_timestamp() GROUP BY o_orderstatus"
    graph = StreamGraph(compile_sql(spark, sql, {"orders": orders}, nondeterministic="timed_recompute"), spark)
    for batch in _thirds(orders, "o_orderkey"):
        graph.push({"orders": batch})
    return graph.result()


def json_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", text.format_json(F.col("props")).alias("j"), text.truncate_json(F.col("props"), 3).isNull().alias("cut"))


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the front end, the plans, the functions and the connectors do not take."""
    orders = _table(spark, sf_dir, "orders")
    registry = UdfRegistry(spark)

    def no(run: Callable) -> bool:
        try:
            run()
        except (p.PlanError, UdfError, ValueError, LookupError):
            return True
        return False

    sql = lambda text, **o: lambda: compile_sql(spark, text, {"orders": orders}, **o)
    graph = _counts(spark, orders)
    graph.push({"orders": orders.where("o_orderkey % 3 = 0")})
    cases = {
        "two outputs of one name": sql("SELECT o_orderkey AS a, o_custkey AS a FROM orders"),
        "an offset": sql("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 2"),
        "a limit without an order": sql("SELECT o_orderkey FROM orders LIMIT 5"),
        "a random number": sql("SELECT o_orderkey, rand() AS r FROM orders"),
        "a command": sql("DROP TABLE orders"),
        "no source": sql("SELECT 1 AS x"),
        "an unknown table": sql("SELECT a FROM nowhere"),
        "a function that imports": lambda: registry.register("wf_bad", "scalar", "import os\ndef call(x):\n    return 1", "int"),
        "another language": lambda: registry.register("wf_w", "scalar", "", "int", language="wasm"),
        "an unknown connector": lambda: cn.default_registry().open("pigeon", "sink", spark),
        "an input of another plan": lambda: graph.push({"customer": orders}),
        "a window without a length": lambda: p.Plan((p.Input("i", "e"), p.TimeWindow("w", "i", "tumble", "t")), "w").validate(),
        "a plain count": sql("SELECT COUNT(*) AS n FROM orders"),
    }
    return spark.createDataFrame([(k, no(run)) for k, run in cases.items()], "what string, refused boolean")


def taken_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A push that takes away what is not there fails and leaves the state as it was."""
    orders = _table(spark, sf_dir, "orders")
    graph, batches = _counts(spark, orders), _thirds(orders, "o_orderkey")
    graph.push({"orders": batches[0]})
    failed = False
    try:
        graph.push({"orders": z.weighted(orders.select(*[F.lit(-5).cast(f.dataType).alias(f.name) if f.name == "o_custkey" else f.name for f in orders.schema]), -1)})
    except Exception:  # noqa: BLE001 - raised by a task
        failed = True
    graph.push({"orders": batches[1]})
    graph.push({"orders": batches[2]})
    return graph.result().withColumn("failed", F.lit(failed))


def plan_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as data: text and back, one identity for one query, and the node kinds that explain names."""
    o = {"orders": _table(spark, sf_dir, "orders")}
    a, b, c = (compile_sql(spark, s, o) for s in (COUNTS, COUNTS.replace("  ", " "), COUNTS.replace("COUNT(*)", "MAX(o_orderkey)")))
    facts = {
        "round trip": p.Plan.from_json(a.to_json()) == a,
        "same query, same identity": a.semantic_id() == b.semantic_id(),
        "another query, another identity": a.semantic_id() != c.semantic_id(),
        "explained": all(type(n).__name__ in a.explain() for n in a.nodes),
        "shared in whole": reuse(a, b).kind == "exact",
        "not shared": reuse(a, c) is None,
    }
    return spark.createDataFrame(list(facts.items()), "fact string, holds boolean")


def planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs that none beats, what is admitted and what waits, and rows to take at once by rate."""
    costs = {"a": Cost(1, 5), "b": Cost(5, 1), "c": Cost(5, 5), "d": Cost(1, 5, 1)}
    line = Admission(max_jobs=2)
    started = [n for n in "xyz" if line.request(n)]
    after = line.release("x")
    rows = [("pareto", ",".join(pareto(costs))), ("started", ",".join(started)), ("after", ",".join(after))]
    rows += [(f"limit {r}", str(batch_limit(r, 10, 20, 100, 300))) for r in (5, 15, 30)]
    return spark.createDataFrame(rows, "what string, value string")


def explained_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A push with its plan, times and rows, and the events of a trace."""
    orders = _table(spark, sf_dir, "orders")
    said, trace = explain_analyze(_counts(spark, orders), {"orders": orders}), Trace(2)
    for stage in ("read", "apply", "commit"):
        trace.mark(stage)
    facts = {"rows in": f"in {{'orders': {orders.count()}}}" in said, "state": "state={" in said, "ring": [e["stage"] for e in trace.events] == ["apply", "commit"]}
    return spark.createDataFrame(list(facts.items()), "fact string, holds boolean")


def udf_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = UdfRegistry(spark)
    one = registry.register("wf_one", "scalar", "def call(x):\n    return x + 1", "long")
    two = registry.register("wf_two", "scalar", "def call(x):\n    return x + 2", "long")
    e = _table(spark, sf_dir, "events").selectExpr("event_id", "wf_one(user_id) AS a", "wf_two(user_id) AS b")
    return e.withColumn("apart", F.lit(one.identity() != two.identity() and len(registry.identities()) == 2))


def stable_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON, dealt by key, for a writer that must see each key in one place."""
    n = _table(spark, sf_dir, "nation")
    dealt = n.repartition(4, "n_regionkey").select("n_regionkey", F.spark_partition_id().alias("at"), F.to_json(F.struct("n_nationkey", "n_name")).alias("row"))
    places = dealt.groupBy("n_regionkey").agg(F.countDistinct("at").alias("places"))
    return dealt.drop("at").join(places, "n_regionkey")


def _facts(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS fact, true AS holds" for n in names)


REFUSED = ("two outputs of one name", "an offset", "a limit without an order", "a random number", "a command", "no source", "an unknown table", "a function that imports", "another language", "an unknown connector", "an input of another plan", "a window without a length")
_LOGGED = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 7 <> 0"

APIS: dict[str, tuple[Callable, str]] = {
    "late_view": (late_view, "SELECT o_custkey AS k, COUNT(*) AS n, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey > 0 GROUP BY o_custkey"),
    "savepoint_replay": (savepoint_replay, COUNTS_LEFT),
    "barrier_restore": (barrier_restore, COUNTS_LEFT),
    "change_log": (change_log, _LOGGED),
    "log_retention": (log_retention, "SELECT o_orderkey, 0 AS _sync_op, CAST(2 AS BIGINT) AS commit_seq FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 1, 3 FROM orders WHERE o_orderkey % 7 = 0"),
    "versions_collected": (versions_collected, _LOGGED),
    "transaction_dedupe": (transaction_dedupe, "SELECT event_type AS server, CAST(user_id AS VARCHAR) AS gtid, event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = e.event_type AND x.user_id = e.user_id AND x.event_id % 3 = 0)"),
    "logical_decoding": (logical_decoding, "SELECT n_nationkey, n_name || CASE WHEN n_nationkey % 4 = 0 THEN '''s' ELSE '' END AS n_name, n_regionkey FROM nation WHERE n_nationkey % 7 <> 0"),
    "snapshot_text": (snapshot_text, "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN n_name || chr(92) || 't' || chr(9) || 'x' ELSE n_name END AS n_name, n_regionkey FROM nation"),
    "append_sink": (append_sink, "SELECT o_orderkey FROM orders"),
    "file_connectors": (file_connectors, "SELECT f AS format, nation.* FROM nation, (SELECT unnest(['parquet', 'csv', 'json', 'orc']) AS f)"),
    "schema_propagation": (schema_propagation, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey, CAST(NULL AS VARCHAR) AS n_comment FROM nation"),
    "pinned_version": (pinned_version, "SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey"),
    "frozen_cut": (frozen_cut, COUNTS),
    "state_outlives_session": (state_outlives_session, COUNTS_LEFT),
    "job_runner": (job_runner, f"SELECT *, 3 AS batches, CAST((SELECT COUNT(*) + COUNT(*) FILTER (WHERE o_orderkey % 7 = 0) FROM orders) AS INT) AS rows_in, true AS scraped FROM ({COUNTS_LEFT})"),
    "shadow_verified": (shadow_verified, COUNTS_LEFT),
    "online_rebuild": (online_rebuild, COUNTS_LEFT.replace("COUNT(*)", "COUNT(*) * 10")),
    "shared_subview": (shared_subview, "SELECT o_custkey AS k, COUNT(*) AS n, MAX(o_orderkey) AS m, 1 AS states FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey"),
    "window_ttl": (_ttl("tumble", size=HOUR), f"SELECT event_type, t - t % {HOUR} AS w_start, t - t % {HOUR} + {HOUR} AS w_end, COUNT(*) AS n, MAX(event_id) AS hi, true AS bounded FROM {_E} WHERE t - t % {HOUR} + {HOUR} > (SELECT MAX(t) FROM {_E}) - {TTL} GROUP BY ALL"),
    "session_ttl": (_ttl("session", gap=HOUR // 2), f"SELECT event_type, MIN(t) AS w_start, MAX(t) AS w_end, COUNT(*) AS n, MAX(event_id) AS hi, true AS bounded FROM (SELECT *, SUM(o) OVER (PARTITION BY event_type ORDER BY t, event_id) AS s FROM (SELECT *, CASE WHEN t - LAG(t) OVER (PARTITION BY event_type ORDER BY t, event_id) > {HOUR // 2} THEN 1 ELSE 0 END AS o FROM {_E})) GROUP BY event_type, s HAVING MAX(t) > (SELECT MAX(t) FROM {_E}) - {TTL}"),
    "sql_watermark": (sql_watermark, f"WITH e AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS t FROM events) SELECT event_type, COUNT(*) AS n FROM e WHERE event_id > 0 AND t >= CASE WHEN event_id % 2 = 0 THEN (SELECT MAX(t) FROM e WHERE event_id % 2 = 0) ELSE (SELECT MAX(t) FROM e) END - {HOUR} GROUP BY event_type"),
    "timed_recompute": (timed_recompute, "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_orderstatus"),
    "json_helpers": (json_helpers, "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS j, true AS cut FROM events"),
    "refused": (refused, " UNION ALL ".join(f"SELECT '{n}' AS what, true AS refused" for n in REFUSED) + " UNION ALL SELECT 'a plain count', false"),
    "taken_away": (taken_away, f"SELECT *, true AS failed FROM ({COUNTS_LEFT})"),
    "plan_identity": (plan_identity, _facts("round trip", "same query, same identity", "another query, another identity", "explained", "shared in whole", "not shared")),
    "planning": (planning, "SELECT * FROM (VALUES ('pareto', 'a,b'), ('started', 'x,y'), ('after', 'z'), ('limit 5', '100'), ('limit 15', '200'), ('limit 30', '300')) t(what, value)"),
    "explained_push": (explained_push, _facts("rows in", "state", "ring")),
    "udf_identity": (udf_identity, "SELECT event_id, user_id + 1 AS a, user_id + 2 AS b, true AS apart FROM events"),
    "stable_partition": (stable_partition, "SELECT n_regionkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS \"row\", CAST(1 AS BIGINT) AS places FROM nation"),
}
