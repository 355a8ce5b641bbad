"""Maintained results against recomputation, over random changes and at the edges."""

import random

import pytest
from pyspark.sql import functions as F

from weirflow.operators import zset as z
from weirflow.plans import nodes as p
from weirflow.plans.frontend import compile_sql
from weirflow.plans.graph import StreamGraph
from weirflow.streaming.runner import verify

ORDERS = "id int, status string, amount bigint, cust int"
CUSTOMERS = "id int, name string, city string"
SHAPES = {
    "filter": "SELECT id, amount * 2 AS d FROM orders WHERE amount > 2 OR status = 'open'",
    "group": "SELECT status, COUNT(*) AS n, SUM(amount) AS s, AVG(amount) AS a, STDDEV_SAMP(amount) AS sd FROM orders GROUP BY status",
    "values": "SELECT status, MIN(amount) AS lo, MAX(amount) AS hi, COUNT(DISTINCT amount) AS d FROM orders GROUP BY status",
    "global": "SELECT COUNT(*) AS n, SUM(amount) AS s, MAX(amount) AS m FROM orders",
    "left": "SELECT o.id, c.name FROM orders o LEFT JOIN customers c ON o.cust = c.id",
    "full": "SELECT o.id, c.id AS cid FROM orders o FULL JOIN customers c ON o.cust = c.id AND o.amount > 3",
    "semi": "SELECT c.id FROM customers c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.cust = c.id AND o.status = 'open')",
    "anti": "SELECT c.id FROM customers c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.cust = c.id)",
    "window": "SELECT id, SUM(amount) OVER (PARTITION BY cust ORDER BY id) AS s FROM orders",
    "topn": "SELECT id, amount FROM orders ORDER BY amount DESC NULLS LAST, id LIMIT 3",
    "union": "SELECT cust AS k FROM orders UNION SELECT id FROM customers",
    "intersect": "SELECT cust AS k FROM orders INTERSECT SELECT id FROM customers",
    "scalar": "SELECT id FROM orders WHERE amount > (SELECT AVG(amount) FROM orders)",
    "rollup": "SELECT status, cust, COUNT(*) AS n FROM orders GROUP BY ROLLUP (status, cust)",
}


def random_order(rng, i):
    return (i, rng.choice(["open", "closed", "hold"]), None if rng.random() < 0.2 else rng.randrange(9), None if rng.random() < 0.2 else rng.randrange(1, 6))


def random_customer(rng, i):
    return (i, f"c{rng.randrange(3)}", None if rng.random() < 0.2 else rng.choice("AB"))


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_random_changes(spark, shape):
    rng = random.Random(shape)
    tables = {"orders": (ORDERS, random_order, {}), "customers": (CUSTOMERS, random_customer, {})}
    schemas = {k: spark.createDataFrame([], s).schema for k, (s, _, _) in tables.items()}
    plan = compile_sql(spark, SHAPES[shape], schemas)
    graph = StreamGraph(plan, spark)
    for _ in range(4):
        deltas = {}
        for name, (schema, make, rows) in tables.items():
            if name not in plan.inputs():
                continue
            changes = []
            for i in rng.sample(range(1, 12), 5):
                old = rows.pop(i, None)
                if old is not None:
                    changes.append((*old, -1))
                if old is None or rng.random() < 0.6:
                    rows[i] = make(rng, i)
                    changes.append((*rows[i], 1))
            deltas[name] = spark.createDataFrame(changes, f"{schema}, {z.WEIGHT} bigint")
        graph.push(deltas)
    for name, (schema, _, rows) in tables.items():
        spark.createDataFrame(list(rows.values()), schema).createOrReplaceTempView(name)
    assert sorted(map(str, graph.result().collect())) == sorted(map(str, spark.sql(SHAPES[shape]).collect()))


def orders(spark, *rows):
    return spark.createDataFrame(list(rows), f"{ORDERS}, {z.WEIGHT} bigint")


def test_taking_away_what_is_not_there_changes_nothing(spark):
    for sql in ("SELECT status, COUNT(*) AS n FROM orders GROUP BY status", "SELECT id FROM orders", "SELECT DISTINCT status FROM orders"):
        graph = StreamGraph(compile_sql(spark, sql, {"orders": spark.createDataFrame([], ORDERS).schema}), spark)
        graph.push({"orders": orders(spark, (1, "open", 5, 1, 1))})
        with pytest.raises(Exception, match="not there"):
            graph.push({"orders": orders(spark, (2, "hold", 5, 1, -1))})
        assert graph.version == 1 and graph.result().count() == 1
        graph.push({"orders": orders(spark, (1, "open", 5, 1, -1))})
        assert graph.result().count() == 0


def test_global_aggregate_of_nothing_is_one_row(spark):
    graph = StreamGraph(compile_sql(spark, "SELECT COUNT(*) AS n, SUM(amount) AS s FROM orders", {"orders": spark.createDataFrame([], ORDERS).schema}), spark)
    assert [tuple(r) for r in graph.result().collect()] == [(0, None)]
    graph.push({"orders": orders(spark, (1, "open", 5, 1, 1))})
    graph.push({"orders": orders(spark, (1, "open", 5, 1, -1))})
    assert [tuple(r) for r in graph.result().collect()] == [(0, None)]


def test_state_outlives_the_graph_and_knows_its_plan(spark, tmp_path):
    schema = {"orders": spark.createDataFrame([], ORDERS).schema}
    plan = compile_sql(spark, "SELECT status, COUNT(*) AS n FROM orders GROUP BY status", schema)
    StreamGraph(plan, spark, str(tmp_path / "s")).push({"orders": orders(spark, (1, "open", 5, 1, 1))})
    again = StreamGraph(plan, spark, str(tmp_path / "s"))
    again.push({"orders": orders(spark, (2, "open", 5, 1, 1))})
    assert [tuple(r) for r in again.result().collect()] == [("open", 2)]
    other = compile_sql(spark, "SELECT status FROM orders", schema)
    with pytest.raises(RuntimeError, match="another plan"):
        StreamGraph(other, spark, str(tmp_path / "s"))


def test_many_pushes_fold_parts_and_garbage_goes(spark):
    schema = {"orders": spark.createDataFrame([], ORDERS).schema}
    graph = StreamGraph(compile_sql(spark, "SELECT status, MAX(amount) AS m FROM orders GROUP BY status", schema), spark)
    for i in range(11):
        graph.push({"orders": orders(spark, (i, "open", i, 1, 1))})
    assert [tuple(r) for r in graph.result().collect()] == [("open", 10)]
    assert all(len(x) <= 9 for x in graph.store.manifest["paths"].values())
    graph.store.pin("reader", 5)
    assert graph.store.floor() == 5
    before = [tuple(r) for r in graph.snapshot(5).collect()]
    graph.store.collect_garbage()
    assert [tuple(r) for r in graph.snapshot(5).collect()] == before == [("open", 4, 1)]
    graph.store.unpin("reader")
    graph.store.collect_garbage()
    assert [tuple(r) for r in graph.result().collect()] == [("open", 10)]


def test_savepoints(spark):
    schema = {"orders": spark.createDataFrame([], ORDERS).schema}
    graph = StreamGraph(compile_sql(spark, "SELECT id FROM orders", schema), spark)
    graph.push({"orders": orders(spark, (1, "a", 1, 1, 1))})
    graph.store.savepoint("one")
    graph.push({"orders": orders(spark, (2, "a", 1, 1, 1))})
    graph.store.restore("one")
    assert [r[0] for r in graph.result().collect()] == [1]


def test_late_rows(spark):
    rows = lambda *xs: spark.createDataFrame([(i, t, 1) for i, t in xs], f"id int, ts bigint, {z.WEIGHT} bigint")
    for policy, want in (("drop", [2, 4]), ("side", [2, 3, 4]), ("recompute", [2, 3, 4])):
        graph = StreamGraph(p.Plan((p.Input("i", "e"), p.Watermark("w", "i", "ts", 5, policy)), "w"), spark)
        graph.push({"e": rows((2, 20))})
        graph.push({"e": rows((3, 10), (4, 22))})
        assert sorted(r["id"] for r in graph.result().collect()) == want


def test_windows_expire(spark):
    rows = lambda *xs: spark.createDataFrame([(t, 1) for t in xs], f"ts bigint, {z.WEIGHT} bigint")
    node = p.TimeWindow("w", "i", "tumble", "ts", size=10, ttl=10, aggregates=(p.Agg("n", "count"),))
    graph = StreamGraph(p.Plan((p.Input("i", "e"), node), "w"), spark)
    graph.push({"e": rows(1, 2, 11)})
    assert sorted(tuple(r) for r in graph.result().collect()) == [(0, 10, 2), (10, 20, 1)]
    graph.push({"e": rows(35)})
    assert sorted(tuple(r) for r in graph.result().collect()) == [(30, 40, 1)]


def test_session_bounds(spark):
    rows = spark.createDataFrame([(3,), (8,), (20,)], "ts bigint")
    node = p.TimeWindow("w", "i", "session", "ts", gap=5, aggregates=(p.Agg("n", "count"),))
    graph = StreamGraph(p.Plan((p.Input("i", "e"), node), "w"), spark)
    graph.push({"e": rows})
    assert sorted(tuple(r) for r in graph.result().collect()) == [(3, 8, 2), (20, 20, 1)]


def test_verify(spark):
    schema = {"orders": spark.createDataFrame([], ORDERS).schema}
    graph = StreamGraph(compile_sql(spark, "SELECT id FROM orders", schema), spark)
    graph.push({"orders": orders(spark, (1, "a", 1, 1, 1))})
    verify(graph, spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(z.IntegrityError):
        verify(graph, spark.createDataFrame([(2,)], "id int"))


def test_consolidate_and_expand(spark):
    df = spark.createDataFrame([("a", 2), ("a", -1), ("b", 1), ("b", -1), (None, 3)], f"k string, {z.WEIGHT} bigint")
    assert sorted(map(str, z.expand(z.consolidate(df)).select(F.coalesce("k", F.lit("-"))).collect())) == sorted(map(str, spark.createDataFrame([("a",), ("-",), ("-",), ("-",)], "`coalesce(k, -)` string").collect()))


# -- floating point, expiry, replays ---------------------------------------------


def maintained(spark, sql, schema, batches):
    graph = StreamGraph(compile_sql(spark, sql, {"t": spark.createDataFrame([], schema).schema}), spark)
    for rows in batches:
        graph.push({"t": spark.createDataFrame(rows, f"{schema}, {z.WEIGHT} bigint")})
    return graph


def test_floating_point_sums_after_retraction(spark):
    sql = "SELECT k, SUM(v) AS s, AVG(v) AS a, STDDEV_SAMP(v) AS sd, MIN(v) AS lo, COUNT(DISTINCT v) AS d FROM t GROUP BY k"
    inf, nan = float("inf"), float("nan")
    batches = [
        [("a", 0.1, 1), ("a", 1e17, 1), ("b", 1.0, 1), ("b", inf, 1), ("c", nan, 1), ("c", 2.0, 1), ("d", 5.0, 1)],
        [("a", 1e17, -1), ("b", inf, -1), ("c", nan, -1), ("d", 5.0, -1)],
        [("a", 0.3, 1), ("e", None, 1), ("b", 1.0, 1)],
    ]
    got = {r["k"]: tuple(r)[1:] for r in maintained(spark, sql, "k string, v double", batches).result().collect()}
    assert got["a"] == (pytest.approx(0.4), pytest.approx(0.2), pytest.approx(0.1414213562), 0.1, 2)
    assert got["b"] == (2.0, 1.0, 0.0, 1.0, 1) and got["c"] == (2.0, 2.0, None, 2.0, 1) and got["e"] == (None, None, None, None, 0)
    assert set(got) == {"a", "b", "c", "e"}
    total = maintained(spark, "SELECT SUM(v) AS s, COUNT(*) AS n FROM t", "k string, v double", batches)
    assert [tuple(r) for r in total.result().collect()] == [(pytest.approx(4.4), 6)]


def test_random_floats(spark):
    """Every result row of before is taken away as it was shown."""
    rng, live, batches = random.Random(3), [], []
    for _ in range(5):
        rows = [(rng.choice("xyz"), rng.choice([0.1, 0.2, 0.7, 1e15, rng.random()]), 1) for _ in range(12)]
        gone = [live.pop(rng.randrange(len(live))) for _ in range(5)] if live else []
        live += rows
        batches.append(rows + [(k, v, -1) for k, v, _ in gone])
    sql = "SELECT k, SUM(v) AS s, AVG(v) AS a, COUNT(*) AS n FROM t GROUP BY k"
    got = {r["k"]: r for r in maintained(spark, sql, "k string, v double", batches).result().collect()}
    for k in "xyz":
        own = [v for g, v, _ in live if g == k]
        assert got[k]["s"] == pytest.approx(sum(own)) and got[k]["a"] == pytest.approx(sum(own) / len(own)) and got[k]["n"] == len(own)
    assert set(got) == {k for k, _, _ in live}


def test_exact_spread_of_whole_numbers(spark):
    rows = [("a", 2_000_000_000 + i, 1) for i in range(4)]
    got = maintained(spark, "SELECT STDDEV_SAMP(v) AS sd, AVG(v) AS a FROM t", "k string, v int", [rows, [("a", 7, 1)], [("a", 7, -1)]]).result().first()
    assert got["sd"] == pytest.approx(1.2909944487) and got["a"] == 2_000_000_001.5


@pytest.mark.parametrize("kind", ["tumble", "session"])
@pytest.mark.parametrize("function", ["count", "max", "string_agg"])
def test_expired_windows_leave_the_state(spark, kind, function):
    lengths = {"size": 10} if kind == "tumble" else {"gap": 5}
    agg = p.Agg("x", function, None if function == "count" else "v", order=(p.Order("v"),) if function == "string_agg" else ())
    graph = StreamGraph(p.Plan((p.Input("i", "e"), p.TimeWindow("w", "i", kind, "ts", ttl=20, aggregates=(agg,), **lengths)), "w"), spark)
    for t in range(0, 400, 40):
        graph.push({"e": spark.createDataFrame([(t, 1, 1), (t + 1, 2, 1)], f"ts bigint, v bigint, {z.WEIGHT} bigint")})
    graph.push({"e": spark.createDataFrame([(3, 9, 1)], f"ts bigint, v bigint, {z.WEIGHT} bigint")})
    (row,) = graph.result().collect()
    assert row["x"] == {"count": 2, "max": 2, "string_agg": "1,2"}[function] and row["w_start"] == 360
    for name in graph.store.manifest["paths"]:
        if name.startswith("w."):
            assert graph.store.read(name).count() <= 3, name


def test_two_writers_of_a_version(spark, tmp_path):
    schema = {"orders": spark.createDataFrame([], ORDERS).schema}
    plan = compile_sql(spark, "SELECT status, COUNT(*) AS n FROM orders GROUP BY status", schema)
    one, two = StreamGraph(plan, spark, str(tmp_path)), StreamGraph(plan, spark, str(tmp_path))
    one.push({"orders": orders(spark, (1, "open", 5, 1, 1))})
    with pytest.raises(RuntimeError, match="another writer"):
        two.push({"orders": orders(spark, (2, "hold", 5, 1, 1))})
    assert [tuple(r) for r in StreamGraph(plan, spark, str(tmp_path)).result().collect()] == [("open", 1)]


def test_a_crash_between_any_two_file_operations(spark, tmp_path, monkeypatch):
    """Whatever is cut off, the folder opens with the state of before or after, savepoints and pins included."""
    from weirflow.sources.folders import Folder

    schema = {"orders": spark.createDataFrame([], ORDERS).schema}
    plan = compile_sql(spark, "SELECT id FROM orders", schema)
    graph = StreamGraph(plan, spark, str(tmp_path))
    graph.push({"orders": orders(spark, (1, "a", 1, 1, 1))})
    graph.store.savepoint("one")
    steps = [lambda g: g.push({"orders": orders(spark, (2, "a", 1, 1, 1))}), lambda g: g.store.savepoint("two"), lambda g: g.store.pin("p")]
    for step in steps:
        for broken in ("write_new", "rename"):
            with monkeypatch.context() as m:
                m.setattr(Folder, broken, lambda *a: (_ for _ in ()).throw(OSError("cut off")))
                with pytest.raises(OSError):
                    step(StreamGraph(plan, spark, str(tmp_path)))
            again = StreamGraph(plan, spark, str(tmp_path))
            assert [r[0] for r in again.result().collect()] == [1] and "one" in again.store.manifest["savepoints"]
    again.store.restore("one")
    assert [r[0] for r in again.result().collect()] == [1]


@pytest.mark.parametrize("shape", ["values", "left", "intersect"])
def test_bucketed_state_gives_the_same(spark, shape, monkeypatch):
    """Every fold is laid out in buckets, and pushes read the touched ones."""
    from weirflow.plans.state import Version

    monkeypatch.setattr(Version, "BUCKET_BYTES", 0)
    monkeypatch.setattr(Version, "MOST_PARTS", 1)
    monkeypatch.setattr(Version, "BUCKETS", 4)
    test_random_changes(spark, shape)


def test_a_small_push_reads_only_its_buckets(spark, monkeypatch):
    from weirflow.plans.state import StateStore, Version

    monkeypatch.setattr(Version, "BUCKET_BYTES", 0)
    monkeypatch.setattr(Version, "MOST_PARTS", 1)
    schema = {"t": spark.createDataFrame([], "k bigint, v bigint").schema}
    graph = StreamGraph(compile_sql(spark, "SELECT k, MAX(v) AS m, COUNT(*) AS n FROM t GROUP BY k", schema), spark)
    many = spark.range(2000).selectExpr("id AS k", "id AS v")
    for _ in range(3):
        graph.push({"t": many})
    assert graph.store.manifest["bucketed"]
    seen, real = {}, StateStore.read

    def read(self, name, version=None, touched=None, keys=None):
        out = real(self, name, version, touched, keys)
        if touched is not None and out is not None:
            seen[name] = out.count()
        return out

    monkeypatch.setattr(StateStore, "read", read)
    graph.push({"t": spark.createDataFrame([(5, 9000)], "k bigint, v bigint")})
    assert len(seen) >= 2 and max(seen.values()) < 2000 * 4 / 10
    monkeypatch.undo()
    assert [tuple(r) for r in graph.result().where("k = 5").collect()] == [(5, 9000, 4)] and graph.result().count() == 2000


def test_rows_that_only_come_leave_the_table_unread(spark, monkeypatch):
    node = p.TopN("t", "i", (p.Order("v", True),), 2, ("k",))
    graph = StreamGraph(p.Plan((p.Input("i", "e"), node), "t"), spark)
    rows = lambda *xs: spark.createDataFrame(list(xs), f"k string, v bigint, {z.WEIGHT} bigint")
    graph.push({"e": rows(("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("b", 1, 1))})
    real, asked = graph.store.read, []
    monkeypatch.setattr(graph.store, "read", lambda name, *a, **o: (asked.append(name), real(name, *a, **o))[1])
    graph.push({"e": rows(("a", 9, 1), ("a", 0, 1), ("c", 5, 2))})
    assert "t.left" not in asked
    graph.push({"e": rows(("a", 9, -1), ("c", 5, -1))})
    assert sorted(tuple(r) for r in graph.result().collect()) == [("a", 2), ("a", 3), ("b", 1), ("c", 5)]


def test_sums_beside_one_column_of_values(spark):
    """Sums of whole numbers move although no value does, over folds, and a group that empties goes."""
    schema = "id int, k string, v double, c int"
    frame = lambda *rows: spark.createDataFrame(list(rows), f"{schema}, {z.WEIGHT} long")
    sql = "SELECT k, SUM(c) AS s, COUNT(*) AS n, AVG(v) AS a, MAX(v) AS m FROM t GROUP BY k"
    graph = StreamGraph(compile_sql(spark, sql, {"t": spark.createDataFrame([], schema).schema}), spark)
    graph.push({"t": frame((1, "a", 0.5, 0, 1), (2, "a", None, 7, 1), (3, "b", 1.5, 1, 1))})
    for i in range(9):
        gone = [(3, "b", 1.5, 1, -1)] if i == 8 else []
        change = graph.push({"t": frame((1, "a", 0.5, i, -1), (1, "a", 0.5, i + 1, 1), *gone)})
        if i in (0, 7, 8):
            b = [("b", 1, 1, 1.5, 1.5, -1)] if gone else []
            assert sorted(tuple(r) for r in change.collect()) == sorted([("a", 7 + i, 2, 0.5, 0.5, -1), ("a", 8 + i, 2, 0.5, 0.5, 1), *b])
    assert [tuple(r) for r in graph.result().collect()] == [("a", 16, 2, 0.5, 0.5)]


def test_global_sum_notices_what_is_not_there(spark):
    schema = {"orders": spark.createDataFrame([], ORDERS).schema}
    graph = StreamGraph(compile_sql(spark, "SELECT SUM(amount) AS s FROM orders", schema), spark)
    graph.push({"orders": orders(spark, (1, "open", 5, 1, 1))})
    with pytest.raises(Exception, match="takes away a row"):
        graph.push({"orders": orders(spark, (1, "open", 5, 1, -1), (2, "open", 5, 1, -1))})
    assert [tuple(r) for r in graph.result().collect()] == [(5,)]
