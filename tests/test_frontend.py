import pytest

from weirflow.functions.udf import macro
from weirflow.plans import nodes as p
from weirflow.plans.frontend import Unsupported, compile_sql
from weirflow.plans.graph import StreamGraph
from weirflow.plans.sharing import Admission, Cost, pareto, reuse


@pytest.fixture(scope="module")
def tables(spark):
    return {"t": spark.createDataFrame([], "id int, k string, v bigint").schema, "u": spark.createDataFrame([], "id int, w bigint").schema}


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 1 AS x",
        "SELECT id FROM missing",
        "SELECT id FROM t LIMIT 3",
        "SELECT id, id FROM t",
        "SELECT id, rand() AS r FROM t",
        "SELECT id, current_date() AS d FROM t",
        "SELECT t.*, u.* FROM t JOIN u ON t.id = u.id",
        "DROP TABLE t",
        "SELECT id FROM t ORDER BY id LIMIT 3 OFFSET 2",
    ],
)
def test_refused(spark, tables, sql):
    with pytest.raises(p.PlanError):
        compile_sql(spark, sql, tables)


def test_fallbacks(spark, tables):
    sql = "SELECT k, MEDIAN(v) AS m FROM t GROUP BY k"
    with pytest.raises(Unsupported):
        compile_sql(spark, sql, tables)
    assert isinstance(compile_sql(spark, sql, tables, on_unsupported="recompute").nodes[-1], p.Recompute)
    assert compile_sql(spark, "SELECT id, rand() AS r FROM t", tables, nondeterministic="timed_recompute").nodes[-1].timed
    assert isinstance(compile_sql(spark, "SELECT id FROM t", tables, force_recompute=True).nodes[-1], p.Recompute)


def test_one_row_needs_no_order(spark, tables):
    compile_sql(spark, "SELECT COUNT(*) AS n FROM t LIMIT 1", tables)


def test_identity(spark, tables):
    a = compile_sql(spark, "SELECT k, SUM(v) AS s FROM t WHERE v > 1 GROUP BY k", tables)
    b = compile_sql(spark, "SELECT k, SUM(v) AS s FROM t WHERE v > 1 GROUP BY k", tables)
    c = compile_sql(spark, "SELECT k, SUM(v) AS s FROM t WHERE v > 2 GROUP BY k", tables)
    assert a.semantic_id() == b.semantic_id() != c.semantic_id()
    assert p.Plan.from_json(a.to_json()) == a
    assert "running sums" in a.explain()


def test_no_recomputation_where_joins_and_subqueries_do(spark, tables):
    for sql in (
        "SELECT id FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.id = t.id AND u.w > t.v)",
        "SELECT t.id FROM t, u WHERE t.id = u.id AND t.v < (SELECT AVG(w) FROM u)",
        "SELECT a.id FROM t a JOIN t b ON a.k = b.k WHERE a.id < b.id",
        "SELECT k, GROUPING(k) AS g, COUNT(*) AS n FROM t GROUP BY CUBE (k)",
    ):
        assert not any(isinstance(n, p.Recompute) for n in compile_sql(spark, sql, tables).nodes)


def test_other_dialect(spark, tables):
    plan = compile_sql(spark, "SELECT `k`, GROUP_CONCAT(id ORDER BY id SEPARATOR ';') AS ids FROM t GROUP BY `k`", tables, dialect="mysql")
    (agg,) = [a for n in plan.nodes if isinstance(n, p.Aggregate) for a in n.aggregates]
    assert agg.function == "string_agg" and agg.separator == ";"


@pytest.mark.parametrize(
    "node",
    [
        p.TopN("t", "i", (), 3),
        p.TimeWindow("t", "i", "cumulate", "ts", size=10, step=3),
        p.TimeWindow("t", "i", "hop", "ts", size=10),
        p.Watermark("t", "i", "ts", 1, "ignore"),
        p.Aggregate("t", "i", (), (p.Agg("m", "median", "x"),)),
        p.Aggregate("t", "i", (), (p.Agg("m", "string_agg", "x"),)),
        p.IntervalJoin("t", "i", "i", (), "overlap", "a", "b", "c"),
        p.Join("t", "i", "i", "sideways"),
        p.SetOp("t", "i", "i", "minus"),
        p.Filter("t", "later", "x"),
    ],
)
def test_plans_are_checked(node):
    with pytest.raises(p.PlanError):
        p.Plan((p.Input("i", "x"), node), "t").validate()


def test_sharing():
    i = p.Input("i", "x")
    n, s = p.Agg("n", "count"), p.Agg("s", "sum", "v")
    whole = p.Plan((i, p.Aggregate("a", "i", ("k",), (n, s))), "a")
    part = p.Plan((i, p.Aggregate("a", "i", ("k",), (s,))), "a")
    other = p.Plan((i, p.Aggregate("a", "i", ("j",), (s,))), "a")
    assert reuse(whole, whole).kind == "exact"
    assert reuse(whole, part).columns == ("k", "s")
    assert reuse(part, whole) is None and reuse(whole, other) is None


def test_pareto():
    assert pareto({"a": Cost(1, 5), "b": Cost(5, 1), "c": Cost(5, 5)}) == ["a", "b"]


def test_admission():
    gate = Admission(max_jobs=1)
    assert gate.request("a") and not gate.request("b") and not gate.request("c")
    assert gate.release("a") == ["b"]


def maintained(spark, sql, rows, ddl):
    graph = StreamGraph(compile_sql(spark, sql, {"t": spark.createDataFrame([], ddl).schema}), spark)
    for part in (rows[::2], rows[1::2]):
        graph.push({"t": spark.createDataFrame(part, ddl)})
    return sorted(tuple(r) for r in graph.result().collect())


def test_filter_clauses(spark):
    rows = [(i, i % 3) for i in range(10)]
    got = maintained(spark, "SELECT k, COUNT(*) FILTER (WHERE id > 4) AS n, SUM(id) FILTER (WHERE id < 4) AS s FROM t GROUP BY k", rows, "id int, k int")
    assert got == [(k, sum(i > 4 for i, x in rows if x == k), sum(i for i, x in rows if x == k and i < 4)) for k in range(3)]


def test_window_functions_in_sql(spark):
    rows = [(t,) for t in (3, 8, 20, -2)]
    assert maintained(spark, "SELECT tumble_start(ts, 10) AS w, COUNT(*) AS n FROM t GROUP BY tumble_start(ts, 10)", rows, "ts bigint") == [(-10, 1), (0, 2), (20, 1)]
    got = maintained(spark, "SELECT w, COUNT(*) AS n FROM t LATERAL VIEW explode(hop_starts(ts, 10, 5)) x AS w GROUP BY w", rows, "ts bigint")
    want: dict = {}
    for (t,) in rows:
        for s in range(-20, 30, 5):
            if s <= t < s + 10:
                want[s] = want.get(s, 0) + 1
    assert got == sorted(want.items())
    got = maintained(spark, "SELECT w, COUNT(*) AS n FROM t LATERAL VIEW explode(cumulate_ends(ts, 20, 10)) x AS w GROUP BY w", rows, "ts bigint")
    assert got == [(0, 1), (10, 2), (20, 2), (30, 1), (40, 1)]


def test_macros_are_known(spark):
    macro(spark, "wf_third", "x INT", "INT", "x DIV 3")
    assert maintained(spark, "SELECT wf_third(id) AS b, COUNT(*) AS n FROM t GROUP BY wf_third(id)", [(i,) for i in range(6)], "id int") == [(0, 3), (1, 3)]
