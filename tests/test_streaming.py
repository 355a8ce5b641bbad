import pytest

from weirflow.catalog import Catalog, CatalogError
from weirflow.operators import zset as z
from weirflow.plans import nodes as p
from weirflow.plans.frontend import compile_sql
from weirflow.plans.graph import StreamGraph
from weirflow.plans.state import StateError
from weirflow.sources.connectors import UpsertSink
from weirflow.streaming.checkpoint import CheckpointCoordinator
from weirflow.streaming.metrics import Trace, explain_analyze, scraped
from weirflow.streaming.runner import Epochs, Job, MaterializedView, batch_limit, start_stream

SCHEMA = "id int, k string, v bigint"


def graph_of(spark, sql="SELECT k, SUM(v) AS s FROM t GROUP BY k"):
    return StreamGraph(compile_sql(spark, sql, {"t": spark.createDataFrame([], SCHEMA).schema}), spark)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_to_sink(spark, tmp_path):
    source = str(tmp_path / "in")
    graph, sink = graph_of(spark), UpsertSink(spark, ["k"])
    schema = spark.createDataFrame([], SCHEMA).schema
    for batch in ([(1, "a", 1), (2, "b", 2)], [(3, "a", 5)]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        start_stream(graph, {"t": spark.readStream.schema(schema).parquet(source)}, str(tmp_path / "cp"), sink).awaitTermination()
    assert rows(sink.read()) == [("a", 6), ("b", 2)]


def test_epochs_apply_once(spark):
    graph = graph_of(spark)
    epochs = Epochs(graph)
    one = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    assert epochs.run(0, {"t": one}) is not None and epochs.run(0, {"t": one}) is None
    with pytest.raises(p.PlanError):
        epochs.run(2, {"t": one})
    assert rows(graph.result()) == [("a", 1)]


def test_views_move_together(spark):
    lower = graph_of(spark)
    upper = StreamGraph(compile_sql(spark, "SELECT COUNT(*) AS n FROM sums WHERE s > 3", {"sums": spark.createDataFrame([], "k string, s bigint").schema}), spark)
    view = MaterializedView(lower, upper, "sums")
    view.push({"t": spark.createDataFrame([(1, "a", 1)], SCHEMA)}, 1)
    with pytest.raises(p.PlanError):
        view.push({"t": spark.createDataFrame([(1, "a", 1)], SCHEMA)}, 3)
    view.push({"t": spark.createDataFrame([(2, "a", 7)], SCHEMA)}, 2)
    assert rows(upper.result()) == [(1,)]


def test_barriers(spark):
    graph = graph_of(spark)
    c = CheckpointCoordinator(graph)
    graph.push({"t": spark.createDataFrame([(1, "a", 1)], SCHEMA)})
    assert c.start_barrier(1, 10)
    c.commit_barrier(1)
    assert not c.start_barrier(1, 10)
    with pytest.raises(StateError):
        c.start_barrier(2, 9)
    graph.push({"t": spark.createDataFrame([(2, "a", 1)], SCHEMA)})
    assert CheckpointCoordinator(graph).restore() == 10
    assert rows(graph.result()) == [("a", 1)]
    out = []
    assert c.emit(1, None, out.append) and not c.emit(1, None, out.append)
    with pytest.raises(StateError):
        c.emit(3, None, out.append)
    c.savepoint("s")
    graph.push({"t": spark.createDataFrame([(3, "a", 1)], SCHEMA)})
    assert c.restore_savepoint("s") == 10 and rows(graph.result()) == [("a", 1)]


def test_batch_limit():
    assert [batch_limit(r, 10, 20, 100, 300) for r in (5, 15, 30)] == [100, 200, 300]


def test_job(spark):
    job = Job.from_sql("j", spark, "SELECT k, SUM(v) AS s FROM t GROUP BY k", {"t": spark.createDataFrame([], SCHEMA).schema})
    one = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    job.push({"t": one})
    job.pause()
    with pytest.raises(p.PlanError):
        job.push({"t": one})
    job.resume()
    job.checkpoint_now()
    assert 'weirflow_batches_total{job="j"} 1' in scraped([job])
    said = explain_analyze(job.graph, {"t": one})
    assert "state=" in said and "push:" in said


def test_trace():
    t = Trace(2)
    for s in ("a", "b", "c"):
        t.mark(s)
    assert [e["stage"] for e in t.events] == ["b", "c"] and t.slowest() is not None


def test_catalog(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (3, "b", 2)], SCHEMA)
    c = Catalog(spark, {"t": t}, folder=str(tmp_path / "catalog"))
    c.execute("CREATE MODEL big AS SELECT * FROM t WHERE v > ${low}")
    c.execute("SET low = 1")
    c.objects["big"]["sql"] = "SELECT * FROM t WHERE v > 1"
    c.execute("CREATE SINK sums KEY (k) AS SELECT k, SUM(v) AS s FROM big GROUP BY k")
    first = c.publish()
    assert c.publish() is first
    c.push({"t": t}, "d1")
    c.push({"t": z.weighted(t.where("id = 2"), -1)}, "d2")
    assert rows(c.sinks["sums"].read()) == [("b", 2)]
    assert ("sums", "sink") in Catalog(spark, {"t": t}, folder=str(tmp_path / "catalog")).execute("SHOW")
    with pytest.raises(CatalogError):
        c.execute("DROP big")
    c.execute("CREATE MODEL one AS SELECT * FROM two")
    c.execute("CREATE MODEL two AS SELECT * FROM one")
    with pytest.raises(CatalogError, match="circle"):
        c.execute("EXPLAIN one")
    with pytest.raises(CatalogError):
        c.execute_batch("CREATE MODEL three AS SELECT * FROM t;\nNONSENSE")
    assert "three" not in c.objects
    c.execute("CREATE OR REPLACE MACRO wf_twice(x BIGINT) RETURNS BIGINT AS x * 2")
    assert spark.sql("SELECT wf_twice(4)").first()[0] == 8


def test_replay_after_restore_applies(spark):
    graph = graph_of(spark)
    epochs = Epochs(graph)
    one = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    epochs.run(0, {"t": one})
    graph.store.savepoint("s")
    epochs.run(1, {"t": one})
    graph.store.restore("s")
    assert epochs.last() == 0 and epochs.run(1, {"t": one}) is not None
    assert rows(graph.result()) == [("a", 2)]


def test_a_barrier_cuts_epoch_and_state_where_it_starts(spark):
    graph = graph_of(spark)
    c, out = CheckpointCoordinator(graph), []
    graph.push({"t": spark.createDataFrame([(1, "a", 1)], SCHEMA)})
    c.emit(1, None, out.append)
    c.start_barrier(1, 10)
    graph.push({"t": spark.createDataFrame([(2, "a", 5)], SCHEMA)})
    c.emit(2, None, out.append)
    c.commit_barrier(1)
    again = CheckpointCoordinator(graph)
    assert again.restore() == 10 and rows(graph.result()) == [("a", 1)]
    assert again.emit(2, None, out.append) and not again.emit(2, None, out.append) and len(out) == 3


def test_late_sinks_are_filled(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (3, "b", 2)], SCHEMA)
    c = Catalog(spark, {"t": t}, folder=str(tmp_path))
    c.execute("CREATE SINK sums KEY (k) AS SELECT k, SUM(v) AS s, COUNT(*) AS n FROM t GROUP BY k")
    c.publish()
    c.push({"t": t}, "d1")
    c.execute("CREATE SINK late KEY (k) AS SELECT k, MAX(v) AS m FROM t GROUP BY k")
    c.execute("CREATE SINK part KEY (k) AS SELECT k, SUM(v) AS s FROM t GROUP BY k")
    c.execute("ALTER SINK sums KEY (k, n)")
    c.publish()
    assert rows(c.sinks["late"].read()) == [("a", 5), ("b", 2)] and rows(c.sinks["sums"].read()) == [("a", 6, 2), ("b", 2, 1)]
    again = Catalog(spark, {"t": t}, folder=str(tmp_path))
    assert again.published.version == 2 and again.publish() is again.published
    gone = z.weighted(t.where("id = 2"), -1)
    again.push({"t": gone}, "d2")
    again.push({"t": gone}, "d2")
    assert rows(again.sinks["late"].read()) == [("a", 1), ("b", 2)] and rows(again.sinks["sums"].read()) == [("a", 1, 1), ("b", 2, 1)]
    assert rows(again.sinks["part"].read()) == [("a", 1), ("b", 2)] and again.sinks["sums"].keys == ["k", "n"]
    again.execute("DROP late")
    again.publish()
    assert "late" not in again.sinks and len(again._room.names("graphs")) == len({id(g) for g in again.graphs.values()})


def test_variables_and_names_in_models(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (3, "b", 2)], SCHEMA)
    c = Catalog(spark, {"t": t})
    c.execute("CREATE MODEL big AS SELECT id, k, v AS big FROM t WHERE v > ${low}")
    c.execute("CREATE SINK s KEY (k) AS SELECT k, SUM(big) AS s FROM big WHERE id < ${high} GROUP BY k")
    c.execute("SET low = 1")
    with pytest.raises(CatalogError, match="high"):
        c.publish()
    c.execute("SET high = 3")
    c.publish()
    c.push({"t": t}, "d")
    assert rows(c.sinks["s"].read()) == [("a", 5)]


def test_rebuild_takes_over_at_the_fence(spark):
    from weirflow.catalog import Rebuild

    t = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], SCHEMA)
    old = graph_of(spark)
    old.push({"t": t})
    plan = compile_sql(spark, "SELECT k, SUM(v) * 2 AS s FROM t GROUP BY k", {"t": t.schema})
    made = Rebuild(old, plan, {"t": t}, spark, at=1)
    more = spark.createDataFrame([(3, "a", 4)], SCHEMA)
    old.push({"t": more})
    with pytest.raises(p.PlanError):
        made.swap(2)
    made.catch_up(2, {"t": more})
    new, change = made.swap(2)
    assert rows(new.result()) == [("a", 10), ("b", 10)]
    assert rows(change) == [("a", 5, -1), ("a", 10, 1), ("b", 5, -1), ("b", 10, 1)]
