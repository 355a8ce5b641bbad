import pytest
from pyspark.sql import functions as F

from weirflow.functions import text
from weirflow.functions.udf import UdfError, UdfRegistry, UnsupportedLanguage
from weirflow.operators import zset as z
from weirflow.sources import changelog as cl
from weirflow.sources import connectors as cn

CHANGE = "id int, v string, _sync_op int, _sync_order long"


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), CHANGE)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_mirror(spark):
    m = cl.KeyedMirror(["id"], spark)
    assert rows(m.apply(changes(spark, (1, "a", 0, 1), (2, "b", 0, 2), (1, "c", 0, 3)))) == [(1, "c", 1), (2, "b", 1)]
    assert rows(m.apply(changes(spark, (1, "c", 0, 4), (2, None, 1, 5), (3, "z", 0, 6)))) == [(2, "b", -1), (3, "z", 1)]
    with pytest.raises(z.IntegrityError):
        m.apply(changes(spark, (9, None, 1, 7)))
    assert rows(m.snapshot()) == [(1, "c"), (3, "z")]


def test_snapshot_gives_way(spark):
    snapshot = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "id int, v string")
    assert rows(cl.merge_snapshot(snapshot, changes(spark, (1, "new", 0, 1), (2, None, 1, 2)), ["id"])) == [(1, "new"), (3, "old")]


def test_versions(spark):
    log = changes(spark, (1, "a", 0, 1), (1, "b", 0, 2), (1, None, 1, 3), (2, "x", 0, 2)).withColumn("commit_seq", F.col("_sync_order"))
    held = cl.row_versions(log, ["id"])
    assert [rows(cl.as_of(held, k)) for k in (1, 2, 3)] == [[(1, "a")], [(1, "b"), (2, "x")], [(2, "x")]]
    assert cl.retention_floor(5, {"a": 3}, {"p": 4}) == 3
    assert cl.collectable(held, 2).count() == 1


def test_log(spark, tmp_path):
    log = cl.ChangeLog(spark, str(tmp_path / "log"))
    assert log.append(1, changes(spark, (1, "a", 0, 1)))
    assert not log.append(1, changes(spark, (7, "no", 0, 1)))
    assert log.append(2, changes(spark, (2, "b", 0, 1)))
    with pytest.raises(cl.GapError):
        log.append(4, changes(spark))
    assert [r["id"] for r in log.read(after=1).collect()] == [2]
    log.drop_before(2)
    assert log.commits() == [2]


def test_decoding(spark):
    lines = spark.createDataFrame([("table public.t: INSERT: id[integer]:1 name[text]:'it''s' x[int]:null",), ("COMMIT 5",), ("table public.t: DELETE: id[integer]:1",)], "value string")
    got = cl.decode_lines(lines).collect()
    assert [(r["_sync_op"], r["fields"]) for r in got] == [(0, {"id": "1", "name": "it's", "x": None}), (1, {"id": "1"})]


def test_unapplied(spark):
    new = spark.createDataFrame([("s", "1", 10), ("s", "2", 20)], "server string, gtid string, v int")
    old = spark.createDataFrame([("s", "1")], "server string, gtid string")
    assert [r["v"] for r in cl.unapplied(new, old).collect()] == [20]


def test_upsert_sink_once(spark):
    sink = cn.UpsertSink(spark, ["id"])
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sink.write("d1", first) and not sink.write("d1", first)
    sink.write("d2", spark.createDataFrame([(1, "a", -1), (1, "q", 1), (2, "b", -1)], f"id int, v string, {z.WEIGHT} long"))
    assert rows(sink.read()) == [(1, "q")] and sink.frontier() == 2


def test_append_sink_once(spark, tmp_path):
    sink = cn.AppendSink(spark, str(tmp_path / "out"))
    one = spark.createDataFrame([(1,)], "id int")
    assert sink.write("a", one) and not sink.write("a", one) and sink.count() == 1


def test_registry(spark, tmp_path):
    registry = cn.default_registry()
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert registry.open("parquet", "source", spark, path=str(tmp_path / "p")).count() == 3
    with pytest.raises(cn.UnsupportedConnector):
        registry.open("carrier-pigeon", "sink", spark)
    with pytest.raises(cn.UnsupportedConnector):
        registry.open("paimon", "sink", spark).write("d", spark.range(1))


def test_schema_changes(spark):
    schema = lambda ddl: spark.createDataFrame([], ddl).schema
    assert cn.schema_change(schema("a int"), schema("a int"))[0] == "same"
    assert cn.schema_change(schema("a int"), schema("a bigint, b string"))[0] == "propagate"
    assert cn.schema_change(schema("a bigint, b int"), schema("a bigint"))[0] == "rebuild"
    assert cn.schema_change(schema("a bigint"), schema("a int"))[0] == "rebuild"
    wide = cn.propagate(spark.createDataFrame([(1,)], "a int"), schema("a bigint, b string"))
    assert [tuple(r) for r in wide.collect()] == [(1, None)]


def test_pairs_do_not_collide(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "x")], "l string, r string")
    assert df.select(cn.pair_id("l", "r").alias("p")).distinct().count() == 3


def test_truncation(spark):
    texts = ["héllo€x😀y", "ab", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for n in range(14):
        got = [r[0] for r in df.select(text.truncate_bytes(F.col("s"), n)).collect()]
        assert got == [None if t is None else t.encode()[:n].decode(errors="ignore") for t in texts]


def test_json(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [1, 2]}',), ("no",)], "j string")
    assert [r[0] for r in df.select(text.format_json(F.col("j"))).collect()] == ['{"a":[1,2],"b":1}', None]
    assert [r[0] for r in df.select(text.truncate_json(F.col("j"), 5)).collect()] == [None, None]


def test_functions_are_fenced(spark):
    registry = UdfRegistry(spark)
    for source in ("import os\ndef call(x):\n    return 1", "def call(x):\n    return x.__class__", "def other(x):\n    return x"):
        with pytest.raises(UdfError):
            registry.register("bad", "scalar", source, "int")
    with pytest.raises(UnsupportedLanguage):
        registry.register("w", "scalar", "", "int", language="wasm")
    registry.register("noise", "scalar", "def call(x):\n    return x", "int", deterministic=False)
    with pytest.raises(UdfError):
        registry.identities()
