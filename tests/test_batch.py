"""Whole-input forms: results on odd rows, and plans that large tables need."""

import random

import duckdb
from pyspark.sql import functions as F

from weirflow import suite
from weirflow.operators import batch


def test_pairs_within_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(-40, 40)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, k bigint")
    want = sorted((a, b) for g, a in rows for h, b in rows if g is not None and g == h and a is not None and b is not None and a < b)
    for size in (4, 50, 4096):
        got = batch.pairs_within(df, "g", "k", ("x", "y"), rows=size)
        assert got.columns == ["x", "y"]
        assert sorted(map(tuple, got.collect())) == want


def test_pairs_of_one_file_are_dealt_out(spark, sf_dir, tmp_path):
    suite.table(spark, sf_dir, "customer").withColumn("c_nationkey", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    suite.table(spark, sf_dir, "nation").write.parquet(str(tmp_path / "nation.parquet"))
    one = suite.table(spark, str(tmp_path), "customer")
    n, query = one.count(), suite.queries()["join_self"]
    assert query(spark, str(tmp_path)).count() == n * (n - 1) // 2
    for pairs in (query(spark, sf_dir), batch.pairs_within(one, "c_nationkey", "c_custkey", ("x", "y"), rows=20)):
        tasks = [t["count"] for t in pairs.groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) >= 8 and max(tasks) < sum(tasks) / 3


def test_not_in_under_or_compares_by_equality(spark, sf_dir, tmp_path):
    name, duck = "star_returned_or_inactive", duckdb.connect()
    query, sql = suite.queries()[name], suite.oracle_sql()[name]
    plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    tables = {
        "customer": ([(k,) for k in (1, 2, 2, 3, 4, 5, None, None)], "c_custkey bigint"),
        "orders": ([(10, 1), (11, 2), (12, 2), (13, None), (14, 3), (None, 5)], "o_orderkey bigint, o_custkey bigint"),
        "lineitem": ([(10, "R"), (10, "R"), (11, "N"), (12, "R"), (13, "R"), (14, None), (None, "R")], "l_orderkey bigint, l_returnflag string"),
    }
    for i, users in enumerate(([1, 2, 2, 3, None], [None], [], [3, 4, 5])):
        folder = tmp_path / str(i)
        for t, (rows, schema) in (tables | {"events": ([(u,) for u in users], "user_id bigint")}).items():
            spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{t}.parquet"))
            duck.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        got = sorted(str(r[0]) for r in query(spark, str(folder)).collect())
        assert got == sorted(str(r[0]) for r in duck.execute(sql).fetchall())
