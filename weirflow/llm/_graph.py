"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm._shared import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node with an edge can reach.

    edges has bigint columns a and b.  Large-star and small-star rounds
    alternate until the edges stay as they are; each round is written to the
    shared folder.  Only minima per node are aggregated, so a node with very
    many edges is combined on the map side, and no neighbour list is built.
    """

    def least(directed: DataFrame) -> DataFrame:
        return directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        mark = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == before:
            break
        before = mark
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        mins = least(large)
        small = (
            large.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(mins.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        current = materialize(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
