"""Mixing sources to target weights.

Documents fall into blocks by a hash, and a source's blocks are permuted.  A
source's target is met by whole passes over its blocks, a prefix of the
permuted blocks, and one last draw: documents, first fit, of the block that the
target ends in and of those after it.  The block draws of all sources are then
split among output shards by a tree of multivariate-hypergeometric draws: a
node divides its quotas between its two halves exactly as drawing that many
blocks without replacement would.  Shards therefore own disjoint runs of each
source's permuted blocks and shuffle locally; a document is taken as often as
a quota covers a draw of it.  Only quotas per source reach the driver, never
blocks or documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm._shared import materialize, table, word_count

WEIGHTS = (5, 2, 1)
#: A source has a block for so many words and one for so many documents.
BLOCK_WORDS, BLOCK_DOCS = 1 << 19, 2048
#: Of the query: output shards, and what draws depend on besides the rows.
N_SHARDS, SEED = 16, 7
#: About so many documents that would fill what is left of a target are tried in one round.
TRIED = 4096


@dataclass(frozen=True)
class Mix:
    """draws: a row for each input row, with size, source_size, target, and the shards that drew it."""

    draws: DataFrame
    n_shards: int


def quota_tree(quotas: np.ndarray, n_shards: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each shard the sources it draws blocks of, and how many; sources without any are left out.

    A node hands half of its shards their share of all its blocks, drawn without replacement over its
    sources.  Work and memory follow the quotas that are not 0, at most one a block.
    """

    def node(at: int, n: int, places: np.ndarray, held: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        if n == 1:
            return [(places, held)]
        left, total = n // 2, int(held.sum())
        rng = np.random.default_rng([seed, at, n])
        draws = (total * left + int(rng.integers(n))) // n
        got = rng.multivariate_hypergeometric(held, draws) if total else held
        halves = []
        for begin, size, own in ((at, left, got), (at + left, n - left, held - got)):
            some = own > 0
            halves += node(begin, size, places[some], own[some])
        return halves

    held = np.asarray(quotas, np.int64)
    return node(0, n_shards, np.flatnonzero(held), held[held > 0])


def split_quotas(quotas: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """For each shard the blocks it gets of each source; columns add up to quotas, shards differ by at most one block a level."""
    out = np.zeros((n_shards, len(quotas)), np.int64)
    for shard, (places, held) in enumerate(quota_tree(quotas, n_shards, seed)):
        out[shard, places] = held
    return out.tolist()


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: tuple[int, int] = (3, 2), limit: int = 2) -> DataFrame:
    """(source, source_size, n_docs, place, target) from rows (source, size).

    Sources take the weights in code-point order, null last, and share times[0]/times[1] of all
    sizes; a target stops at `limit` times its source's size and the excess is
    shared again by weight until none is above.  The shared-out level is found
    in one go: sorted by size for weight, the sources that stop are a prefix.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    w = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("place", F.row_number().over(w) - 1)
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    src = src.withColumn("weight", weight).withColumn("most", F.lit(limit) * F.col("source_size"))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("place"))
    up_to = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    # The level is num / den words for a unit of weight.
    src = src.withColumn("num", F.lit(times[0]) * F.sum("source_size").over(every) - times[1] * F.coalesce(F.sum("most").over(up_to), F.lit(0)))
    src = src.withColumn("den", times[1] * F.sum("weight").over(onward))
    src = src.withColumn("stops", F.col("num").cast("decimal(38,0)") * F.col("weight") >= F.col("most").cast("decimal(38,0)") * F.col("den"))
    src = src.withColumn("at", F.row_number().over(order))
    level = F.min_by(F.struct("num", "den"), F.when(~F.col("stops"), F.col("at"))).over(every)
    src = src.withColumn("level", level)
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(
        (F.col("weight") * F.col("level.num")).cast("double") / F.col("level.den")
    )
    return src.select("source", "source_size", "n_docs", "place", target.alias("target"))


def _unit(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))


def last_draws(held: DataFrame, blocks: DataFrame) -> DataFrame:
    """(place, unit): what each source's last draw takes, first fit in order over the block that the target ends in and those after it.

    A round tries the documents no larger than what is left, of as many blocks in order as hold
    TRIED of them, so no array is longer than that and a block.  What was tried and left out
    never fits again.  At the end no document after the target's end fits.  Documents without
    words come with whole blocks only.
    """
    end = blocks.where("ends").select("place", F.col("rank").alias("end"), "room")
    docs = held.join(blocks.select("place", "block", "rank"), ["place", "block"]).join(end.drop("room"), "place").where("rank >= end and size > 0")
    docs = materialize(docs.groupBy("place", "rank", "unit", "doc_id").agg(F.sum("size").alias("size")), "left-out")
    rooms = end.select("place", F.col("room").alias("left"), (F.col("end") - 1).alias("done"))
    out = docs.select("place", "unit").limit(0)
    while True:
        fit = docs.join(rooms, "place").where("rank > done and size <= left")
        upto = F.sum("n").over(Window.partitionBy("place").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        each = fit.groupBy("place", "rank").agg(F.count(F.lit(1)).alias("n"))
        each = each.withColumn("before", F.coalesce(upto, F.lit(0))).where(f"before < {TRIED}").select("place", "rank")
        state = F.struct(F.col("left").alias("left"), F.array().cast("array<string>").alias("units"))
        tried = fit.join(each, ["place", "rank"]).groupBy("place").agg(
            F.sort_array(F.collect_list(F.struct("rank", "unit", "doc_id", "size"))).alias("xs"), F.first("left").alias("left"), F.max("rank").alias("done")
        )
        tried = materialize(tried.select("place", "done", F.aggregate("xs", state, first_fit).alias("got")), "filled")
        if tried.isEmpty():
            return out.distinct()
        out = out.unionAll(tried.select("place", F.explode("got.units").alias("unit")))
        rooms = tried.select("place", F.col("got.left").alias("left"), "done")


def first_fit(acc: Column, x: Column) -> Column:
    return F.when(
        x["size"] <= acc["left"],
        F.struct((acc["left"] - x["size"]).alias("left"), F.concat(acc["units"], F.array(x["unit"])).alias("units")),
    ).otherwise(acc)


def owners(plan: list, n_shards: int, seed: int, spark: SparkSession) -> DataFrame:
    """(place, draw, shard): the shard whose quota covers each block draw, a row a draw.  plan has rows (place, draws)."""
    places = np.array([r["place"] for r in plan], np.int64)
    at = np.zeros(len(plan), np.int64)
    held: tuple[list, list, list, list] = ([], [], [], [])
    for shard, (own, n) in enumerate(quota_tree([r["draws"] for r in plan], n_shards, seed)):
        for column, x in zip(held, (places[own], np.full(len(own), shard), at[own], at[own] + n - 1), strict=True):
            column.append(x)
        at[own] += n
    cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in held]
    runs = spark.createDataFrame(pa.table(dict(zip(("place", "shard", "first", "last"), cols, strict=True))))
    return runs.select("place", F.explode(F.sequence("first", "last")).alias("draw"), F.col("shard").cast("int").alias("shard"))


def mix(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> Mix:
    """Draw the mix from rows (doc_id, text, source).

    A null text has size 0; null sources are one source.  Rows with the same
    doc_id and source, null doc_ids too, are taken or left together.  The same
    rows give the same mix whatever their order.  An empty table gives an empty
    mix.  Other columns of docs are left out.
    """
    rows = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _unit(F.col("doc_id"), seed).alias("unit")),
        "sizes",
    )
    src = source_targets(rows)
    n_blocks = 1 + F.floor(F.col("source_size") / BLOCK_WORDS) + F.floor(F.col("n_docs") / BLOCK_DOCS)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    src = src.withColumn("n_blocks", n_blocks.cast("long")).withColumn("passes", passes)
    src = materialize(src.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "targets")

    hashed = F.conv(F.substring("unit", 1, 8), 16, 10).cast("long")
    held = rows.join(src, rows["source"].eqNullSafe(src["source"])).drop(src["source"])
    held = held.withColumn("block", F.shiftright(hashed * F.col("n_blocks"), 32))
    blocks = held.groupBy("place", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    by = Window.partitionBy("place").orderBy(F.md5(F.concat_ws("|", "place", "block", F.lit(seed))), "block")
    blocks = blocks.withColumn("rank", F.row_number().over(by) - 1).withColumn(
        "upto", F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    whole = F.col("upto") <= F.col("rest")
    ends = ~whole & (F.col("upto") - F.col("words") < F.col("rest"))
    blocks = materialize(
        blocks.select("place", "block", "rank", "passes", whole.alias("whole"), ends.alias("ends"), (F.col("rest") - F.col("upto") + F.col("words")).alias("room")),
        "blocks",
    )
    some = materialize(last_draws(held, blocks), "last-draws").withColumn("part", F.lit(True))

    # Quotas: all blocks of each whole pass, then the permuted prefix and the last draw.
    sizes = blocks.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("whole") | F.col("ends")).alias("prefix"), F.first("passes").alias("passes"))
    sizes = materialize(sizes, "quotas")
    plan = sizes.select("place", (F.col("passes") * F.col("n") + F.col("prefix")).alias("draws")).orderBy("place").collect()
    owned = materialize(owners(plan, n_shards, seed, docs.sparkSession), "owners")

    # Each block's draws find the shard that owns them; documents then read their block's.
    last = F.when(F.col("whole") | F.col("ends"), F.col("passes")).otherwise(F.col("passes") - 1)
    turns = blocks.join(sizes.select("place", "n"), "place").where(last >= 0).select("place", "block", "whole", "ends", "passes", "n", "rank", F.explode(F.sequence(F.lit(0), last)).alias("turn"))
    turns = turns.withColumn("draw", F.col("turn") * F.col("n") + F.col("rank")).join(owned, ["place", "draw"])
    ending = turns.where("ends and turn = passes").select("place", F.col("shard").alias("end_shard"))
    full = F.when(F.col("whole") | (F.col("turn") < F.col("passes")), F.struct("turn", "shard"))
    dealt = turns.groupBy("place", "block").agg(F.transform(F.sort_array(F.collect_list(full)), lambda x: x["shard"]).alias("full"))

    some = some.join(ending, "place").select("place", "unit", "end_shard")
    held = held.join(dealt, ["place", "block"], "left").join(some, ["place", "unit"], "left")
    none = F.array().cast("array<int>")
    shards = F.concat(F.coalesce("full", none), F.when(F.col("end_shard").isNotNull(), F.array("end_shard")).otherwise(none))
    return Mix(held.select("doc_id", "source", "unit", "size", "source_size", "target", shards.alias("shards")), n_shards)


def mixed_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """The mix as rows of docs, dealt to n_shards partitions and shuffled inside each.

    A document drawn twice gives two rows, repeated rows are drawn together, and an empty table gives none.
    """
    drawn = mix(docs, n_shards, seed).draws.select("doc_id", "source", "unit", "shards").distinct()
    cols = docs.columns
    d, m = docs.alias("d"), drawn.alias("m")
    rows = d.join(m, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")))
    rows = rows.select(*[F.col(f"d.`{c}`") for c in cols], F.col("m.unit").alias("_unit"), F.posexplode("m.shards").alias("_pass", "_shard"))
    out = rows.repartitionById(n_shards, F.col("_shard")).sortWithinPartitions("_shard", F.xxhash64("_unit", "_pass", F.lit(seed)))
    return out.select(*cols)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its size, its source's size and target, and the words and draws that shards' quotas take of it."""
    drawn = mix(table(spark, sf_dir, "documents"), N_SHARDS, SEED).draws
    return drawn.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("shards")).alias("taken"),
        F.size("shards").alias("draws"),
    )


#: What is taken does not depend on which shard draws it, as long as the tree's quotas cover every draw once, which this therefore checks.
OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}') AS unit
  FROM documents
),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s1),
s3 AS (SELECT *, ({list(WEIGHTS)})[place % {len(WEIGHTS)} + 1] AS weight, 2 * source_size AS most FROM s2),
s4 AS (
  SELECT *, row_number() OVER w AS rk, 3 * sum(source_size) OVER () - 2 * coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
    2 * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den
  FROM s3 WINDOW w AS (ORDER BY CAST(most AS DOUBLE) / weight, place)
),
s5 AS (SELECT *, num * weight >= most * den AS stops FROM s4),
s6 AS (SELECT *, first(struct_pack(num := num, den := den) ORDER BY CASE WHEN stops THEN NULL ELSE rk END NULLS LAST) OVER () AS level FROM s5),
s7 AS (SELECT *, CASE WHEN stops THEN CAST(most AS DOUBLE) ELSE CAST(weight * level.num AS DOUBLE) / CAST(level.den AS DOUBLE) END AS target FROM s6),
s AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INT) ELSE 0 END AS passes,
    1 + source_size // {BLOCK_WORDS} + n_docs // {BLOCK_DOCS} AS n_blocks
  FROM s7
),
h AS (
  SELECT d.*, source_size, target, place, passes, target - passes * source_size AS rest,
    CAST(('0x' || substr(unit, 1, 8))::BIGINT * n_blocks // 4294967296 AS BIGINT) AS block
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
),
b1 AS (SELECT place, block, sum(size) AS words, first(rest) AS rest FROM h GROUP BY place, block),
b2 AS (
  SELECT *, sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, row_number() OVER w AS rank
  FROM b1 WINDOW w AS (PARTITION BY place ORDER BY md5(place || '|' || block || '|{SEED}'), block)
),
b AS (SELECT place, block, rank, upto <= rest AS whole, upto > rest AND upto - words < rest AS ends, rest - upto + words AS room FROM b2),
l1 AS (
  SELECT h.place, b.rank, doc_id, unit, sum(size) AS size FROM h JOIN b ON h.place = b.place AND h.block = b.block JOIN b e ON e.place = b.place AND e.ends AND b.rank >= e.rank
  WHERE size > 0 GROUP BY h.place, b.rank, doc_id, unit
),
l AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY rank, unit, doc_id NULLS FIRST) AS o FROM l1),
f(place, o, remaining, unit) AS (
  SELECT place, 0, room, '' FROM b WHERE ends
  UNION ALL
  SELECT f.place, f.o + 1, CASE WHEN l.size <= f.remaining THEN f.remaining - l.size ELSE f.remaining END, CASE WHEN l.size <= f.remaining THEN l.unit ELSE '' END
  FROM f JOIN l ON l.place = f.place AND l.o = f.o + 1
),
k AS (SELECT DISTINCT place, unit FROM f WHERE unit <> ''),
x AS (
  SELECT h.*, passes + CASE WHEN b.whole OR k.unit IS NOT NULL THEN 1 ELSE 0 END AS draws
  FROM h JOIN b ON h.place = b.place AND h.block = b.block LEFT JOIN k ON h.place = k.place AND h.unit = k.unit
)
SELECT doc_id, size, source_size, target, CAST(size * draws AS BIGINT) AS taken, CAST(draws AS INT) AS draws FROM x"""
