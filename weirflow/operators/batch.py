"""What each node computes from whole inputs, as DataFrame expressions.  Inputs and results are bags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.plans.nodes import Agg, IntervalJoin, Join, Order, TimeWindow


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def ordering(order: tuple[Order, ...]) -> list[Column]:
    return [getattr(col(o.column), f"{'desc' if o.descending else 'asc'}_nulls_{'first' if o.nulls_first else 'last'}")() for o in order]


def _string_agg(a: Agg) -> Column:
    """Values in order, nulls left out; equal order keys fall back on the value itself."""
    by = ", ".join(f"`{o.column}` {'DESC' if o.descending else 'ASC'} NULLS {'FIRST' if o.nulls_first else 'LAST'}" for o in a.order)
    sep = a.separator.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"listagg(cast(`{a.column}` as string), '{sep}') within group (order by {by})")


def aggregate_column(a: Agg) -> Column:
    c = col(a.column) if a.column else F.lit(1)
    built = {
        "count": lambda: F.count(c),
        "sum": lambda: F.sum(c),
        "avg": lambda: F.avg(c.cast("double")),
        "stddev_samp": lambda: F.stddev_samp(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "count_distinct": lambda: F.countDistinct(c),
        "string_agg": lambda: _string_agg(a),
    }[a.function]()
    return built.alias(a.output)


def aggregate(df: DataFrame, keys: tuple[str, ...], aggregates: tuple[Agg, ...]) -> DataFrame:
    by = [col(k) for k in keys]
    if not aggregates:
        return df.select(*by).distinct()
    return df.groupBy(*by).agg(*map(aggregate_column, aggregates))


def join(left: DataFrame, right: DataFrame, node: Join) -> DataFrame:
    terms = [left[f"`{a}`"] == right[f"`{b}`"] for a, b in node.pairs]
    if node.condition:
        terms.append(F.expr(node.condition))
    if not terms:
        if node.how == "inner":
            return left.crossJoin(right)
        terms = [F.lit(True)]
    return left.join(right, reduce(lambda a, b: a & b, terms), node.how)


def interval_join(left: DataFrame, right: DataFrame, node: IntervalJoin) -> DataFrame:
    """A point, or an overlap of half-open intervals; a null bound matches nothing."""
    on = [left[f"`{a}`"] == right[f"`{b}`"] for a, b in node.keys]
    start, end = right[f"`{node.right_start}`"], right[f"`{node.right_end}`"]
    if node.mode == "contains_point":
        on += [start <= left[f"`{node.left_start}`"], left[f"`{node.left_start}`"] < end]
    else:
        on += [left[f"`{node.left_start}`"] < end, start < left[f"`{node.left_end}`"]]
    return left.join(right, reduce(lambda a, b: a & b, on), "inner")


def bucketed_interval_join(left: DataFrame, right: DataFrame, node: IntervalJoin, width: int) -> DataFrame:
    """interval_join() where no equal keys narrow it down: intervals are cut at multiples of `width`, and only
    pieces of the same stretch meet, so it shuffles on equality instead of comparing all with all."""
    first = lambda c: F.floor(c / width)
    stretch = lambda a, b: F.explode(F.sequence(first(a), F.greatest(first(a), F.ceil(b / width) - 1)))
    point = node.mode == "contains_point"
    ls = col(node.left_start)
    le = ls + 1 if point else col(node.left_end)
    cut_l = left.where(ls.isNotNull() & le.isNotNull() & (ls < le)).withColumn("_l", stretch(ls, le)).withColumn("_from", ls)
    rs, re = col(node.right_start), col(node.right_end)
    cut_r = right.where(rs.isNotNull() & re.isNotNull() & (rs < re)).withColumn("_r", stretch(rs, re)).withColumn("_to", rs)
    on = [cut_l[f"`{a}`"] == cut_r[f"`{b}`"] for a, b in node.keys] + [F.col("_l") == F.col("_r")]
    # A pair that shares several stretches counts where the later of the two begins.
    on.append(F.col("_l") == first(F.greatest("_from", "_to")))
    on += [rs <= ls, ls < re] if point else [ls < re, rs < le]
    return cut_l.join(cut_r, reduce(lambda a, b: a & b, on), "inner").drop("_l", "_r", "_from", "_to")


#: Rows of a block of pairs_within(): a tile makes up to its square.
PAIR_BLOCK = 4096


def pairs_within(df: DataFrame, group: str, key: str, outputs: tuple[str, str], rows: int = PAIR_BLOCK) -> DataFrame:
    """The two keys, lesser first, of each two rows of a group whose keys differ: the self-join on equal groups and
    key < key.  A join by the group alone is one task a group, or one task in all if the side beside it is broadcast.
    Here groups are cut into blocks of some `rows` rows, by hash, and each two blocks meet once, in a tile, whichever
    has the lesser keys; so tiles are alike in size, dealt to all tasks, and nearly no comparison is in vain."""
    spark, tile = df.sparkSession, ("_group", "_lo", "_hi")
    held = df.select(col(group).alias("_group"), col(key).alias("_key")).where("_group is not null and _key is not null")
    sizes = held.groupBy("_group").agg(F.ceil(F.count("*") / rows).alias("_n"))
    blocks = held.join(sizes, "_group").withColumn("_block", F.expr("pmod(xxhash64(_key), _n)"))
    low = blocks.select("_group", F.col("_key").alias("_a"), F.col("_block").alias("_lo"), F.expr("explode(sequence(_block, _n - 1))").alias("_hi"))
    high = blocks.groupBy("_group", F.col("_block").alias("_hi")).agg(F.collect_list("_key").alias("_keys"))
    high = high.select("_group", F.expr("explode(sequence(0L, _hi))").alias("_lo"), "_hi", "_keys")
    # By number: what is small in bytes is not in pairs, and must not be put together to a few tasks.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = low.repartition(tasks, *tile).join(high.repartition(tasks, *tile).hint("merge"), list(tile))
    met = met.select("_a", "_lo", "_hi", F.explode("_keys").alias("_b")).where("_a < _b or (_lo < _hi and _a > _b)")
    return met.select(F.least("_a", "_b").alias(outputs[0]), F.greatest("_a", "_b").alias(outputs[1]))


def over(df: DataFrame, outputs: tuple[tuple[str, str], ...]) -> DataFrame:
    return df.select("*", *[F.expr(e).alias(n) for n, e in outputs])


def top_n(df: DataFrame, order: tuple[Order, ...], limit: int, partition: tuple[str, ...] = ()) -> DataFrame:
    """The first rows by the order and then by all columns, so that ties always fall the same way."""
    named = {o.column for o in order}
    by = ordering(order) + [col(c).asc_nulls_last() for c in df.columns if c not in named]
    if not partition:
        return df.orderBy(*by).limit(limit)
    w = Window.partitionBy(*[col(p) for p in partition]).orderBy(*by)
    return df.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= limit).drop("_row")


def windows_of(df: DataFrame, node: TimeWindow) -> DataFrame:
    """Rows with each w_start and w_end of a tumble, hop or cumulate window that holds them."""
    t = col(node.time).cast("long")
    size, slide, step = F.lit(node.size).cast("long"), F.lit(node.slide).cast("long"), F.lit(node.step).cast("long")
    if node.kind == "tumble":
        start = t - F.pmod(t, size)
        return df.withColumn("w_start", start).withColumn("w_end", start + size)
    if node.kind == "hop":
        last = t - F.pmod(t, slide)
        back = ((node.size - 1) // node.slide) * node.slide
        out = df.withColumn("w_start", F.explode(F.sequence(last - back, last, slide)))
        return out.withColumn("w_end", F.col("w_start") + size).where(col(node.time) < F.col("w_end"))
    base = t - F.pmod(t, size)
    first = t - F.pmod(t, step) + step
    return df.withColumn("w_end", F.explode(F.sequence(first, base + size, step))).withColumn("w_start", F.col("w_end") - 1 - F.pmod(F.col("w_end") - 1, size))


def _numbered(df: DataFrame, node: TimeWindow) -> DataFrame:
    """Rows with the number of their session in _session."""
    w = Window.partitionBy(*[col(k) for k in node.keys]).orderBy(col(node.time))
    opens = F.coalesce((col(node.time) - F.lag(col(node.time)).over(w) > node.gap).cast("int"), F.lit(1))
    return df.withColumn("_open", opens).withColumn("_session", F.sum("_open").over(w)).drop("_open")


def sessions(df: DataFrame, node: TimeWindow) -> DataFrame:
    """Sessions end when more than `gap` passes; w_end is the last time in it."""
    bounds = [F.min(col(node.time)).alias("w_start"), F.max(col(node.time)).alias("w_end")]
    out = _numbered(df, node).groupBy(*[col(k) for k in node.keys], "_session").agg(*bounds, *map(aggregate_column, node.aggregates))
    return out.drop("_session")


def with_session_end(df: DataFrame, node: TimeWindow) -> DataFrame:
    """Rows with the last time of their session in _end."""
    w = Window.partitionBy(*[col(k) for k in node.keys], "_session")
    return _numbered(df, node).withColumn("_end", F.max(col(node.time)).over(w)).drop("_session")


def time_window(df: DataFrame, node: TimeWindow) -> DataFrame:
    df = df.where(col(node.time).isNotNull())
    if node.kind == "session":
        return sessions(df, node)
    return aggregate(windows_of(df, node), (*node.keys, "w_start", "w_end"), node.aggregates)


def set_op(left: DataFrame, right: DataFrame, mode: str) -> DataFrame:
    """By position; the names are those of the left side."""
    right = right.toDF(*left.columns)
    return {
        "union_all": lambda: left.unionAll(right),
        "union": lambda: left.unionAll(right).distinct(),
        "intersect_all": lambda: left.intersectAll(right),
        "intersect": lambda: left.intersect(right),
        "except_all": lambda: left.exceptAll(right),
        "except": lambda: left.subtract(right),
    }[mode]()
