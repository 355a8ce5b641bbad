"""Keeps a plan's result up to date as its inputs change.

push() takes changes of the inputs as weighted DataFrames and returns the
change of the result.  Every node follows changes by DataFrame algebra:

* filters and projections apply to the change itself;
* inner joins are bilinear: change of the left with the old right, and the new
  left with the change of the right;
* counts, and sums of whole numbers and decimals, are kept per group and added to;
* other aggregates keep how often each value occurs in a group, so a sum of
  floating-point numbers is that of the values that are left, whatever came and
  went, and a minimum reads values and not rows;
* all else recomputes what shares a key with the change, before and after, and
  returns the difference.

State lives in versioned folders.  A push adds what it changes, whatever the
size of the state, as a new version beside the one in force, which it replaces
only when all of it is there; a push that fails leaves everything as it was.
What a push reads of the state are the rows that share a key with the change.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, IntegerType, IntegralType, ShortType, StructType

from weirflow.operators import batch
from weirflow.operators import zset as z
from weirflow.plans import nodes as p
from weirflow.plans.state import StateStore, Version

Delta = DataFrame | None
SUMS = ("count", "sum", "avg", "stddev_samp")
#: What nodes keep in their state; it goes up when that changes, so that a folder of before is refused.
LAYOUT = 2
#: Types of which the sums that an aggregate needs are exact, so that what is added can be taken away.
EXACT = {"sum": (IntegralType, DecimalType), "avg": (IntegralType, DecimalType), "stddev_samp": (ByteType, ShortType, IntegerType)}


class StreamGraph:
    """plan with its state.  With a folder the state outlives the session; reopen it with the same plan."""

    def __init__(self, plan: p.Plan, spark: SparkSession, folder: str | None = None) -> None:
        self.plan, self.spark = plan.validate(), spark
        self.store = StateStore(spark, f"{plan.semantic_id()}.{LAYOUT}", folder)
        # Nodes that hold whole rows or sums notice a row that is taken away without being there; where such a node
        # lies between the inputs and the result, the result need not be looked through for it.
        self._guarded: dict[str, bool] = {}
        for n in plan.nodes:
            linear = isinstance(n, (p.Filter, p.Project, p.Watermark, p.IntervalJoin)) or getattr(n, "how", "") == "inner" or getattr(n, "mode", "") == "union_all"
            self._guarded[n.id] = not isinstance(n, p.Input) and (not linear or all(self._guarded[i] for i in n.inputs()))
        # Nodes whose change is read once, on the way to the result; it needs no copy, and the result is consolidated anyway.
        self._once: dict[str, bool] = {}
        for n in reversed(plan.nodes):
            readers = [m for m in plan.nodes if n.id in m.inputs()]
            if n.id == plan.output:
                self._once[n.id] = not readers
            else:
                self._once[n.id] = len(readers) == 1 and isinstance(readers[0], (p.Filter, p.Project)) and self._once[readers[0].id]

    # -- state ------------------------------------------------------------

    @property
    def version(self) -> int:
        return self.store.version

    def output(self) -> DataFrame:
        """The result as it is now, weighted."""
        if self.store.read("output") is None:
            self.push({})
        return z.consolidate(self.store.read("output"))

    def result(self) -> DataFrame:
        """The result as a bag."""
        return z.expand(self.output())

    def snapshot(self, version: int) -> DataFrame | None:
        """The result at an earlier version that is still kept."""
        held = self.store.read("output", version)
        return None if held is None else z.consolidate(held)

    # -- changes ----------------------------------------------------------

    def push(self, deltas: dict[str, DataFrame], **extra: object) -> DataFrame:
        """Apply changes {input: rows}; rows without a weight are inserted.  Returns the change of the result.

        extra is kept with the version, such as the epoch of the batch.
        """
        known = self.plan.inputs()
        if unknown := set(deltas) - set(known):
            raise p.PlanError(f"the plan has no input {sorted(unknown)}")
        with self.store.next_version() as version:
            version.extra = extra
            run = _Push(self, {k: z.weighted(d) for k, d in deltas.items()}, version)
            found: dict[str, Delta] = {}
            for n in self.plan.nodes:
                found[n.id] = getattr(run, "on_" + type(n).__name__.lower())(n, *[found[i] for i in n.inputs()])
            out = found[self.plan.output]
            held = self.store.read("output")
            if out is None:
                if held is None:
                    raise p.PlanError("the first push needs every input, if only an empty one")
                out = held.limit(0)
            delta = z.consolidate(out)
            if not self._guarded[self.plan.output]:
                delta = version.share(delta)
                run.check_output(held, delta)
            version.append("output", delta, z.consolidate, also="delta")
        return self.store.read("delta")


class _Push:
    """One push: the old state, the changes, and the version being written."""

    def __init__(self, graph: StreamGraph, deltas: dict[str, DataFrame], version: Version) -> None:
        self.graph, self.spark, self.store, self.deltas, self.version = graph, graph.spark, graph.store, deltas, version

    def hold(self, node: p.Node, side: str, delta: Delta, touched: DataFrame | None = None, keys: list[str] | None = None) -> tuple[Delta, Delta]:
        """(old, new) input of a node, not consolidated: all of it, or the rows with touched keys; the change is added to the state."""
        name = f"{node.id}.{side}"
        old = self.store.read(name, touched=touched, keys=keys)
        if old is not None and touched is not None:
            old = z.same_key(old, touched, keys)
        if delta is None:
            return old, old
        self.version.append(name, delta, z.consolidate, keys)
        return old, z.add([old, delta])

    def settle(self, n: p.Node, delta: Delta) -> Delta:
        """The change of a node, computed once if it is read more than once."""
        return delta if delta is None or self.graph._once[n.id] else self.version.share(z.consolidate(delta))

    def check_output(self, held: Delta, delta: DataFrame) -> None:
        """A row that leaves the result must be in it."""
        gone = delta.where(F.col(z.WEIGHT) < 0)
        if gone.isEmpty():
            return
        cols = z.values(delta)
        there = z.same_key(held, gone.select(*[batch.col(c) for c in cols]), cols) if held is not None else delta.limit(0)
        if not z.consolidate(z.add([there, gone])).where(F.col(z.WEIGHT) < 0).isEmpty():
            raise z.IntegrityError("a change takes away a row that is not there")

    # -- linear -----------------------------------------------------------

    def on_input(self, n: p.Input) -> Delta:
        delta = self.deltas.get(n.name)
        if delta is None:
            if self.store.version or n.schema is None:
                return None
            delta = self.spark.createDataFrame([], f"{n.schema}, {z.WEIGHT} long")
        return delta.select(*[batch.col(c) for c in n.columns], z.WEIGHT) if n.columns else delta

    def on_filter(self, n: p.Filter, delta: Delta) -> Delta:
        return None if delta is None else delta.where(n.predicate)

    def on_project(self, n: p.Project, delta: Delta) -> Delta:
        return None if delta is None else delta.select(*[F.expr(e).alias(o) for o, e in n.outputs], z.WEIGHT)

    # -- joins ------------------------------------------------------------

    def _bilinear(self, n: p.Node, left: Delta, right: Delta, meet: Callable) -> Delta:
        old_l, new_l = self.hold(n, "left", left)
        old_r, new_r = self.hold(n, "right", right)
        if new_l is None or new_r is None:
            return None

        def pair(a: DataFrame, b: DataFrame) -> DataFrame:
            a, b = a.withColumnRenamed(z.WEIGHT, "_wl"), b.withColumnRenamed(z.WEIGHT, "_wr")
            return meet(a, b).withColumn(z.WEIGHT, F.col("_wl") * F.col("_wr")).drop("_wl", "_wr")

        parts = [pair(left, old_r) if left is not None and old_r is not None else None, pair(new_l, right) if right is not None else None]
        return self.settle(n, z.add(parts))

    def on_join(self, n: p.Join, left: Delta, right: Delta) -> Delta:
        if n.how == "inner":
            return self._bilinear(n, left, right, lambda a, b: batch.join(a, b, n))
        keys = [[a for a, _ in n.pairs], [b for _, b in n.pairs]]
        return self.touched(n, [left, right], keys, lambda a, b: batch.join(a, b, n), whole=not n.pairs)

    def on_intervaljoin(self, n: p.IntervalJoin, left: Delta, right: Delta) -> Delta:
        return self._bilinear(n, left, right, lambda a, b: batch.interval_join(a, b, n))

    # -- what shares a key with the change ---------------------------------

    def touched(self, n: p.Node, deltas: list[Delta], keys: list[list[str]], fn: Callable, whole: bool = False, gave: bool = False, live: Column | None = None) -> Delta:
        """fn over the rows whose keys a change touches, after and before.  keys: for each input its columns, in the same order.

        With `gave`, what fn gave before is kept, by the keys of the one input, and not computed again.
        """
        touched = None
        if not whole and any(d is not None for d in deltas):
            names = [f"_t{i}" for i in range(len(keys[0]))]
            parts = [d.select(*[batch.col(k).alias(t) for k, t in zip(ks, names, strict=True)]) for d, ks in zip(deltas, keys, strict=True) if d is not None]
            touched = self.version.share(reduce(DataFrame.unionAll, parts).distinct())
        held = [self.hold(n, side, d, touched, None if whole else ks) for side, d, ks in zip(("left", "right"), deltas, keys, strict=False)]
        if any(new is None for _, new in held) or all(d is None for d in deltas):
            return None
        bag = lambda df: z.expand(z.checked(z.consolidate(df), n.id))
        new = [bag(s) for _, s in held]
        if gave:
            return self._instead(n, z.weighted(fn(*new)), None if whole else touched, [] if whole else keys[0], live)
        old = [bag(s if s is not None else t.limit(0)) for s, t in held]
        return self.settle(n, z.add([z.weighted(fn(*new)), z.negate(z.weighted(fn(*old)))]))

    def on_distinct(self, n: p.Distinct, delta: Delta) -> Delta:
        return None if delta is None else self.touched(n, [delta], [z.values(delta)], DataFrame.distinct)

    def on_setop(self, n: p.SetOp, left: Delta, right: Delta) -> Delta:
        if n.mode == "union_all":
            # By position; the first push fixes the names.
            if left is None or right is None:
                name = f"{n.id}.names"
                held = self.store.read(name)
                return left if left is not None else None if right is None else right.toDF(*held.columns)
            if not self.store.version:
                self.version.write(f"{n.id}.names", left.limit(0))
            return left.unionAll(right.toDF(*left.columns))
        ref = left if left is not None else self.store.read(f"{n.id}.left")
        if ref is None:
            return None
        right = None if right is None else right.toDF(*ref.columns)
        cols = z.values(ref)
        return self.touched(n, [left, right], [cols, cols], lambda a, b: batch.set_op(a, b, n.mode))

    def on_over(self, n: p.Over, delta: Delta) -> Delta:
        return self.touched(n, [delta], [list(n.partition)], lambda df: batch.over(df, n.outputs), whole=not n.partition) if delta is not None else None

    def on_topn(self, n: p.TopN, delta: Delta) -> Delta:
        if delta is None:
            return None
        fn = lambda df: batch.top_n(df, n.order, n.limit, n.partition)
        keys, name = list(n.partition), f"{n.id}.gave"
        held = self.store.read(name)
        if held is not None:
            delta = self.version.share(z.consolidate(delta))
            if delta.where(F.col(z.WEIGHT) < 0).isEmpty():
                # Rows that only come can push rows out of what is shown, and nothing else of the state matters.
                self.version.append(f"{n.id}.left", delta, z.consolidate, keys or None)
                touched = delta.select(*[batch.col(k) for k in keys]).distinct() if keys else None
                shown = z.consolidate(z.same_key(held, touched, keys) if keys else held)
                return self._instead(n, z.weighted(fn(z.expand(z.add([shown, delta])))), touched, keys)
        return self.touched(n, [delta], [keys], fn, whole=not keys, gave=True)

    # -- aggregates -------------------------------------------------------

    def on_aggregate(self, n: p.Aggregate, delta: Delta) -> Delta:
        if delta is None:
            return None
        if n.aggregates and not any(a.function == "string_agg" for a in n.aggregates):
            return self.running(n, delta, n.keys, n.aggregates)
        whole = not n.keys
        return self.touched(n, [delta], [list(n.keys)], lambda df: batch.aggregate(df, n.keys, n.aggregates), whole=whole, gave=True)

    def running(self, n: p.Node, delta: DataFrame, keys: tuple[str, ...], aggregates: tuple[p.Agg, ...], live: Column | None = None) -> DataFrame:
        """Aggregates per group from sums where they are exact, and else from the values that a group has.

        Groups that reach 0 rows go, but for the one group of a global aggregate.  With `live`, a condition on the
        keys, state of groups for which it is false is given up.
        """
        kinds = delta.schema
        exact = lambda a: a.column is None or a.function == "count" or isinstance(kinds[a.column].dataType, EXACT.get(a.function, ()))
        sums, rest = [a for a in aggregates if exact(a)], list(dict.fromkeys(a.column for a in aggregates if not exact(a)))
        if len(rest) == 1:
            moved, shown, touched = self._counted(n, delta, keys, sums, rest[0], [a for a in aggregates if not exact(a)], live)
        else:
            moved, shown, touched = self._sums(n, delta, keys, sums, live)
            for j, column in enumerate(rest):
                own = [a for a in aggregates if a.column == column and not exact(a)]
                more = self._values(f"{n.id}.values{j}", self._change(delta, [*keys], [], column), touched, keys, own, live)
                if not keys:
                    moved = moved.crossJoin(F.broadcast(more))  # a row each
                    continue
                more = more.toDF(*[f"_j{i}" for i in range(len(keys))], *more.columns[len(keys) :])
                on = [moved[f"`{k}`"].eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)]
                moved = moved.join(more, reduce(lambda a, b: a & b, on)).drop(*[f"_j{i}" for i in range(len(keys))])
        by = [batch.col(k) for k in keys]
        pick = lambda prefix: [(shown(prefix, a) if exact(a) else F.col(f"_now_{a.output}")).alias(a.output) for a in aggregates]
        # A global aggregate is there whatever it counts; that it is read is what finds a count below 0.
        exists = F.col("_n") > 0 if keys else F.coalesce(F.col("_n"), F.lit(0)) >= 0
        if rest:
            plus = moved.where(exists).select(*by, *pick(""), F.lit(1).cast("long").alias(z.WEIGHT))
            return self._instead(n, plus, touched, list(keys), live)
        existed = F.coalesce(F.col("_old_n"), F.lit(0)) > 0 if keys else F.lit(self.store.read(f"{n.id}.sums") is not None)
        if not aggregates:
            weight = exists.cast("long") - existed.cast("long")
            return self._apart(n, moved.select(*by, weight.alias(z.WEIGHT)).where(F.col(z.WEIGHT) != 0))
        side = lambda there, prefix, w: F.struct(there.alias("_there"), F.struct(*pick(prefix)).alias("_row"), F.lit(w).cast("long").alias(z.WEIGHT))
        both = moved.select(*by, F.array(side(exists, "", 1), side(existed, "_old", -1)).alias("_both"))
        now, was = F.col("_both")[0], F.col("_both")[1]
        moves = ~(now["_there"] & was["_there"] & now["_row"].eqNullSafe(was["_row"]))
        each = both.where(moves).select(*by, F.explode("_both").alias("_one")).where("_one._there")
        return self._apart(n, each.select(*by, *[F.col("_one._row")[a.output].alias(a.output) for a in aggregates], F.col(f"_one.{z.WEIGHT}")))

    def _apart(self, n: p.Node, delta: DataFrame) -> DataFrame:
        """settle() for rows that are consolidated already."""
        return delta if self.graph._once[n.id] else self.version.share(delta)

    def _instead(self, n: p.Node, new: DataFrame, touched: DataFrame, keys: list[str], live: Column | None = None) -> DataFrame:
        """The change from what was shown of the touched groups to what is now.

        What was shown is kept and not computed again: floating-point numbers need not come out the same twice.
        """
        name = f"{n.id}.gave"
        old = self.store.read(name, touched=touched if keys else None, keys=keys)
        if old is not None and keys:
            old = z.same_key(old, touched, keys)
        out = self.version.share(z.difference(new, old))
        self._add(name, out, z.consolidate, live, keys)
        return out

    def _add(self, name: str, change: DataFrame, fold: Callable, live: Column | None, keys: Sequence[str] = ()) -> None:
        """Add a change to state that adds up; with `live`, what is not goes at once."""
        if live is None:
            self.version.append(name, change, fold, list(keys) or None)
        else:
            self.version.write(name, fold(z.add([self.store.read(name), change])).where(live))

    def _change(self, delta: DataFrame, keys: list[str], aggregates: list[p.Agg], value: str | None = None) -> DataFrame:
        """Counts and sums of a change by group, and by the value of a column, _v, if one is named."""
        w = F.col(z.WEIGHT)
        sums = [F.sum(w).alias("_n")]
        for i, a in enumerate(aggregates):
            if a.column is None:
                continue
            c = batch.col(a.column)
            sums.append(F.sum(F.when(c.isNotNull(), w)).alias(f"_c{i}"))
            wide = c.cast("decimal(20,0)") if isinstance(delta.schema[a.column].dataType, IntegralType) else c
            if a.function != "count":
                sums.append(F.sum((wide if a.function != "sum" else c) * w).alias(f"_s{i}"))
            if a.function == "stddev_samp":
                sums.append(F.sum(c.cast("long") * c.cast("long") * w.cast("decimal(18,0)")).alias(f"_q{i}"))
        by = [batch.col(k) for k in keys] + ([batch.col(value).alias("_v")] if value else [])
        return delta.groupBy(*by).agg(*sums) if by else delta.agg(*sums)

    def _sums(self, n: p.Node, delta: DataFrame, keys: tuple[str, ...], aggregates: list[p.Agg], live: Column | None) -> tuple[DataFrame, Callable, DataFrame]:
        """(touched groups with sums after and before, expression of an aggregate over them, the touched groups)."""
        by = [batch.col(k) for k in keys]
        name = f"{n.id}.sums"
        change = self.version.share(self._change(delta, [*keys], aggregates))
        old = self.store.read(name, touched=change.select(*by), keys=list(keys)) if keys else self.store.read(name)
        kinds = change.schema
        fields = [c for c in change.columns if c not in keys]
        total = [F.sum(f"`{f}`").cast(kinds[f].dataType).alias(f) for f in fields]
        # Sums add up, so the change itself is what the state takes.
        self._add(name, change, lambda df: (df.groupBy(*by).agg(*total).where("_n <> 0") if keys else df.agg(*total)), live, keys)
        both = change.withColumn("_before", F.lit(0))
        if old is not None:
            both = both.unionByName((z.same_key(old, change.select(*by), list(keys)) if keys else old).withColumn("_before", F.lit(1)))
        before = [F.sum(F.when(F.col("_before") == 1, F.col(f"`{f}`"))).alias(f"_old{f}") for f in fields]
        moved = both.groupBy(*by).agg(*total, *before) if keys else both.agg(*total, *before)
        return self._no_less(n, moved), self._shown(kinds, aggregates), change.select(*by)

    def _no_less(self, n: p.Node, moved: DataFrame) -> DataFrame:
        """moved, which must have no group of less than 0 rows once _n is read."""
        bad = F.raise_error(F.lit(f"{n.id}: a change takes away a row that is not there")).cast("long")
        return moved.withColumn("_n", F.when(F.col("_n") < 0, bad).otherwise(F.col("_n")))

    def _shown(self, kinds: StructType, aggregates: list[p.Agg]) -> Callable:
        """The expression of an aggregate over sums, whose names have the prefix."""
        place = {a.output: i for i, a in enumerate(aggregates)}

        def shown(prefix: str, a: p.Agg) -> Column:
            i = place[a.output]
            count, total, square = (F.col(f"{prefix}_{x}{i}") for x in "csq")
            if a.function == "count":
                return F.coalesce(count if a.column else F.col(f"{prefix}_n"), F.lit(0)).cast("long")
            if a.function == "sum":
                return F.when(count > 0, total.cast(kinds[f"_s{i}"].dataType))
            if a.function == "avg":
                return F.when(count > 0, total.cast("double") / count)
            # n * sum of squares - square of the sum, in whole numbers; in doubles only beyond 38 digits.
            names = f"{prefix}_c{i}", f"{prefix}_q{i}", f"{prefix}_s{i}"
            whole = F.expr("try_subtract(try_multiply({0}, cast({1} as decimal(38,0))), try_multiply(cast({2} as decimal(38,0)), cast({2} as decimal(38,0))))".format(*names))
            spread = F.coalesce(whole.cast("double"), count * square.cast("double") - total.cast("double") * total.cast("double"))
            return F.when(count > 1, F.sqrt(F.greatest(F.lit(0.0), spread) / F.when(count > 1, count * (count - 1.0))))

        return shown

    def _counted(self, n: p.Node, delta: DataFrame, keys: tuple[str, ...], sums: list[p.Agg], column: str, rest: list[p.Agg], live: Column | None) -> tuple[DataFrame, Callable, DataFrame]:
        """Like _sums() as they are now, with aggregates of one column's values: sums are kept by group and value, in one state."""
        by, name = [batch.col(k) for k in keys], f"{n.id}.values"
        change = self.version.share(self._change(delta, [*keys], sums, column))
        kinds = change.schema
        fields = [c for c in change.columns if c not in keys and c != "_v"]
        total = [F.sum(f"`{f}`").cast(kinds[f].dataType).alias(f) for f in fields]
        touched = change.select(*by).distinct()
        old = self.store.read(name, touched=touched, keys=list(keys)) if keys else self.store.read(name)
        self._add(name, change, lambda df: df.groupBy(*by, "_v").agg(*total).where("_n <> 0"), live, keys)
        if old is not None:
            change = change.unionByName(z.same_key(old, touched, list(keys)) if keys else old)
        w = F.when(F.col("_v").isNotNull() & (F.col("_n") > 0), F.col("_n"))
        moved = self._of_values(change.groupBy(*by, "_v").agg(*total).withColumn("_w", w), keys, rest, total)
        return self._no_less(n, moved), self._shown(kinds, sums), touched

    def _values(self, name: str, change: DataFrame, keyed: DataFrame, keys: tuple[str, ...], aggregates: list[p.Agg], live: Column | None) -> DataFrame:
        """Aggregates of touched groups as they are now, from how often each group has each value."""
        by = [batch.col(k) for k in keys]
        fold = lambda df: df.groupBy(*by, "_v").agg(F.sum("_w").alias("_w")).where("_w <> 0")
        change = change.select(*by, "_v", F.col("_n").alias("_w"))
        old = self.store.read(name, touched=keyed, keys=list(keys)) if keys else self.store.read(name)
        self._add(name, change, fold, live, keys)
        both = change
        if old is not None:
            both = both.unionByName(z.same_key(old, keyed, list(keys)) if keys else old)
        w = F.when(F.col("_v").isNotNull() & (F.col("_w") > 0), F.col("_w"))
        return self._of_values(both.groupBy(*by, "_v").agg(F.sum("_w").alias("_w")).withColumn("_w", w), keys, aggregates)

    def _of_values(self, both: DataFrame, keys: tuple[str, ...], aggregates: list[p.Agg], more: Sequence[Column] = ()) -> DataFrame:
        """Aggregates of groups from how often, _w, each has a value, _v; more are computed beside."""
        by = [batch.col(k) for k in keys]
        number = F.col("_v").cast("double")
        if any(a.function == "stddev_samp" for a in aggregates):
            group = Window.partitionBy(*by) if keys else Window.partitionBy(F.lit(0))
            both = both.withColumn("_mean", F.sum(number * F.col("_w")).over(group) / F.sum("_w").over(group))

        def made(a: p.Agg) -> Column:
            w, value = F.col("_w"), F.when(F.col("_w").isNotNull(), F.col("_v"))
            if a.function in ("min", "max"):
                return getattr(F, a.function)(value)
            if a.function == "count_distinct":
                return F.count(value)
            if a.function == "sum":
                return F.sum(value * w)
            if a.function == "avg":
                return F.sum(number * w) / F.sum(w)
            apart = number - F.col("_mean")
            return F.when(F.sum(w) > 1, F.sqrt(F.sum(apart * apart * w) / F.nullif(F.sum(w) - 1, F.lit(0))))

        out = [*more, *[made(a).alias(f"_now_{a.output}") for a in aggregates]]
        return both.groupBy(*by).agg(*out) if keys else both.agg(*out)

    # -- time -------------------------------------------------------------

    def _greatest_time(self, n: p.Node, delta: DataFrame, column: str) -> DataFrame:
        """One row (_max): the greatest time of all inserted rows, this batch included."""
        name = f"{n.id}.time"
        seen = delta.where(F.col(z.WEIGHT) > 0).select(batch.col(column).cast("long").alias("_max"))
        old = self.store.read(name)
        top = (seen if old is None else seen.unionAll(old)).agg(F.max("_max").alias("_max"))
        return self.version.write(name, self.version.share(top))

    def _late(self, n: p.Node, delta: DataFrame, column: str, lateness: int) -> DataFrame:
        """delta with _late; the one-row side is broadcast."""
        top = self._greatest_time(n, delta, column)
        late = F.coalesce(batch.col(column) < F.col("_max") - lateness, F.lit(False)).cast("int")
        return delta.crossJoin(F.broadcast(top)).withColumn("_late", late).drop("_max")

    def on_watermark(self, n: p.Watermark, delta: Delta) -> Delta:
        if delta is None:
            return None
        marked = self._late(n, delta, n.time, n.lateness)
        if n.policy == "side":
            return self.settle(n, marked)
        return self.settle(n, (marked.where("_late = 0") if n.policy == "drop" else marked).drop("_late"))

    def on_timewindow(self, n: p.TimeWindow, delta: Delta) -> Delta:
        if delta is None:
            return None
        if n.late_policy == "drop" or n.ttl is not None:
            marked = self._late(n, delta, n.time, n.lateness)
            delta = self.version.share((marked.where("_late = 0") if n.late_policy == "drop" else marked).drop("_late"))
        delta = delta.where(batch.col(n.time).isNotNull())
        bound = self._bound(n) if n.ttl is not None else None
        if n.kind == "session":
            live = None if bound is None else F.coalesce(F.col("w_end") > bound, F.lit(True))
            out = self.touched(n, [delta], [list(n.keys)], lambda df: batch.sessions(df, n), whole=not n.keys, gave=True, live=live)
            if bound is not None:
                held = z.add([self.store.read(f"{n.id}.left"), delta])
                self.version.write(f"{n.id}.left", batch.with_session_end(z.consolidate(held), n).where(F.coalesce(F.col("_end") > bound, F.lit(True))).drop("_end"))
        else:
            rows, keys = batch.windows_of(delta, n), (*n.keys, "w_start", "w_end")
            live = None if bound is None else F.coalesce(F.col("w_end") > bound, F.lit(True))
            if live is not None:
                rows = rows.where(live)  # a window that has been given up does not come back
            if n.aggregates and not any(a.function == "string_agg" for a in n.aggregates):
                out = self.running(n, rows, keys, n.aggregates, live)
            else:
                out = self.touched(n, [rows], [list(keys)], lambda df: batch.aggregate(df, keys, n.aggregates), gave=True, live=live)
                if live is not None:
                    self.version.write(f"{n.id}.left", z.consolidate(z.add([self.store.read(f"{n.id}.left"), rows])).where(live))
        return out if bound is None else self._expire(n, out, bound)

    def _bound(self, n: p.TimeWindow) -> Column:
        """Windows that end by then are given up: the greatest time less lateness and ttl, which is one number."""
        top = self.version.pending[f"{n.id}.time"].first()["_max"]
        return F.lit(None).cast("long") if top is None else F.lit(top - n.lateness - n.ttl).cast("long")

    def _expire(self, n: p.TimeWindow, out: DataFrame, bound: Column) -> DataFrame:
        """The change of what is shown once windows that are given up are taken out.  What is shown is all that is live."""
        name = f"{n.id}.shown"
        old = self.store.read(name)
        kept = z.consolidate(z.add([old, out])).where(F.coalesce(F.col("w_end") > bound, F.lit(True)))
        kept = self.version.write(name, self.version.share(kept))
        return self.settle(n, z.difference(kept, old) if old is not None else kept)

    # -- whole inputs -----------------------------------------------------

    def _whole(self, n: p.Recompute | p.Recursive, deltas: tuple[Delta, ...], fn: Callable) -> Delta:
        held = [self.hold(n, t, d) for t, d in zip(n.tables, deltas, strict=True)]
        if any(new is None for _, new in held) or all(d is None for d in deltas):
            return None
        new = fn([z.expand(z.checked(z.consolidate(new), n.id)) for _, new in held])
        name = f"{n.id}.result"
        old = self.store.read(name)
        now = self.version.write(name, self.version.share(z.consolidate(z.weighted(new))))
        return self.settle(n, now if old is None else z.difference(now, old))

    def on_recompute(self, n: p.Recompute, *deltas: Delta) -> Delta:
        return self._whole(n, deltas, lambda frames: self.spark.sql(n.sql, **_named(n.tables, frames)))

    def on_recursive(self, n: p.Recursive, *deltas: Delta) -> Delta:
        return self._whole(n, deltas, lambda frames: fixpoint(self.spark, n, frames, self.store.scratch))


def _named(tables: tuple[str, ...], frames: list[DataFrame]) -> dict[str, DataFrame]:
    return dict(zip(tables, frames, strict=True))


def fixpoint(spark: SparkSession, n: p.Recursive, frames: list[DataFrame], write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of seed_sql and of step_sql on what the last round found, until a round finds nothing new.

    seed_sql and step_sql name tables in braces, as in spark.sql().  Each
    round is written, so the plan stays as small as one round.
    """
    named = _named(n.tables, frames)
    new = spark.sql(n.seed_sql, **named).toDF(*n.columns)
    new = write(new.distinct() if n.distinct else new)
    total = new
    for _ in range(n.max_rounds):
        if new.isEmpty():
            return total
        new = spark.sql(n.step_sql, **named, _found=new).toDF(*n.columns)
        new = write(new.distinct().subtract(total) if n.distinct else new)
        total = write(total.unionAll(new))
    if new.isEmpty():
        return total
    raise p.PlanError(f"{n.id}: the recursion goes on after {n.max_rounds} rounds")
