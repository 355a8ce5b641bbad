"""Change streams keyed by primary key, and what they do to tables.

A change row has the table's columns, `_sync_op` (0 upsert, 1 delete) and
`_sync_order`, which orders the changes of a key.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.operators import zset as z
from weirflow.plans.state import StateStore
from weirflow.sources.folders import Folder

OP, ORDER = "_sync_op", "_sync_order"
UPSERT, DELETE = 0, 1


def net_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key.  Equal orders of a key fall back on all columns."""
    rest = [F.col(f"`{c}`").desc_nulls_last() for c in changes.columns if c != ORDER]
    last = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(F.col(ORDER).desc(), *rest))
    return changes.withColumn("_last", last).where("_last = 1").drop("_last")


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(right[f"`{k}`"]) for k in keys])


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes: rows that none touches, and the upserts that are last for their key."""
    last = net_changes(changes, keys)
    stay = base.join(last.select(*keys), _on(base, last, keys), "left_anti")
    return stay.unionByName(last.where(F.col(OP) == UPSERT).select(*base.columns))


def missing_deletes(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose first change deletes what the table does not have."""
    order = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(ORDER)
    first = changes.withColumn("_n", F.row_number().over(order)).where((F.col("_n") == 1) & (F.col(OP) == DELETE))
    return first.join(base, _on(first, base, keys), "left_anti").select(*keys)


def change_delta(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """What the changes do to the table as weighted rows: the old row -1, the new one +1, nothing where both are equal."""
    last = net_changes(changes, keys)
    old = base.join(last.select(*keys), _on(base, last, keys), "left_semi")
    new = last.where(F.col(OP) == UPSERT).select(*base.columns)
    return z.difference(z.weighted(new), z.weighted(old))


class KeyedMirror:
    """The rows of a keyed table, and what change batches do to them as weighted rows, which is all that a batch writes."""

    def __init__(self, keys: list[str], spark: SparkSession, folder: str | None = None) -> None:
        self.keys, self.spark = keys, spark
        self.store = StateStore(spark, f"mirror:{','.join(keys)}", folder)

    def snapshot(self) -> DataFrame | None:
        held = self.store.read("rows")
        return None if held is None else z.expand(z.consolidate(held))

    def apply(self, changes: DataFrame) -> DataFrame:
        rows = changes.drop(OP, ORDER)
        keys = changes.select(*[F.col(f"`{k}`") for k in self.keys]).distinct()
        held = self.store.read("rows", touched=keys, keys=self.keys)
        with self.store.next_version() as v:
            # The touched rows alone, read once.
            base = rows.limit(0) if held is None else v.share(z.consolidate(z.same_key(held, keys, self.keys)).drop(z.WEIGHT))
            if not missing_deletes(base, changes, self.keys).isEmpty():
                raise z.IntegrityError("a change deletes a key that is not there")
            delta = v.share(change_delta(base, changes, self.keys))
            v.write("delta", delta)
            v.append("rows", delta, z.consolidate, self.keys)
        return self.store.read("delta")


def merge_snapshot(snapshot: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A table read while it changes: a snapshot row gives way to any change of its key, a delete too."""
    return apply_changes(snapshot, changes, keys)


# -- versioned tables ---------------------------------------------------------


def row_versions(changes: DataFrame, keys: list[str], commit: str = "commit_seq") -> DataFrame:
    """Rows with the commits [valid_from, valid_to) for which they held; a delete ends a row and leaves none."""
    per_commit = Window.partitionBy(*keys, commit).orderBy(F.col(ORDER).desc())
    last = changes.withColumn("_n", F.row_number().over(per_commit)).where("_n = 1").drop("_n")
    w = Window.partitionBy(*keys).orderBy(commit)
    spans = last.withColumn("valid_from", F.col(commit)).withColumn("valid_to", F.lead(commit).over(w))
    return spans.withColumn("deleted", F.col(OP) == DELETE).drop(OP, ORDER, commit)


def as_of(versions: DataFrame, commit: int) -> DataFrame:
    """The table as it was right after a commit."""
    held = (F.col("valid_from") <= commit) & (F.col("valid_to").isNull() | (F.col("valid_to") > commit)) & ~F.col("deleted")
    return versions.where(held).drop("valid_from", "valid_to", "deleted")


def retention_floor(applied: int, consumers: dict[str, int], pins: dict[str, int]) -> int:
    """The least commit that someone may still read."""
    return min([applied, *consumers.values(), *pins.values()])


def collectable(versions: DataFrame, floor: int) -> DataFrame:
    """Row versions that no read at the floor or later sees."""
    return versions.where((F.col("valid_to") <= floor) | (F.col("deleted") & (F.col("valid_from") < floor) & F.col("valid_to").isNotNull()))


class GapError(RuntimeError):
    """The log lacks a commit."""


class ChangeLog:
    """An append-only log of commits in a folder; a commit's rows are one subfolder, put in place by a rename."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, Folder(spark, folder)

    def commits(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.folder.names() if n.startswith("commit_seq="))

    def append(self, seq: int, changes: DataFrame) -> bool:
        """False if the commit is there, or another writer put it there first; an error if one before it is not."""
        held = self.commits()
        if seq in held:
            return False
        if held and seq != held[-1] + 1:
            raise GapError(f"commit {seq} does not follow {held[-1]}")
        staged = f"_staged_{uuid.uuid4().hex}"
        changes.write.parquet(self.folder.path(staged))
        return self.folder.rename(staged, f"commit_seq={seq}")

    def read(self, after: int = 0, upto: int | None = None) -> DataFrame:
        held = [c for c in self.commits() if c > after and (upto is None or c <= upto)]
        if not held:
            raise GapError(f"the log has nothing after {after}")
        if held[0] != after + 1 and after and after + 1 not in self.commits():
            raise GapError(f"commit {after + 1} is gone from the log")
        parts = [self.spark.read.parquet(self.folder.path(f"commit_seq={c}")).withColumn("commit_seq", F.lit(c).cast("long")) for c in held]
        return reduce(DataFrame.unionByName, parts)

    def drop_before(self, floor: int) -> None:
        for c in self.commits():
            if c < floor:
                self.folder.delete(f"commit_seq={c}")


def decode_lines(lines: DataFrame, column: str = "value", *more: str) -> DataFrame:
    """Lines of a logical-decoding text feed as (relation, op, fields): `table s.t: INSERT: id[int]:1 name[text]:'x'`."""
    head = r"^table ([^:]+): (INSERT|UPDATE|DELETE): ?(.*)$"
    body = F.regexp_extract(column, head, 3)
    pairs = F.regexp_extract_all(body, F.lit(r"""(\w+)\[[^\]]*\]:('(?:[^']|'')*'|\S+)"""), 1)
    held = F.regexp_extract_all(body, F.lit(r"""(\w+)\[[^\]]*\]:('(?:[^']|'')*'|\S+)"""), 2)
    clean = F.transform(
        held, lambda v: F.when(v == "null", F.lit(None).cast("string")).when(v.startswith("'"), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))).otherwise(v)
    )
    return lines.where(F.regexp_like(column, F.lit(head))).select(
        F.regexp_extract(column, head, 1).alias("relation"),
        F.when(F.regexp_extract(column, head, 2) == "DELETE", DELETE).otherwise(UPSERT).alias(OP),
        F.map_from_arrays(pairs, clean).alias("fields"),
        *more,
    )


def decoded_changes(lines: DataFrame, relation: str, schema: str, order: str, column: str = "value") -> DataFrame:
    """The changes of one table in a logical-decoding feed, typed by a schema in DDL; `order` is the feed's own sequence."""
    said = decode_lines(lines.select(F.col(column).alias("value"), F.col(order).alias("_order")), "value", "_order")
    fields = lines.sparkSession.createDataFrame([], schema).schema.fields
    typed = [F.try_element_at("fields", F.lit(f.name)).cast(f.dataType).alias(f.name) for f in fields]
    return said.where(F.col("relation") == relation).select(*typed, OP, F.col("_order").cast("long").alias(ORDER))


def snapshot_rows(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    r"""Rows of a text snapshot: fields between tabs, \N for null, and backslashes before tabs, line ends and themselves."""
    options = {"sep": "\t", "nullValue": "\\N", "quote": "\0", "escape": "\0", "mode": "FAILFAST"}
    plain = ", ".join(f"`{f.name}` string" for f in lines.sparkSession.createDataFrame([], schema).schema.fields)
    fields = lines.sparkSession.createDataFrame([], schema).schema.fields
    # Escaped backslashes stand aside first, so that a letter after one is not taken for an escape.
    held = F.from_csv(F.replace(F.col(column), F.lit("\\\\"), F.lit("\1")), plain, options)

    def plain_text(c: Column) -> Column:
        for said, means in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\1", "\\")):
            c = F.replace(c, F.lit(said), F.lit(means))
        return c

    return lines.select(held.alias("r")).select(*[plain_text(F.col(f"r.`{f.name}`")).cast(f.dataType).alias(f.name) for f in fields])


def unapplied(changes: DataFrame, applied: DataFrame, identity: tuple[str, ...] = ("server", "gtid")) -> DataFrame:
    """Changes of transactions that have not been applied, once each."""
    cols = list(identity)
    return z.same_key(changes, changes.select(*cols).distinct().join(applied.select(*cols).distinct(), cols, "left_anti"), cols)
