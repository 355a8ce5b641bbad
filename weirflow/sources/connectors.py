"""Sources and sinks by name, and schema changes on the way.

Sinks take a batch under an id and apply it once, however often it is sent:
a ledger of ids is part of the target's own commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

from weirflow.operators import zset as z
from weirflow.plans.state import StateStore
from weirflow.sources import changelog
from weirflow.sources.folders import Folder


class UnsupportedConnector(LookupError):
    """No connector of that name and direction can be opened here."""


class UpsertSink:
    """A keyed target in a folder.  Weighted rows are applied by key: what is left at a positive weight is the row.

    A delivery writes what it changes: its rows, and the ones that they take the place of with weight -1.
    """

    def __init__(self, spark: SparkSession, keys: list[str], folder: str | None = None) -> None:
        self.keys, self.store = keys, StateStore(spark, f"sink:{','.join(keys)}", folder)

    def write(self, delivery: str, rows: DataFrame) -> bool:
        """False, without effect, if the delivery was applied before."""
        done = self.store.read("deliveries")
        if done is not None and not done.where(F.col("id") == delivery).isEmpty():
            return False
        rows = z.weighted(rows)
        new = rows.where(F.col(z.WEIGHT) > 0).withColumn(z.WEIGHT, F.lit(1).cast("long"))
        keys = rows.select(*[F.col(f"`{k}`") for k in self.keys]).distinct()
        held = self.store.read("rows", touched=keys, keys=self.keys)
        if held is not None:
            there = z.consolidate(z.same_key(held, keys, self.keys))
            new = z.difference(new, there)
        spark = rows.sparkSession
        with self.store.next_version() as v:
            v.append("rows", new, z.consolidate, self.keys)
            one = spark.range(1).select(F.lit(delivery).alias("id"), F.lit(v.number).cast("long").alias("version"))
            v.append("deliveries", one, lambda df: df)
        return True

    def read(self) -> DataFrame | None:
        held = self.store.read("rows")
        return None if held is None else z.expand(z.consolidate(held))

    def count(self) -> int:
        held = self.read()
        return 0 if held is None else held.count()

    def frontier(self) -> int:
        """The last version that is visible; versions are contiguous."""
        return self.store.version


class AppendSink:
    """Deliveries as subfolders of a folder, each with its id; one that comes again is left."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, Folder(spark, folder)

    def write(self, delivery: str, rows: DataFrame) -> bool:
        name = f"delivery_id={delivery}"
        if self.folder.exists(name):
            return False
        staged = f"_staged_{uuid.uuid4().hex}"
        rows.write.parquet(self.folder.path(staged))
        return self.folder.rename(staged, name)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder.root)

    def count(self) -> int:
        return self.read().count() if self.folder.names() else 0


class FormatSink:
    """A table of a format whose Spark data source must be on the class path, keyed by delivery."""

    def __init__(self, spark: SparkSession, format: str, options: dict[str, str]) -> None:
        self.spark, self.format, self.options = spark, format, options

    def write(self, delivery: str, rows: DataFrame) -> bool:
        try:
            held = self.spark.read.format(self.format).options(**self.options).load()
            if not held.where(F.col("delivery_id") == delivery).isEmpty():
                return False
            rows.withColumn("delivery_id", F.lit(delivery)).write.format(self.format).options(**self.options).mode("append").save()
        except (PySparkException, Py4JJavaError) as e:
            said = e if isinstance(e, PySparkException) else e.java_exception
            if getattr(said, "getCondition", lambda: None)() == "DATA_SOURCE_NOT_FOUND":
                raise UnsupportedConnector(f"the data source {self.format} is not on the class path") from e
            raise
        return True


@dataclass
class Registry:
    """Connectors by (name, direction)."""

    makers: dict[tuple[str, str], Callable] = field(default_factory=dict)

    def register(self, name: str, direction: str, maker: Callable) -> None:
        self.makers[name, direction] = maker

    def open(self, name: str, direction: str, spark: SparkSession, **options: object) -> object:
        if (name, direction) not in self.makers:
            raise UnsupportedConnector(f"there is no {direction} connector {name}")
        return self.makers[name, direction](spark, **options)


def _reader(format: str) -> Callable:
    def read(spark: SparkSession, path: str | None = None, schema: StructType | None = None, **options: object) -> DataFrame:
        r = spark.read.format(format).options(**options)
        return (r.schema(schema) if schema else r).load(path)

    return read


def _stream(format: str) -> Callable:
    def read(spark: SparkSession, path: str | None = None, schema: StructType | None = None, **options: object) -> DataFrame:
        r = spark.readStream.format(format).options(**options)
        return (r.schema(schema) if schema else r).load(path)

    return read


def default_registry() -> Registry:
    """Files and JDBC both ways, change logs, and the table formats and brokers whose packages a cluster may have."""
    out = Registry()
    for f in ("parquet", "csv", "json", "orc", "text", "jdbc"):
        out.register(f, "source", _reader(f))
    for f in ("parquet", "csv", "json", "orc", "text", "kafka", "rate"):
        out.register(f, "stream", _stream(f))
    out.register("changelog", "source", lambda spark, path: changelog.ChangeLog(spark, path))
    out.register("upsert", "sink", lambda spark, keys, path=None: UpsertSink(spark, keys, path))
    out.register("append", "sink", lambda spark, path: AppendSink(spark, path))
    for f in ("iceberg", "paimon", "starrocks", "doris", "clickhouse", "jdbc", "kafka"):
        out.register(f, "sink", lambda spark, f=f, **options: FormatSink(spark, f, options))
    return out


# -- schema changes -----------------------------------------------------------

_WIDER: list[type[DataType]] = [ByteType, ShortType, IntegerType, LongType]


def _widens(a: DataType, b: DataType) -> bool:
    if type(a) in _WIDER and type(b) in _WIDER:
        return _WIDER.index(type(b)) > _WIDER.index(type(a))
    if isinstance(a, DecimalType) and isinstance(b, DecimalType):
        return b.scale >= a.scale and b.precision - b.scale >= a.precision - a.scale
    return isinstance(a, FloatType) and isinstance(b, DoubleType)


def schema_change(old: StructType, new: StructType) -> tuple[str, list[str]]:
    """("same" | "propagate" | "rebuild", reasons).  New nullable columns and wider types go through; all else rebuilds."""
    had, has = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}
    reasons, rebuild = [], False
    for n, f in has.items():
        if n not in had:
            reasons.append(f"{n}: {'new' if f.nullable else 'new, not null'}")
            rebuild |= not f.nullable
        elif f.dataType != had[n].dataType:
            wide = _widens(had[n].dataType, f.dataType)
            reasons.append(f"{n}: {'wider' if wide else 'another type'}")
            rebuild |= not wide
        elif had[n].nullable and not f.nullable:
            reasons.append(f"{n}: no longer null")
            rebuild = True
    for n in had.keys() - has.keys():
        reasons.append(f"{n}: gone")
        rebuild = True
    return ("rebuild" if rebuild else "propagate" if reasons else "same"), reasons


def propagate(table: DataFrame, schema: StructType) -> DataFrame:
    """The table in the new schema, with nulls for new columns; no row is dropped."""
    verdict, reasons = schema_change(table.schema, schema)
    if verdict == "rebuild":
        raise ValueError(f"the table must be rebuilt: {', '.join(reasons)}")
    return table.select(*[(F.col(f"`{f.name}`") if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def pair_id(*parts: str) -> Column:
    """A key for a pair of rows from their primary keys; lengths are part of it, so no two pairs share one by joining up."""
    texts = [F.coalesce(F.col(f"`{p}`").cast("string"), F.lit("\0null")) for p in parts]
    return F.sha2(F.concat_ws("|", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)
