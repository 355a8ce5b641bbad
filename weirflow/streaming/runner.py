"""Plans over Structured Streaming, chains of views, and jobs."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirflow.operators import zset as z
from weirflow.plans import nodes as p
from weirflow.plans.frontend import Sources, compile_sql
from weirflow.plans.graph import StreamGraph
from weirflow.sources.connectors import UpsertSink


class Epochs:
    """Which batch ids a graph has applied, kept with its state, so that a batch that Spark repeats is not applied twice."""

    def __init__(self, graph: StreamGraph) -> None:
        self.graph = graph

    def last(self) -> int:
        return self.graph.store.manifest["extra"].get("epoch", -1)

    def run(self, epoch: int, deltas: dict[str, DataFrame]) -> DataFrame | None:
        """The change of the result; None if the epoch was applied.  One may not be left out."""
        if epoch <= self.last():
            return None
        if self.last() >= 0 and epoch != self.last() + 1:
            raise p.PlanError(f"epoch {epoch} does not follow {self.last()}")
        # The epoch goes into the same manifest as the state, so both are in force or neither is; a savepoint has its own.
        return self.graph.push(deltas, epoch=epoch)


def start_stream(
    graph: StreamGraph,
    streams: dict[str, DataFrame],
    checkpoint: str,
    sink: UpsertSink | Callable[[int, DataFrame], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run a plan on streaming DataFrames.  Several inputs are one stream, whose rows say which input they are for."""
    epochs = Epochs(graph)
    if len(streams) == 1:
        (name, source), = streams.items()
        split = lambda df: {name: df}
    else:
        parts = [df.select(F.lit(k).alias("_input"), F.struct("*").alias(f"_{k}")) for k, df in streams.items()]
        source = parts[0]
        for other in parts[1:]:
            source = source.unionByName(other, allowMissingColumns=True)
        split = lambda df: {k: df.where(F.col("_input") == k).select(f"_{k}.*") for k in streams}

    def each(batch: DataFrame, epoch: int) -> None:
        delta = epochs.run(epoch, split(batch))
        if sink is None:
            return
        if delta is None:
            delta = graph.store.read("delta")  # applied before the crash, maybe not delivered
        sink.write(str(epoch), delta) if isinstance(sink, UpsertSink) else sink(epoch, delta)

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class MaterializedView:
    """A view over another: both take each batch, and the upper one may not fall behind or run ahead."""

    def __init__(self, lower: StreamGraph, upper: StreamGraph, input_name: str) -> None:
        self.lower, self.upper, self.input_name = lower, upper, input_name

    def push(self, deltas: dict[str, DataFrame], watermark: int) -> DataFrame:
        if self.lower.version != self.upper.version or watermark != self.lower.version + 1:
            raise p.PlanError(f"watermark {watermark} does not follow {self.lower.version} and {self.upper.version}")
        return self.upper.push({self.input_name: self.lower.push(deltas)})


def batch_limit(rate: float, low: float, high: float, least: int, most: int) -> int:
    """Rows to take at once: `least` up to the low rate, `most` from the high one, and in line between."""
    if rate <= low:
        return least
    return most if rate >= high else round(least + (most - least) * (rate - low) / (high - low))


@dataclass
class Job:
    """A query that runs under a name, with the verbs of an operator's console."""

    name: str
    graph: StreamGraph
    paused: bool = False
    batches: int = 0
    rows_in: int = 0
    seconds: list[float] = field(default_factory=list)

    @classmethod
    def from_sql(cls, name: str, spark: SparkSession, sql: str, sources: Sources, folder: str | None = None, **options: object) -> Job:
        return cls(name, StreamGraph(compile_sql(spark, sql, sources, **options), spark, folder))

    def push(self, deltas: dict[str, DataFrame]) -> DataFrame:
        if self.paused:
            raise p.PlanError(f"{self.name} is paused")
        began = time.monotonic()
        # Counted where the push reads them, so that an input is computed once.
        held = {k: d.persist() for k, d in deltas.items()}
        try:
            self.rows_in += sum(d.count() for d in held.values())
            out = self.graph.push(held)
        finally:
            for d in held.values():
                d.unpersist()
        self.batches += 1
        self.seconds.append(time.monotonic() - began)
        return out

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def checkpoint_now(self, name: str = "checkpoint") -> None:
        self.graph.store.savepoint(name)

    def snapshot(self) -> DataFrame:
        return self.graph.result()


def verify(graph: StreamGraph, recomputed: DataFrame) -> None:
    """Raise unless the maintained result equals a recomputation."""
    apart = z.difference(z.weighted(recomputed.select(*z.values(graph.output()))), graph.output())
    if not apart.isEmpty():
        raise z.IntegrityError(f"the view differs from its recomputation in {apart.count()} rows")
