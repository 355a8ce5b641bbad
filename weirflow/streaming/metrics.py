"""What runs, in numbers: text for a scraper, timed explanations, and a trace of recent events."""

from __future__ import annotations

import time
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weirflow.operators import zset as z
from weirflow.plans.graph import StreamGraph
from weirflow.streaming.runner import Job


def scraped(jobs: list[Job]) -> str:
    """Counters and the last latency of jobs in the text format that metric scrapers read."""
    lines = ["# TYPE weirflow_batches_total counter", "# TYPE weirflow_rows_total counter", "# TYPE weirflow_batch_seconds gauge"]
    for j in jobs:
        lines.append(f'weirflow_batches_total{{job="{j.name}"}} {j.batches}')
        lines.append(f'weirflow_rows_total{{job="{j.name}"}} {j.rows_in}')
        lines.append(f'weirflow_batch_seconds{{job="{j.name}"}} {j.seconds[-1] if j.seconds else 0:.6f}')
        lines.append(f'weirflow_paused{{job="{j.name}"}} {int(j.paused)}')
    return "\n".join(lines) + "\n"


def explain_analyze(graph: StreamGraph, deltas: dict[str, DataFrame]) -> str:
    """The plan with the seconds of a push, the rows in and out, and the rows of state that each node holds."""
    began = time.monotonic()
    delta = graph.push(deltas)
    took = time.monotonic() - began
    lines = []
    for line in graph.plan.explain().split("\n"):
        node = line.split(":")[0]
        held = {n.split(".", 1)[1]: graph.store.read(n).count() for n in graph.store.manifest["paths"] if n.startswith(f"{node}.")}
        lines.append(line + (f" state={held}" if held else ""))
    rows_in = {k: z.weighted(d).count() for k, d in deltas.items()}
    return "\n".join([*lines, f"push: {took:.3f} s, in {rows_in}, out {delta.count()}"])


@dataclass
class Trace:
    """The last events, each with its stage and seconds since the one before."""

    size: int = 1024
    events: deque = field(init=False)

    def __post_init__(self) -> None:
        self.events = deque(maxlen=self.size)

    def mark(self, stage: str, **facts: object) -> None:
        now = time.monotonic()
        since = now - self.events[-1]["at"] if self.events else 0.0
        self.events.append({"at": now, "stage": stage, "seconds": since, **facts})

    def slowest(self) -> dict | None:
        return max(self.events, key=lambda e: e["seconds"], default=None)
