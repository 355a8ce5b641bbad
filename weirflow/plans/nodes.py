"""Plans: a list of nodes, each after its inputs, with canonical JSON and an identity.

Columns are referred to by name and expressions are Spark SQL text, so a plan
is data: it can be stored, compared and explained without a session.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import ClassVar

#: Aggregate functions, and whether a running sum is enough to keep them.
AGGREGATES = {"count": True, "sum": True, "avg": True, "stddev_samp": True, "min": False, "max": False, "count_distinct": False, "string_agg": False}
JOINS = ("inner", "left", "right", "full", "left_semi", "left_anti")
SETS = ("union_all", "union", "intersect_all", "intersect", "except_all", "except")
WINDOWS = ("tumble", "hop", "cumulate", "session")
LATE = ("drop", "side", "recompute")


class PlanError(ValueError):
    """The plan or query is not one that can be kept up to date."""


@dataclass(frozen=True)
class Order:
    column: str
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class Agg:
    """function(column) as output; a count without a column counts rows."""

    output: str
    function: str
    column: str | None = None
    separator: str = ","
    order: tuple[Order, ...] = ()


@dataclass(frozen=True)
class Node:
    id: str
    #: How changes are followed, for explain().
    strategy: ClassVar[str] = "linear"

    def inputs(self) -> tuple[str, ...]:
        return tuple(getattr(self, f) for f in ("source", "left", "right") if hasattr(self, f)) + tuple(getattr(self, "sources", ()))

    def check(self) -> None:
        """Raise PlanError unless the fields fit together."""


@dataclass(frozen=True)
class Input(Node):
    """schema, in DDL, lets a push leave the input out from the start."""

    name: str
    columns: tuple[str, ...] = ()
    schema: str | None = None


@dataclass(frozen=True)
class Filter(Node):
    source: str
    predicate: str


@dataclass(frozen=True)
class Project(Node):
    source: str
    outputs: tuple[tuple[str, str], ...]

    def check(self) -> None:
        names = [n for n, _ in self.outputs]
        if len(set(names)) != len(names):
            raise PlanError(f"{self.id}: two outputs have one name")


@dataclass(frozen=True)
class Aggregate(Node):
    source: str
    keys: tuple[str, ...]
    aggregates: tuple[Agg, ...] = ()
    strategy: ClassVar[str] = "running sums, or touched groups where sums are not enough"

    def check(self) -> None:
        _check_aggregates(self.id, self.aggregates, AGGREGATES)


@dataclass(frozen=True)
class Distinct(Node):
    source: str
    strategy: ClassVar[str] = "touched rows"


@dataclass(frozen=True)
class Join(Node):
    """pairs are equal columns; condition is anything else, over columns of both sides, whose names differ."""

    left: str
    right: str
    how: str = "inner"
    pairs: tuple[tuple[str, str], ...] = ()
    condition: str | None = None

    @property
    def strategy(self) -> str:  # type: ignore[override]
        return "bilinear" if self.how == "inner" else "touched keys" if self.pairs else "whole inputs"

    def check(self) -> None:
        if self.how not in JOINS:
            raise PlanError(f"{self.id}: unknown join {self.how}")


@dataclass(frozen=True)
class SetOp(Node):
    left: str
    right: str
    mode: str
    strategy: ClassVar[str] = "touched rows"

    def check(self) -> None:
        if self.mode not in SETS:
            raise PlanError(f"{self.id}: unknown set operation {self.mode}")


@dataclass(frozen=True)
class Recompute(Node):
    """sql over the whole inputs, which it sees under the names of `tables`."""

    sources: tuple[str, ...]
    tables: tuple[str, ...]
    sql: str
    timed: bool = False
    strategy: ClassVar[str] = "whole inputs"


@dataclass(frozen=True)
class Watermark(Node):
    source: str
    time: str
    lateness: int = 0
    policy: str = "drop"
    strategy: ClassVar[str] = "greatest time so far, this batch included"

    def check(self) -> None:
        if self.policy not in LATE or self.lateness < 0:
            raise PlanError(f"{self.id}: unknown policy or negative lateness")


@dataclass(frozen=True)
class TimeWindow(Node):
    """Aggregates by keys and window; times are whole numbers of one unit."""

    source: str
    kind: str
    time: str
    size: int = 0
    slide: int = 0
    step: int = 0
    gap: int = 0
    keys: tuple[str, ...] = ()
    aggregates: tuple[Agg, ...] = ()
    lateness: int = 0
    late_policy: str = "recompute"
    ttl: int | None = None
    strategy: ClassVar[str] = "touched windows, or touched keys for sessions"

    def check(self) -> None:
        need = {"tumble": (self.size,), "hop": (self.size, self.slide), "cumulate": (self.size, self.step), "session": (self.gap,)}
        if self.kind not in WINDOWS or min(need[self.kind]) <= 0:
            raise PlanError(f"{self.id}: a {self.kind} window needs positive lengths")
        if self.kind == "cumulate" and self.size % self.step:
            raise PlanError(f"{self.id}: the step must divide the size")
        if self.late_policy not in LATE:
            raise PlanError(f"{self.id}: unknown policy {self.late_policy}")
        _check_aggregates(self.id, self.aggregates, AGGREGATES)


@dataclass(frozen=True)
class Over(Node):
    """Window functions as Spark SQL; `partition` must be common to all of them."""

    source: str
    partition: tuple[str, ...]
    outputs: tuple[tuple[str, str], ...]
    strategy: ClassVar[str] = "touched partitions"


@dataclass(frozen=True)
class TopN(Node):
    source: str
    order: tuple[Order, ...]
    limit: int
    partition: tuple[str, ...] = ()
    strategy: ClassVar[str] = "touched partitions"

    def check(self) -> None:
        if self.limit < 0 or not self.order:
            raise PlanError(f"{self.id}: top-n needs an order and a limit")


@dataclass(frozen=True)
class IntervalJoin(Node):
    """Rows of equal keys where [left_start, left_end) and [right_start, right_end) overlap, or the right one holds left_start."""

    left: str
    right: str
    keys: tuple[tuple[str, str], ...]
    mode: str
    left_start: str
    right_start: str
    right_end: str
    left_end: str | None = None
    strategy: ClassVar[str] = "bilinear"

    def check(self) -> None:
        if self.mode not in ("overlap", "contains_point") or (self.mode == "overlap") != (self.left_end is not None):
            raise PlanError(f"{self.id}: an overlap has four bounds, a point three")


@dataclass(frozen=True)
class Recursive(Node):
    """The fixpoint of step_sql from seed_sql; step_sql sees what is new as `_found`."""

    sources: tuple[str, ...]
    tables: tuple[str, ...]
    columns: tuple[str, ...]
    seed_sql: str
    step_sql: str
    distinct: bool = True
    max_rounds: int = 32
    strategy: ClassVar[str] = "fixpoint over the whole inputs"


def _check_aggregates(where: str, aggregates: tuple[Agg, ...], known: dict) -> None:
    for a in aggregates:
        if a.function not in known:
            raise PlanError(f"{where}: unsupported aggregate {a.function}")
        if a.column is None and a.function != "count":
            raise PlanError(f"{where}: {a.function} needs a column")
        if a.function == "string_agg" and not a.order:
            raise PlanError(f"{where}: string_agg needs an order")


KINDS = {c.__name__: c for c in (Input, Filter, Project, Aggregate, Distinct, Join, SetOp, Recompute, Watermark, TimeWindow, Over, TopN, IntervalJoin, Recursive)}


@dataclass(frozen=True)
class Plan:
    nodes: tuple[Node, ...]
    output: str
    #: Names of functions that users registered, with the hash of their source.
    functions: tuple[tuple[str, str], ...] = field(default=())

    def validate(self) -> Plan:
        seen: set[str] = set()
        for n in self.nodes:
            if n.id in seen:
                raise PlanError(f"{n.id} is there twice")
            if missing := [i for i in n.inputs() if i not in seen]:
                raise PlanError(f"{n.id} reads {missing}, which must come before it")
            n.check()
            seen.add(n.id)
        if self.output not in seen:
            raise PlanError(f"there is no node {self.output}")
        return self

    def inputs(self) -> dict[str, tuple[str, ...]]:
        return {n.name: n.columns for n in self.nodes if isinstance(n, Input)}

    def to_json(self) -> str:
        """Canonical text: the same plan always gives the same."""
        nodes = [{"op": type(n).__name__} | dataclasses.asdict(n) for n in self.nodes]
        return json.dumps({"nodes": nodes, "output": self.output, "functions": self.functions}, sort_keys=True, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Plan:
        def deep(x: object) -> object:
            return tuple(map(deep, x)) if isinstance(x, list) else x

        def build(d: dict) -> Node:
            d = dict(d)
            kind = KINDS[d.pop("op")]
            order = lambda xs: tuple(Order(**o) for o in xs)
            if "aggregates" in d:
                d["aggregates"] = [Agg(**(a | {"order": order(a["order"])})) for a in d["aggregates"]]
            if "order" in d:
                d["order"] = [Order(**o) for o in d["order"]]
            return kind(**{k: deep(v) for k, v in d.items()})

        d = json.loads(text)
        return cls(tuple(map(build, d["nodes"])), d["output"], deep(d["functions"])).validate()

    def semantic_id(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def explain(self) -> str:
        """A line for each node: what it is, what it reads, and how it follows changes."""
        out = []
        for n in self.nodes:
            own = {k: v for k, v in dataclasses.asdict(n).items() if k not in ("id", "source", "left", "right", "sources") and v not in ((), None)}
            said = ", ".join(f"{k}={v}" for k, v in own.items())
            out.append(f"{n.id}: {type(n).__name__}({', '.join(n.inputs())}) [{n.strategy}] {said}")
        return "\n".join(out)
