"""A catalog of models, sinks, macros and variables, drafted in SQL and published as plans."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weirflow.functions.udf import UdfRegistry, macro
from weirflow.operators import zset as z
from weirflow.plans import nodes as p
from weirflow.plans.frontend import compile_sql, relations
from weirflow.plans.graph import StreamGraph
from weirflow.plans.sharing import Admission, reuse
from weirflow.plans.state import StateStore
from weirflow.sources.connectors import UpsertSink
from weirflow.sources.folders import Folder, shared_root

_CREATE = re.compile(r"(?is)^CREATE\s+(OR\s+REPLACE\s+)?(MODEL|SINK|MACRO)\s+(\w+)\s*(\([^)]*\))?\s*(?:KEY\s*\(([^)]*)\)\s*)?(?:RETURNS\s+(\w+(?:\([^)]*\))?)\s+)?AS\s+(.*)$")


class CatalogError(ValueError):
    """A command that the catalog can't follow."""


@dataclass
class Published:
    version: int
    plans: dict[str, p.Plan]
    digest: str


@dataclass
class Catalog:
    """Commands: CREATE [OR REPLACE] MODEL name AS query; CREATE SINK name KEY (columns) AS query;
    CREATE MACRO name(params) RETURNS type AS expression; DROP name; SET name = value; RESET name;
    ALTER SINK name KEY (columns); SHOW; EXPLAIN name; PUBLISH.

    Models may read models; their queries are put in where they are read, and a
    circle is an error.  With a folder the catalog, what is published and its
    state outlive the session.

    push() also keeps the rows of the sources, so a sink that is published later
    is filled from them as they stand, and then follows.  Every part notes the
    last delivery that it has, so a delivery that broke off is sent again whole.
    """

    spark: SparkSession
    sources: dict[str, DataFrame]
    folder: str | None = None
    tenant_limit: int = 0
    objects: dict[str, dict] = field(default_factory=dict)
    variables: dict[str, str] = field(default_factory=dict)
    published: Published | None = None
    audit: list[str] = field(default_factory=list)
    admission: Admission | None = None

    def __post_init__(self) -> None:
        self.udfs = UdfRegistry(self.spark)
        self.graphs: dict[str, StreamGraph] = {}
        #: For each sink the one whose state it reads, often itself.
        self.leaders: dict[str, str] = {}
        self.sinks: dict[str, UpsertSink] = {}
        #: Of sinks that read a part of another one's result: the columns that they take.
        self.parts: dict[str, tuple[str, ...]] = {}
        self._home = self.folder or f"{shared_root(self.spark)}/weirflow-catalog-{uuid.uuid4().hex}"
        self._room = Folder(self.spark, self._home, passing=self.folder is None)
        self._bases: dict[str, StateStore] = {}
        self._files = Folder(self.spark, self.folder) if self.folder else None
        if self._files and self._files.has_text("catalog.json"):
            held = json.loads(self._files.read_text("catalog.json"))
            self.objects, self.variables = held["objects"], held["variables"]
            if said := held.get("published"):
                plans = {n: p.Plan.from_json(t) for n, t in said["plans"].items()}
                self.published = Published(said["version"], plans, said["digest"])
                self._put_in_force(plans, said["keys"], {n: tuple(c) for n, c in said["parts"].items()}, said["leaders"])
            for name, o in self.objects.items():
                if o["kind"] == "macro":
                    macro(self.spark, name, o["params"], o["returns"], o["sql"])

    def _save(self) -> None:
        if not self._files:
            return
        held: dict = {"objects": self.objects, "variables": self.variables}
        if self.published:
            keys = {n: k.keys for n, k in self.sinks.items()}
            plans = {n: x.to_json() for n, x in self.published.plans.items()}
            held["published"] = {"version": self.published.version, "digest": self.published.digest, "plans": plans, "keys": keys, "parts": self.parts, "leaders": self.leaders}
        self._files.write_text("catalog.json", json.dumps(held, sort_keys=True))

    def execute(self, command: str) -> object:
        command = command.strip().rstrip(";")
        self.audit.append(command.split("\n")[0][:200])
        word = command.split(None, 1)[0].upper() if command else ""
        handler = getattr(self, f"_{word.lower()}", None)
        if handler is None:
            raise CatalogError(f"unknown command {word}")
        out = handler(command)
        self._save()
        return out

    def execute_batch(self, commands: str) -> list[object]:
        """All commands or none: what they changed is put back if one fails."""
        before = json.dumps([self.objects, self.variables])
        try:
            return [self.execute(c) for c in re.split(r";\s*(?:\n|$)", commands) if c.strip()]
        except Exception:
            self.objects, self.variables = json.loads(before)
            self._save()
            raise

    # -- commands -----------------------------------------------------------

    def _create(self, command: str) -> str:
        m = _CREATE.match(command)
        if not m:
            raise CatalogError("CREATE needs a kind, a name and AS")
        replace, kind, name, params, keys, returns, sql = m.groups()
        if name in self.objects and not replace:
            raise CatalogError(f"{name} is there already")
        if self.tenant_limit and name not in self.objects and len(self.objects) >= self.tenant_limit:
            raise CatalogError("the quota of objects is used up")
        if name in self.sources:
            raise CatalogError(f"{name} is a source")
        kind = kind.lower()
        held = {"kind": kind, "sql": sql.strip()}
        if kind == "macro":
            if not params or not returns:
                raise CatalogError("a macro needs parameters and RETURNS")
            held |= {"params": params.strip()[1:-1], "returns": returns}
            macro(self.spark, name, held["params"], returns, held["sql"])
        if kind == "sink":
            held["keys"] = [k.strip() for k in (keys or "").split(",") if k.strip()]
        self.objects[name] = held
        return name

    def _alter(self, command: str) -> str:
        m = re.match(r"(?is)^ALTER\s+SINK\s+(\w+)\s+KEY\s*\(([^)]*)\)$", command)
        if not m or self.objects.get(m[1], {}).get("kind") != "sink":
            raise CatalogError("ALTER SINK name KEY (columns)")
        self.objects[m[1]]["keys"] = [k.strip() for k in m[2].split(",")]
        return m[1]

    def _drop(self, command: str) -> str:
        name = command.split()[-1]
        if name not in self.objects:
            raise CatalogError(f"there is no {name}")
        if users := [n for n, o in self.objects.items() if n != name and o["kind"] != "macro" and name in self._reads(o["sql"])]:
            raise CatalogError(f"{', '.join(users)} read {name}")
        del self.objects[name]
        return name

    def _set(self, command: str) -> str:
        m = re.match(r"(?is)^SET\s+(?:VARIABLE\s+)?(\w+)\s*=\s*(.*)$", command)
        if not m:
            raise CatalogError("SET name = value")
        self.variables[m[1]] = m[2].strip()
        return m[1]

    def _reset(self, command: str) -> str:
        self.variables.pop(command.split()[-1], None)
        return command.split()[-1]

    def _show(self, command: str) -> list[tuple[str, str]]:
        return sorted((n, o["kind"]) for n, o in self.objects.items())

    def _explain(self, command: str) -> str:
        return self.plan(command.split()[-1]).explain()

    def _publish(self, command: str) -> Published:
        return self.publish()

    # -- plans --------------------------------------------------------------

    def _filled(self, sql: str) -> str:
        """The text with the variables' values in place of ${name}."""
        for k, v in self.variables.items():
            sql = re.sub(rf"\$\{{{re.escape(k)}\}}", lambda _, v=v: v, sql)
        if m := re.search(r"\$\{(\w+)\}", sql):
            raise CatalogError(f"the variable {m[1]} is not set")
        return sql

    def _reads(self, sql: str) -> list[str]:
        """Models that a query reads as tables, whatever its columns are called."""
        named = {x.lower() for x in relations(self.spark, re.sub(r"\$\{\w+\}", "0", sql))}
        return [n for n, o in self.objects.items() if o["kind"] == "model" and n.lower() in named]

    def inlined(self, sql: str, above: tuple[str, ...] = ()) -> str:
        """The query with the models that it reads as named subqueries, innermost first."""
        order: list[str] = []

        def visit(text: str, path: tuple[str, ...]) -> None:
            for n in self._reads(text):
                if n in path:
                    raise CatalogError(f"models read each other in a circle: {' -> '.join((*path, n))}")
                visit(self.objects[n]["sql"], (*path, n))
                if n not in order:
                    order.append(n)

        visit(sql, above)
        sql = self._filled(sql)
        if not order:
            return sql
        named = ", ".join(f"`{n}` AS ({self._filled(self.objects[n]['sql'])})" for n in order)
        return f"WITH {named} SELECT * FROM ({sql})"

    def plan(self, name: str) -> p.Plan:
        o = self.objects.get(name)
        if o is None or o["kind"] == "macro":
            raise CatalogError(f"{name} has no plan")
        above = (name,) if o["kind"] == "model" else ()
        return compile_sql(self.spark, self.inlined(o["sql"], above), dict(self.sources), on_unsupported="recompute")

    def compile_draft(self) -> tuple[dict[str, p.Plan], str]:
        plans = {n: self.plan(n) for n, o in sorted(self.objects.items()) if o["kind"] == "sink"}
        digest = hashlib.sha256("".join(f"{n}:{x.semantic_id()}:{self.objects[n]['keys']}" for n, x in plans.items()).encode()).hexdigest()
        return plans, digest

    def publish(self) -> Published:
        """Put the sinks' plans in force.  The same plans are the same version; sinks of equal plans share one state,
        and one that takes some columns of another's result reads that.  New states are filled from the sources as
        they stand, and so are sinks that are new or have new keys; what no sink needs any more is deleted."""
        plans, digest = self.compile_draft()
        if self.published and self.published.digest == digest:
            return self.published
        if self.admission:
            for name in [n for n in self.admission.running if n not in plans]:
                self.admission.release(name)
            plans = {n: x for n, x in plans.items() if n in self.admission.running or (n not in dict(self.admission.waiting) and self.admission.request(n))}
        parts: dict[str, tuple[str, ...]] = {}
        leaders: dict[str, str] = {}
        for name, plan in plans.items():
            for other in leaders:
                if leaders[other] == other and (r := reuse(plans[other], plan)):
                    leaders[name], parts[name] = other, r.columns
                    break
            else:
                leaders[name] = name
        self._put_in_force(plans, {n: self.objects[n]["keys"] for n in plans}, parts, leaders)
        self.published = Published(self.published.version + 1 if self.published else 1, plans, digest)
        self._save()
        self._retire()
        return self.published

    def _put_in_force(self, plans: dict[str, p.Plan], keys: dict[str, list[str]], parts: dict[str, tuple[str, ...]], leaders: dict[str, str]) -> None:
        held = {g.plan.semantic_id(): g for g in self.graphs.values()}
        graphs: dict[str, StreamGraph] = {}
        for name, leader in leaders.items():
            plan = plans[leader]
            if plan.semantic_id() not in held:
                held[plan.semantic_id()] = self._bootstrapped(plan)
            graphs[name] = held[plan.semantic_id()]
        self.graphs, self.parts, self.leaders = graphs, parts, leaders
        for name, graph in graphs.items():
            sink = self.sinks.get(name)
            if sink is None or sink.keys != keys[name]:
                mark = hashlib.sha256(f"{name}:{keys[name]}:{plans[name].semantic_id()}".encode()).hexdigest()[:16]
                self.sinks[name] = sink = UpsertSink(self.spark, keys[name], f"{self._home}/sinks/{mark}")
                if graph.version and not sink.store.version:
                    sink.write(f"bootstrap of {graph.version}", self._share(name, graph.output()))
        self.sinks = {n: self.sinks[n] for n in graphs}

    def _base(self, source: str) -> StateStore:
        if source not in self._bases:
            self._bases[source] = StateStore(self.spark, f"base:{source}", f"{self._home}/bases/{source}")
        return self._bases[source]

    def _bootstrapped(self, plan: p.Plan) -> StreamGraph:
        """A graph over the sources as they stand; one whose state is there goes on from it."""
        graph = StreamGraph(plan, self.spark, f"{self._home}/graphs/{plan.semantic_id()}")
        rows = {k: self._base(k).read("rows") for k in plan.inputs()}
        if not graph.version and any(r is not None for r in rows.values()):
            last = max((str(self._base(k).manifest["extra"].get("delivery", "")) for k in rows), key=lambda d: d != "")
            graph.push({k: z.consolidate(r) for k, r in rows.items() if r is not None}, delivery=last)
        return graph

    def _share(self, name: str, rows: DataFrame) -> DataFrame:
        """What a sink takes of its leader's rows."""
        columns = self.parts.get(name)
        return z.consolidate(rows.select(*columns, z.WEIGHT)) if columns else rows

    def _retire(self) -> None:
        """Delete state that nothing in force refers to."""
        used = {g.plan.semantic_id() for g in self.graphs.values()}
        for n in self._room.names("graphs"):
            if n not in used:
                self._room.delete(f"graphs/{n}")
        sinks = {s.store.folder.root.rsplit("/", 1)[1] for s in self.sinks.values()}
        for n in self._room.names("sinks"):
            if n not in sinks:
                self._room.delete(f"sinks/{n}")

    def push(self, deltas: dict[str, DataFrame], delivery: str) -> None:
        """Changes of the sources, to every published sink, under an id.  The last delivery may be sent again."""
        for source, rows in deltas.items():
            base = self._base(source)
            if base.manifest["extra"].get("delivery") != delivery:
                with base.next_version() as v:
                    v.append("rows", z.weighted(rows), z.consolidate)
                    v.extra = {"delivery": delivery}
        for name, graph in self.graphs.items():
            own = {k: d for k, d in deltas.items() if k in graph.plan.inputs()}
            if own and graph.store.manifest["extra"].get("delivery") != delivery:
                graph.push(own, delivery=delivery)
            if own:
                self.sinks[name].write(delivery, self._share(name, graph.store.read("delta")))


class Rebuild:
    """A graph of a new plan beside the one in force: filled from the tables at a version, caught up, verified, and swapped in.

    fence() says up to which version of the change log the old one has come; the new one must reach it to take over.
    """

    def __init__(self, old: StreamGraph, plan: p.Plan, bases: dict[str, DataFrame], spark: SparkSession, at: int = 0, folder: str | None = None) -> None:
        self.old, self.at = old, at
        self.new = StreamGraph(plan, spark, folder)
        self.new.push({k: bases[k] for k in plan.inputs()}, upto=at)

    def catch_up(self, upto: int, deltas: dict[str, DataFrame]) -> None:
        """Apply the changes of the next version."""
        if upto != self.at + 1:
            raise p.PlanError(f"version {upto} does not follow {self.at}")
        self.new.push({k: d for k, d in deltas.items() if k in self.new.plan.inputs()}, upto=upto)
        self.at = upto

    def swap(self, fence: int) -> tuple[StreamGraph, DataFrame]:
        """The new graph and the change that turns the old result into its result; an error before the fence."""
        if self.at < fence:
            raise p.PlanError(f"the new state is at {self.at}, the old one at {fence}")
        return self.new, z.difference(self.new.output(), self.old.output())


def rebuild(graph: StreamGraph, plan: p.Plan, bases: dict[str, DataFrame], spark: SparkSession) -> StreamGraph:
    """A graph of a new plan beside the one in force, filled from the tables as they are; the caller swaps them."""
    return Rebuild(graph, plan, bases, spark).new
