"""State in versioned folders with manifests that are put in place by one rename each.

Manifests are numbered and never changed; the last one is in force.  A writer
that finds its number taken fails, so two of them never overwrite each other.

A name stands for a list of Parquet folders whose rows add up, so a version
writes only what it changes and points to folders of earlier versions for the
rest.  Once many are folded into a large one, that is laid out in buckets by the
hash of the keys, and a reader that names the keys it wants reads those buckets
and the small folders that came since.  Readers pin a version; versions below the least of the pins and of what
is to be kept are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, StructField, StructType

from weirflow.sources.folders import Folder, shared_root


class StateError(RuntimeError):
    """The state folder belongs to another plan or lacks a version."""


def bucket(df: DataFrame, keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(Version.BUCKETS)).cast("int")


class Version:
    """What a push writes.  Writes are gathered and run side by side when the version is committed."""

    #: Folders that a name may have before they are folded into one, the bytes from which that is bucketed, and buckets.
    MOST_PARTS, BUCKET_BYTES, BUCKETS = 8, 16 << 20, 64

    def __init__(self, store: StateStore, number: int) -> None:
        self.store, self.number = store, number
        self.paths: dict[str, list[str]] = {k: list(v) for k, v in store.manifest["paths"].items()}
        self.schemas: dict[str, dict] = dict(store.manifest["schemas"])
        self.pending: dict[str, DataFrame] = {}
        self.held: list[DataFrame] = []
        self.extra: dict = {}
        self.bucketed: dict[str, list[str]] = dict(store.manifest.get("bucketed", {}))
        self.by: dict[str, list[str]] = {}
        self.same: dict[str, str] = {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """df takes the place of what the name has had."""
        self.paths[name] = []
        return self._later(name, df)

    def append(self, name: str, df: DataFrame, fold: Callable[[DataFrame], DataFrame], keys: list[str] | None = None, also: str | None = None) -> None:
        """df adds to what the name has; fold makes one collection of many parts, in buckets by the keys if it is large.

        also is a name that has df alone; it is written once for both, unless it is folded.
        """
        if len(self.paths.get(name, ())) >= self.MOST_PARTS:
            kinds = [df.schema[k].dataType for k in keys or ()]
            # Equal floating-point keys may have different bits, and so different hashes.
            if keys and not any(isinstance(t, (FloatType, DoubleType)) for t in kinds) and self.store.size(name) >= self.BUCKET_BYTES:
                self.by[name] = keys
            if also:
                df = self.write(also, self.share(df))
            self.write(name, fold(self.store.read(name).unionByName(df)))
        else:
            self.paths.setdefault(name, [])
            self._later(name, df)
            if also:
                self.same[name], self.schemas[also] = also, self.schemas[name]

    def share(self, df: DataFrame) -> DataFrame:
        """df, computed once for all that read it in this version; a lost part is computed again."""
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def _later(self, name: str, df: DataFrame) -> DataFrame:
        self.pending[name] = df
        self.schemas[name] = df.schema.jsonValue()
        return df

    def run(self) -> None:
        folder = f"v{self.number:012d}-{uuid.uuid4().hex[:8]}"

        def one(name: str) -> None:
            df, path = self.pending[name], self.store.folder.path(f"{folder}/{name}")
            if name in self.by:
                df = df.withColumn("_b", bucket(df, self.by[name])).repartition(self.BUCKETS, "_b")
                df.write.partitionBy("_b").parquet(path)
            else:
                df.write.parquet(path)

        with ThreadPoolExecutor(max(1, min(6, len(self.pending)))) as pool:
            list(pool.map(one, self.pending))
        for name in self.pending:
            self.paths[name].append(f"{folder}/{name}")
            if name in self.same:
                self.paths[self.same[name]] = [f"{folder}/{name}"]
            if name in self.by:
                self.bucketed[f"{folder}/{name}"] = self.by[name]
        used = {x for parts in self.paths.values() for x in parts}
        self.bucketed = {k: v for k, v in self.bucketed.items() if k in used}

    def close(self) -> None:
        for df in self.held:
            df.unpersist()


class StateStore:
    def __init__(self, spark: SparkSession, identity: str, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = Folder(spark, folder or f"{shared_root(spark)}/weirflow-state-{uuid.uuid4().hex}", passing=folder is None)
        #: extra is what callers keep with the state, such as the last epoch; history has the manifest of each version.
        self.manifest = {"identity": identity, "version": 0, "paths": {}, "schemas": {}, "pins": {}, "savepoints": {}, "extra": {}, "history": {}}
        self.number = max(self._numbers(), default=0)
        if self.number:
            held = self._held(self.number)
            if held["identity"] != identity:
                raise StateError("the folder holds the state of another plan; build a new one beside it")
            self.manifest = held

    def _numbers(self) -> list[int]:
        return [int(n[9:]) for n in self.folder.names() if n.startswith("manifest-")]

    def _held(self, number: int) -> dict:
        return json.loads(self.folder._read(f"manifest-{number:012d}"))

    @property
    def version(self) -> int:
        return self.manifest["version"]

    def size(self, name: str) -> int:
        """Bytes of all that a name has."""
        return sum(self.folder.size(x) for x in self.manifest["paths"].get(name, ()))

    def read(self, name: str, version: int | None = None, touched: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame | None:
        """What a name has.  With touched, a frame of the key columns, it may be less, but has all rows with such keys."""
        held = self.manifest if version is None or version == self.version else self._manifest(version)
        paths = held["paths"].get(name)
        if not paths:
            return None
        schema = StructType.fromJson(held["schemas"][name])
        said = held.get("bucketed", {})
        plain = [x for x in paths if x not in said]
        parts = [self.spark.read.schema(schema).parquet(*map(self.folder.path, plain))] if plain else []
        for x in paths:
            if x not in said:
                continue
            df = self.spark.read.schema(StructType([*schema.fields, StructField("_b", IntegerType())])).parquet(self.folder.path(x))
            if touched is not None and keys == said[x]:
                own = touched.toDF(*keys).select(*[F.col(f"`{k}`").try_cast(schema[k].dataType).alias(k) for k in keys])
                wanted = [r[0] for r in own.select(bucket(own, keys)).distinct().collect()]  # at most BUCKETS numbers
                df = df.where(F.col("_b").isin(wanted))
            parts.append(df.drop("_b"))
        return reduce(DataFrame.unionByName, parts)

    def scratch(self, df: DataFrame) -> DataFrame:
        path = self.folder.path(f"scratch/{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _manifest(self, version: int) -> dict:
        number = self.manifest["history"].get(str(version))
        if number is None or number not in self._numbers():
            raise StateError(f"version {version} is not kept")
        return self._held(number)

    @contextmanager
    def next_version(self) -> Iterator[Version]:
        v = Version(self, self.version + 1)
        try:
            yield v  # an exception leaves the manifest, and with it the state, as it was
            v.run()
            self._commit({**self.manifest, "version": v.number, "paths": v.paths, "schemas": v.schemas, "bucketed": v.bucketed, "extra": {**self.manifest["extra"], **v.extra}})
        finally:
            v.close()

    def _commit(self, manifest: dict) -> None:
        number = self.number + 1
        manifest = {**manifest, "history": {**manifest["history"], str(manifest["version"]): number}}
        if not self.folder.write_new(f"manifest-{number:012d}", json.dumps(manifest, sort_keys=True)):
            raise StateError("another writer changed the state at the same time; open it again")
        self.number, self.manifest = number, manifest

    # -- pins, savepoints and retention -------------------------------------

    def pin(self, name: str, version: int | None = None) -> int:
        """Keep a version until it is unpinned."""
        at = self.version if version is None else version
        self._manifest(at) if at != self.version else None
        self._commit({**self.manifest, "pins": {**self.manifest["pins"], name: at}})
        return at

    def unpin(self, name: str) -> None:
        self._commit({**self.manifest, "pins": {k: v for k, v in self.manifest["pins"].items() if k != name}})

    def savepoint(self, name: str) -> None:
        """Name the state as it is, with what callers keep beside it."""
        point = {"version": self.version, "extra": self.manifest["extra"]}
        self._commit({**self.manifest, "savepoints": {**self.manifest["savepoints"], name: point}})

    def drop_savepoint(self, name: str) -> None:
        self._commit({**self.manifest, "savepoints": {k: v for k, v in self.manifest["savepoints"].items() if k != name}})

    def restore(self, name: str) -> None:
        """Make the state of a savepoint the one in force, as a new version; what came after it may be applied again."""
        point = self.manifest["savepoints"].get(name)
        if point is None:
            raise StateError(f"there is no savepoint {name}")
        held = self.manifest if point["version"] == self.version else self._manifest(point["version"])
        self._commit({**self.manifest, "version": self.version + 1, "paths": held["paths"], "schemas": held["schemas"], "bucketed": held.get("bucketed", {}), "extra": point["extra"]})

    def floor(self, keep: int = 1) -> int:
        """The least version that must stay."""
        return min([self.version - keep + 1, *self.manifest["pins"].values(), *(s["version"] for s in self.manifest["savepoints"].values())])

    def collect_garbage(self, keep: int = 1) -> int:
        """Delete folders that no version from floor() on refers to; returns how many."""
        floor = self.floor(keep)
        names = self.folder.names()
        stay = {n for v, n in self.manifest["history"].items() if int(v) >= floor} | {self.number}
        manifests = [n for n in names if n.startswith("manifest-")]
        kept = [self._held(int(n[9:])) for n in manifests if int(n[9:]) in stay]
        needed = {x.split("/")[0] for m in kept for parts in m["paths"].values() for x in parts}
        gone = [n for n in names if n == "scratch" or n.startswith("v") and n not in needed] + [n for n in manifests if int(n[9:]) not in stay]
        for n in gone:
            self.folder.delete(n)
        return len(gone)
