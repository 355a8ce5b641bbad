"""User functions: scalar, aggregate with retraction, and table, plus SQL macros.

Source is compiled with a short list of built-ins.  Scalars run on Arrow
batches; aggregates fold weighted rows and can take a row back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from weirflow.operators import zset as z

ALLOWED = {f.__name__: f for f in (abs, all, any, bool, dict, divmod, enumerate, float, int, len, list, max, min, pow, range, reversed, round, set, sorted, str, sum, tuple, zip)}


class UnsupportedLanguage(ValueError):
    """There is no runtime for the language here."""


class UdfError(ValueError):
    """The source is not a function, or the declaration doesn't fit."""


def compiled(source: str, *names: str) -> dict:
    """The named definitions of a source that may use ALLOWED and nothing to import."""
    if "__" in source or "import" in source.split():
        raise UdfError("a function may not import or reach for names with two underscores")
    space: dict = {"__builtins__": dict(ALLOWED)}
    exec(compile(source, "<udf>", "exec"), space)  # noqa: S102
    if missing := [n for n in names if not callable(space.get(n))]:
        raise UdfError(f"the source defines no {', '.join(missing)}")
    return space


@dataclass(frozen=True)
class Udf:
    name: str
    kind: str
    source: str
    returns: str
    language: str = "python"
    deterministic: bool = True

    def identity(self) -> str:
        return hashlib.sha256(f"{self.kind}:{self.language}:{self.returns}:{self.source}".encode()).hexdigest()


@dataclass
class UdfRegistry:
    spark: SparkSession
    held: dict[str, Udf] = field(default_factory=dict)

    def register(self, name: str, kind: str, source: str, returns: str, language: str = "python", deterministic: bool = True) -> Udf:
        """kind "scalar" defines call(*args); "aggregate" accumulate(state, value), retract(state, value) and
        finish(state), from state 0; "table" rows(*args), which returns a list of tuples."""
        if language != "python":
            raise UnsupportedLanguage(f"there is no runtime for {language} here")
        need = {"scalar": ("call",), "aggregate": ("accumulate", "retract", "finish"), "table": ("rows",)}
        if kind not in need:
            raise UdfError(f"unknown kind {kind}")
        compiled(source, *need[kind])
        udf = self.held[name] = Udf(name, kind, source, returns, language, deterministic)
        if kind == "scalar":
            self.spark.udf.register(name, scalar(udf))
        elif kind == "table":
            self.spark.udtf.register(name, _udtf(udf))
        return udf

    def identities(self, nondeterministic: str = "reject") -> tuple[tuple[str, str], ...]:
        """Names with the hashes of their sources, for a plan's `functions`."""
        if nondeterministic == "reject" and (bad := [u.name for u in self.held.values() if not u.deterministic]):
            raise UdfError(f"{', '.join(bad)}: only a timed recomputation may use what is not deterministic")
        return tuple(sorted((u.name, u.identity()) for u in self.held.values()))

    def aggregate(self, name: str, df: DataFrame, keys: list[str], column: str, output: str) -> DataFrame:
        return aggregate(self.held[name], df, keys, column, output)


def scalar(udf: Udf):  # noqa: ANN201
    source = udf.source

    def run(*cols: pd.Series) -> pd.Series:
        call = compiled(source, "call")["call"]
        plain = [[None if pd.isna(v) else v for v in c.astype(object)] for c in cols]
        return pd.Series([call(*v) for v in zip(*plain, strict=True)], dtype=object)

    out = F.pandas_udf(run, udf.returns)
    return out if udf.deterministic else out.asNondeterministic()


def aggregate(udf: Udf, df: DataFrame, keys: list[str], column: str, output: str) -> DataFrame:
    """One row for each group.  Equal values are combined to one weighted row before a group meets in one task;
    a group is folded from its distinct values, which must fit there."""
    slim = z.weighted(df).groupBy(*keys, column).agg(F.sum(z.WEIGHT).alias(z.WEIGHT)).where(F.col(z.WEIGHT) != 0)
    fields = [slim.schema[k] for k in keys]
    schema = StructType([*fields, StructField(output, _parse_datatype_string(udf.returns))])
    source = udf.source

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        space = compiled(source, "accumulate", "retract", "finish")
        state = 0
        for v, w in sorted(zip(rows[column].tolist(), rows[z.WEIGHT].tolist(), strict=True), key=lambda x: (-x[1], repr(x[0]))):
            for _ in range(abs(w)):
                state = space["accumulate" if w > 0 else "retract"](state, v)
        return pd.DataFrame([[*key, space["finish"](state)]], columns=[*keys, output])

    return slim.groupBy(*keys).applyInPandas(fold, schema)


def _udtf(udf: Udf):  # noqa: ANN202
    source = udf.source

    class Table:
        def eval(self, *args: object):  # noqa: ANN202
            yield from compiled(source, "rows")["rows"](*args)

    return F.udtf(Table, returnType=udf.returns)


def macro(spark: SparkSession, name: str, params: str, returns: str, body: str, replace: bool = True) -> None:
    """A SQL scalar function, inlined by Spark: params like "x INT, y INT"."""
    spark.sql(f"CREATE {'OR REPLACE ' if replace else ''}TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
