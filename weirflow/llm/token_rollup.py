"""Token counts as rollups that deltas maintain.

A batch of inserts, deletes and revised counts becomes signed rows, which add
up to a small delta by source, language and tokenizer version.  Committing a
batch writes its delta under the batch's name and makes it visible by one
rename, so a batch that is sent again changes nothing.  Totals are the sum of
the committed deltas; compaction folds deltas into a base and keeps the names
of the batches that it holds.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from urllib.parse import quote, unquote

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm._shared import materialize, rename_new, scratch_path, table

TOKENIZERS = "/opt/tokenizers"
#: What splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space that are cut out before the pattern sees them: it tries every length of a run, and gives up on a million.
LONG_SPACE = regex.compile(r"\p{White_Space}{4096,}")
VERSIONS = {"bpe-50k": "byte_bpe_50k.tiktoken", "bpe-multi-50k": "byte_bpe_multi_50k.tiktoken"}
KEYS = ("source", "lang", "version")


@dataclass(frozen=True)
class Tokenizer:
    version: str
    ranks: bytes


@cache
def _encoding(t: Tokenizer) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, t.ranks.splitlines())}
    return tiktoken.Encoding(t.version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizers(folder: str = TOKENIZERS, versions: dict[str, str] = VERSIONS) -> list[Tokenizer]:
    """Vocabularies read on the driver; executors get them with the task."""
    out = []
    for version, name in versions.items():
        with open(f"{folder}/{name}", "rb") as f:
            out.append(Tokenizer(version, f.read()))
    return out


def count_tokens(encoding: tiktoken.Encoding, text: str) -> int:
    """Tokens of a whole text, as PATTERN splits it.

    PATTERN makes one piece of a run of white space, less its last character if something follows: that
    one goes with the next word, or is a piece of its own.  Long runs are cut there and merged directly,
    so any text can be counted.
    """
    total, at = 0, 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        total += len(encoding.encode_ordinary(text[at : m.start()])) + len(encoding._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def token_counts(docs: DataFrame, counters: list[Tokenizer]) -> DataFrame:
    """(doc_id, source, lang, tokens): tokens is a map from version to the count of the whole text.

    Every row gives a row, repeated ones too; a null or empty text has 0 tokens, and an empty table no rows.
    Other columns of docs are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(counters)  # a vocabulary is about 1 MB whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            counts = [[count_tokens(_encoding(c), t) for t in texts] for c in own]
            maps = [[(c.version, n) for c, n in zip(own, row, strict=True)] for row in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(maps, pa.map_(pa.string(), pa.int64()))], ["doc_id", "source", "lang", "tokens"]
            )

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, lang string, tokens map<string,long>")


def inserts(rows: DataFrame) -> DataFrame:
    """Signed rows that add documents (source, lang, version, tokens)."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Signed rows that take away documents (source, lang, version, tokens), with the counts they were added with."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(rows: DataFrame) -> DataFrame:
    """Signed rows for counts that change, from (source, lang, version, tokens) to (new_source, new_lang, new_version, new_tokens)."""
    new = rows.select(*[F.col(f"new_{k}").alias(k) for k in (*KEYS, "tokens")])
    return deletes(rows).unionAll(inserts(new))


class TokenRollup:
    """Totals by source, language and tokenizer version in a folder that driver and executors share.

    Keys may be null and are groups like others.  A group without documents
    and tokens is not listed, so an empty rollup has no rows.  Signed rows that
    repeat count each time; the order of rows and of batches does not matter.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("deltas", "bases", "staged"):
            self._fs.mkdirs(self._Path(f"{self.path}/{name}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._Path(f"{self.path}/{folder}")))

    def _base(self) -> str | None:
        names = self._names("bases")
        return f"{self.path}/bases/{names[-1]}" if names else None

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("source string, lang string, version string, docs long, tokens long").parquet(path)

    def batches(self) -> set[str]:
        """Names of all committed batches."""
        base = self._base()
        held = {r["batch"] for r in self.spark.read.parquet(f"{base}/batches").collect()} if base else set()
        return held | {unquote(n) for n in self._names("deltas")}

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of signed rows; False if a batch of that name is committed, which then stays as it was.

        Of two writers of one batch at a time, one gets True and only its rows count.
        """
        if batch in self.batches():
            return False
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        delta = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.where("docs <> 0 or tokens <> 0").coalesce(1).write.parquet(staged)
        # The rename is what commits: a writer that dies before it leaves only a staged folder, and one that comes second gets False.
        return rename_new(self.spark, staged, f"{self.path}/deltas/{quote(batch, safe='')}")

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all committed batches."""
        base, rows = self._base(), self.spark.createDataFrame([], "source string, lang string, version string, docs long, tokens long")
        done = {r["batch"] for r in self.spark.read.parquet(f"{base}/batches").collect()} if base else set()
        if base:
            rows = rows.unionAll(self._read(f"{base}/totals"))
        for name in self._names("deltas"):
            if unquote(name) not in done:
                rows = rows.unionAll(self._read(f"{self.path}/deltas/{name}"))
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold the deltas into a new base.  A crash at any point leaves the old base and deltas, or the new base, in force."""
        done = sorted(self.batches())
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        self.totals().coalesce(1).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(b,) for b in done], "batch string").coalesce(1).write.parquet(f"{staged}/batches")
        old = self._names("bases")
        number = int(old[-1]) + 1 if old else 0
        if not rename_new(self.spark, staged, f"{self.path}/bases/{number:012d}"):
            return  # another writer folded at the same time; what it left is folded by the next call
        for name in old:
            self._fs.delete(self._Path(f"{self.path}/bases/{name}"), True)
        for name in self._names("deltas"):
            if unquote(name) in done:
                self._fs.delete(self._Path(f"{self.path}/deltas/{name}"), True)


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, lang, version, docs, tokens) after four batches: all documents are added as the first tokenizer counts them; documents that are
    labelled toxic go; those in languages other than English are counted anew by the second tokenizer; and the
    first batch comes again, to no effect.  Null sources and languages are groups of their own; a null doc_id is in no label."""
    one, two = VERSIONS
    counts = materialize(token_counts(table(spark, sf_dir, "documents"), tokenizers()), "token-counts")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    rows = counts.select("doc_id", "source", "lang", F.lit(one).alias("version"), F.col("tokens")[one].alias("tokens"), F.col("tokens")[two].alias("new_tokens"))
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("load", inserts(rows))
    rollup.commit("toxic out", deletes(rows.join(toxic, "doc_id", "left_semi")))
    moved = rows.join(toxic, "doc_id", "left_anti").where("lang is null or lang <> 'en'")
    rollup.commit("recount", revisions(moved.withColumns({"new_source": F.col("source"), "new_lang": F.col("lang"), "new_version": F.lit(two)})))
    rollup.commit("load", inserts(rows))
    rollup.compact()
    return rollup.totals()
