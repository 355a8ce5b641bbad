"""A training corpus from documents: five stages, each written and read again.

Language identification rejects, line dedup edits, SimHash near-dedup drops,
mixing draws by source, and packing lays out what is left.  Each stage works on
all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import language_id, length_packing, line_dedup, simhash_dedup, source_mix
from weirflow.llm._shared import scratch_path, table, word_count

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words in a shard of the mix, about; and the least and most shards.
SHARD_WORDS, SHARDS = 1 << 22, (16, 16384)

#: The stages fit models and draw at random, which SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.  A null lang becomes the one found.

    Without a labelled text to learn from, no document can be told.
    """
    model = language_id.fit(docs.select("text", "lang"))
    found = language_id.identify(docs.select(*COLUMNS), model).where("not rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated chunks of lines; n_chars follows the text."""
    rows = line_dedup.without_repeated_lines(docs.select(*COLUMNS))
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the least doc_id, null after all others.

    Near-duplicates share 0.8 or more of their five-word shingles.  Each row is judged by its own
    text, also where a doc_id is null or repeats.
    """
    groups = simhash_dedup.similar_groups(docs.select("doc_id", "text"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k")
    keep = groups.groupBy("component").agg(least).select(F.col("k.digest").alias("_digest"), F.col("k.doc_id").alias("_id"))
    rows = docs.select(*COLUMNS, simhash_dedup.text_digest(F.col("text")).alias("_digest")).join(keep, "_digest")
    return rows.where(F.col("doc_id").eqNullSafe(F.col("_id"))).dropDuplicates(["_digest"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by source; one that is drawn twice is there twice."""
    words = docs.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    n_shards = min(SHARDS[1], max(SHARDS[0], words // SHARD_WORDS))
    return source_mix.mixed_documents(docs.select(*COLUMNS), n_shards)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every drawn document in its bucket, batch and slot; tokens are words."""
    return length_packing.pack(length_packing.pieces(docs, word_count(F.col("text"))))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("source mix", mix_sources),
    ("length packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{path}/{k}")
            docs = spark.read.parquet(f"{path}/{k}")
    return docs
