"""Packing by optimal length buckets.

The global histogram of piece lengths is small: texts longer than a sequence
are cut into whole sequences and a rest, so there are at most max_length
lengths.  Dynamic programming over it finds the bucket boundaries that leave
the least padding.  Inside a bucket, batches of a token budget form along a
dense numbering of the pieces, which is made from counts per share of a bucket
so that a bucket with most of the rows is dealt over many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm._shared import materialize, table, word_count

MAX_LENGTH, BUCKETS, TOKEN_BUDGET = 2048, 12, 32768
#: Pieces in a share of a bucket, about.
SHARE = 1 << 14


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds, ascending, of at most `buckets` buckets such that padding each length to its bound wastes least.

    The last bound is the greatest length.  Of equal answers the one with
    earlier bounds is taken.
    """
    lengths = sorted(x for x, n in histogram.items() if n > 0)
    if not lengths:
        return []
    upto = np.concatenate([[0], np.cumsum([histogram[x] for x in lengths])]).astype(np.int64)
    m, bound = len(lengths), np.array(lengths, np.int64)
    far = np.iinfo(np.int64).max // 4
    # best[i]: least padded total of the first i lengths with the buckets so far.
    best = np.concatenate([[0], np.full(m, far)])
    cuts = []
    for _ in range(min(buckets, m)):
        after, cut = np.full(m + 1, far), np.zeros(m + 1, np.int64)
        for i in range(1, m + 1):
            total = best[:i] + bound[i - 1] * (upto[i] - upto[:i])
            cut[i] = int(total.argmin())
            after[i] = total[cut[i]]
        best, cuts = after, [*cuts, cut]
    out, i = [], m
    for cut in reversed(cuts):
        out.append(lengths[i - 1])
        i = int(cut[i])
        if i == 0:
            break
    return out[::-1]


def pieces(docs: DataFrame, length: Column, max_length: int = MAX_LENGTH) -> DataFrame:
    """(doc_id, piece, start, length): each row cut into sequences of max_length tokens and a rest.

    A row without tokens, its text null or empty, gives one piece of length 0.  Other columns are left out.
    """
    held = docs.select("doc_id", F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / max_length) - 1).cast("int")
    rows = held.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * max_length
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(max_length)).cast("int").alias("length"))


def pack(rows: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """rows (doc_id, piece, start, length) with bucket (from 0), bucket_length, batch (dense from 0 in a bucket) and slot added.

    A batch holds as many pieces as its budget has room for at the bucket's
    length, one at least.  An empty table gives no rows.  Repeated rows are
    pieces of their own; they, and rows with a null doc_id, are dealt by their
    place in the table, so that one doc_id may have any number of rows.
    """
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most max_length + 1
    bounds = optimal_boundaries(counts, buckets)
    if not bounds:
        bounds = [0]
    sizes = [0] * len(bounds)
    for n, c in counts.items():
        sizes[next(i for i, b in enumerate(bounds) if n <= b)] += c
    bucket = F.lit(len(bounds) - 1)
    for i in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("length") <= bounds[i], F.lit(i)).otherwise(bucket)
    pick = lambda xs: F.element_at(F.array(*[F.lit(int(x)) for x in xs]), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("bucket_length", pick(bounds))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "_row"), pick([-(-n // SHARE) or 1 for n in sizes])).cast("int"))
    held = rows.groupBy("bucket", "share").agg(F.count(F.lit(1)).alias("n"))
    # A row for SHARE pieces: counts only.
    before = held.withColumn(
        "before", F.sum("n").over(Window.partitionBy("bucket").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    ).select("bucket", "share", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("bucket", "share").orderBy(F.xxhash64("doc_id", "piece", "_row", F.lit("slot")), "doc_id", "piece", "_row")
    rows = rows.withColumn("within", F.row_number().over(order) - 1).join(before, ["bucket", "share"])
    room = pick([max(1, token_budget // max(1, b)) for b in bounds])
    rank = F.col("before") + F.col("within")
    return rows.select(
        "doc_id", "piece", "start", "length", "bucket", "bucket_length", F.floor(rank / room).cast("long").alias("batch"), F.pmod(rank, room).cast("int").alias("slot")
    )


def op7_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents in their batches; tokens are words between white space."""
    docs = table(spark, sf_dir, "documents")
    return pack(pieces(docs, word_count(F.col("text"))))
