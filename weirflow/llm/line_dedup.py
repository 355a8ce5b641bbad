"""Line dedup: content-defined chunks of lines, of which repeats are removed.

A rolling hash over the hashes of the last lines chooses where a chunk ends,
so an insertion moves only nearby boundaries.  Chunks are grouped by their
bytes; of each group the first occurrence, by doc_id and place, stays.  A
repeat is extended on both sides by the lines of the neighbouring chunks that
are the same as beside the first occurrence, and goes with them if that makes
two lines or more.  So a passage that several documents share goes whole once
it holds a chunk, also one of a single line.  Every line that goes has an equal
one before it.  All of it is DataFrame functions.

Grouping is by the chunk's own bytes, combined before the shuffle, so copies
cost one row a task.  Occurrences then find their group by its 64-bit hash
alone, in narrow rows; the few hashes that stand for more than one text are
settled by the bytes instead.  Neighbouring lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm._shared import SPACE_CHARS, let, materialize, table

#: Lines that the rolling hash covers, a power of two, and one boundary in so many lines.
ROLLING, ONE_IN = 2, 2
#: Base and modulus of the rolling hash.
BASE, MODULUS = 1000003, (1 << 31) - 1


def chunk_ends(lines: Column, rolling: int = ROLLING, one_in: int = ONE_IN) -> Column:
    """Line numbers, from 1, after which a chunk ends; the last is the number of lines.

    A line's hash is the first 32 bits of its MD5.  The polynomial hash of the last `rolling` lines is made
    from those of half as many, so each line costs a step for each doubling; a boundary falls where it is 0
    modulo `one_in`.
    """
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))

    def doubled(h: Column, half: int) -> Column:
        if half == rolling:
            n = F.size(h)
            return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(h, i - 1) % one_in == 0))
        power = pow(BASE, half, MODULUS)
        longer = F.transform(h, lambda x, i: (x + power * F.coalesce(F.get(h, i - half), F.lit(0))) % MODULUS)
        return let(longer, lambda x: doubled(x, 2 * half))

    return let(hashes, lambda h: doubled(h, 1))


def line_chunks(text: Column) -> Column:
    """Chunks of a text as structs (place from 0, start, n_lines, content, before, after).

    start is the number of its first line, from 0; before and after are the hashes of the lines of the two chunks
    before it, nearest first, and of that after it: inside a shared passage all boundaries are the same, but for
    those after its first lines, fewer than `rolling`.  A null or empty text has none.
    """

    def body(lines: Column) -> Column:
        def cut(ends: Column, x: Column) -> Column:
            at = lambda j: F.coalesce(F.get(ends, j), F.lit(0))
            size = lambda j: at(j) - at(j - 1)
            return F.transform(
                ends,
                lambda e, j: F.struct(
                    j.alias("place"),
                    at(j - 1).alias("start"),
                    size(j).alias("n_lines"),
                    F.concat_ws("\n", F.slice(lines, at(j - 1) + 1, size(j))).alias("content"),
                    F.reverse(F.slice(x, at(j - 3) + 1, at(j - 1) - at(j - 3))).alias("before"),
                    F.slice(x, e + 1, F.greatest(F.lit(0), at(j + 1) - e)).alias("after"),
                ),
            )

        return let(chunk_ends(lines), lambda ends: let(F.transform(lines, lambda v: F.xxhash64(v)), lambda x: cut(ends, x)))

    empty = F.array().cast("array<struct<place:int,start:int,n_lines:int,content:string,before:array<bigint>,after:array<bigint>>>")
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(let(F.split(text, "\n", -1), body))


def alike(a: Column, b: Column) -> Column:
    """How many first elements of two arrays are the same."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(F.array_position(same, F.lit(False)), lambda p: F.when(p == 0, F.size(same)).otherwise(p - 1)).cast("int")


def removable(docs: DataFrame) -> DataFrame:
    """(doc_id, t, gone): for each text with repeats the lines to remove, as structs (first, end), a struct for each repeated chunk.

    Rows need doc_id and text; t is the hash of the text, by which rows with the same doc_id are told apart.
    A chunk that occurs again in the same document is a repeat like any other; one without a word only goes
    beside another.  Null doc_ids count as before all others, and rows with the same doc_id and text as one.
    """
    # Both are made before the rows multiply: a text is hashed once and not once a chunk.
    each = docs.select("doc_id", F.xxhash64("text").alias("t"), line_chunks(F.col("text")).alias("cs")).select("doc_id", "t", F.explode("cs").alias("c"))
    each = each.where(F.btrim("c.content", F.lit(SPACE_CHARS)) != "").select("doc_id", "t", "c.*", F.xxhash64("c.content").alias("h"))
    first = F.min(F.struct("doc_id", "t", "place", "before", "after"))
    groups = each.groupBy("h", "content").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialize(
        groups.groupBy("h")
        .agg(F.count(F.lit(1)).alias("texts"), F.max("n").alias("n"), F.first("first").alias("first"))
        .where("n > 1 or texts > 1"),
        "chunk-groups",
    )

    def ranges(occurrences: DataFrame) -> DataFrame:
        lo, hi = alike(F.col("before"), F.col("first.before")), alike(F.col("after"), F.col("first.after"))
        later = ~F.struct("doc_id", "t", "place").eqNullSafe(F.struct("first.doc_id", "first.t", "first.place"))
        rows = occurrences.where(later).select("doc_id", "t", "start", "n_lines", lo.alias("lo"), hi.alias("hi"))
        gone = F.struct((F.col("start") - F.col("lo")).alias("first"), (F.col("start") + F.col("n_lines") + F.col("hi")).alias("end"))
        return rows.where("lo + n_lines + hi >= 2").select("doc_id", "t", gone.alias("gone"))

    rows = ranges(each.drop("content").join(groups.where("texts = 1").select("h", "first"), "h"))
    shared = groups.where("texts > 1").select("h")
    if not shared.isEmpty():  # hashes that more than one text has: found again by the bytes themselves
        exact = each.join(shared, "h")
        rows = rows.unionAll(ranges(exact.join(exact.groupBy("content").agg(first.alias("first")), "content")))
    return rows.groupBy("doc_id", "t").agg(F.collect_set("gone").alias("gone"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with `text` less its repeated lines, and n_lines, n_removed (chunks) and n_removed_lines added.

    Every row stays, with an empty text if all its lines go; a null text stays
    null.  An empty table gives no rows.  Columns of docs with these names are replaced.
    """
    added = ("n_lines", "n_removed", "n_removed_lines")
    docs = docs.drop(*added)
    gone = materialize(removable(docs.select("doc_id", "text")), "gone").toDF("_id", "_t", "_gone")
    # gone grows with the input, so it is never broadcast: small inputs take the path of large ones.
    on = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_t"])
    rows = docs.join(gone.hint("merge"), on, "left").drop("_id", "_t")

    def judged(lines: Column) -> Column:
        numbers = F.flatten(F.transform("_gone", lambda r: F.sequence(r["first"], r["end"] - 1)))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers)
        kept = let(
            stay,
            lambda s: F.struct(
                F.array_join(F.transform(s, lambda i: F.get(lines, i)), "\n").alias("text"),
                F.size(lines).cast("long").alias("n_lines"),
                F.size("_gone").cast("long").alias("n_removed"),
                (F.size(lines) - F.size(s)).cast("long").alias("n_removed_lines"),
            ),
        )
        nothing = F.struct(F.col("text"), F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_removed_lines"))
        return F.when(F.col("_gone").isNull(), nothing).otherwise(kept)

    lines = F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1))
    rows = rows.withColumn("_j", let(lines, judged))
    return rows.select(*[F.col("_j.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], *[F.col(f"_j.{c}") for c in added])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines, repeated chunks and lines removed, and the length and SHA-256 of the text that stays."""
    rows = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id",
        "n_lines",
        "n_removed",
        "n_removed_lines",
        F.char_length(text).cast("long").alias("kept_chars"),
        F.sha2(text, 256).alias("kept_sha256"),
    )


def _alike_sql(a: str, b: str) -> str:
    n = f"least(len({a}), len({b}))"
    return f"coalesce(nullif(list_position([{a}[k] = {b}[k] for k in range(1, {n} + 1)], false), 0) - 1, {n})"


OP1_SQL = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i, len(ls) AS n FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
r AS (SELECT *, (h + {BASE} * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {MODULUS} AS r FROM h),
e AS (SELECT *, CASE WHEN i = n OR r % {ONE_IN} = 0 THEN i END AS b FROM r),
s AS (SELECT *, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
c AS (SELECT doc_id, start, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS content, list(line ORDER BY i) AS ls FROM s GROUP BY doc_id, start),
x AS (
  SELECT *, list_concat(coalesce(list_reverse(lag(ls) OVER w), []), coalesce(list_reverse(lag(ls, 2) OVER w), [])) AS before, coalesce(lead(ls) OVER w, []) AS after FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY start)
),
f AS (
  SELECT *, first_value(struct_pack(doc_id := doc_id, start := start, before := before, after := after)) OVER (PARTITION BY content ORDER BY doc_id, start) AS org
  FROM x WHERE trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
),
g AS (
  SELECT doc_id, start, n_lines, {_alike_sql('before', 'org.before')} AS lo, {_alike_sql('after', 'org.after')} AS hi
  FROM f WHERE doc_id <> org.doc_id OR start <> org.start
),
o AS (SELECT DISTINCT doc_id, start - lo AS a, start + n_lines + hi AS b FROM g WHERE lo + n_lines + hi >= 2),
z AS (SELECT DISTINCT doc_id, unnest(range(a + 1, b + 1)) AS i FROM o),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(z.i) AS n_removed_lines, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE z.i IS NULL), '') AS kept
  FROM l LEFT JOIN z ON l.doc_id = z.doc_id AND l.i = z.i GROUP BY l.doc_id
),
m AS (SELECT doc_id, count(*) AS n_removed FROM o GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines,
  CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)"""
