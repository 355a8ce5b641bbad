"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of training texts.
A text is encoded with every dictionary and gets the language whose encoding
is smallest.  Texts are encoded in whole, in pieces short enough for the
dictionary to matter throughout.  Where the best two sizes are close the
document is rejected, which a caller may act on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirflow.llm._shared import table

UNDETERMINED = "und"
PIECE = 4096
#: One level for texts of any length, so that no length changes how a text is judged.
LEVEL = 7
#: Bounds of the sample that is learned from: languages, texts of a language and in all, bytes of a dictionary and of all.
LANGUAGES, TEXTS, ALL_TEXTS, BYTES, ALL_BYTES = 1024, 192, 65536, 128 << 10, 64 << 20
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters_only(text: str) -> bytes:
    """The text in lower case with a space for each run of other characters, so that layout and symbols don't decide."""
    return OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


@dataclass
class Model:
    """Dictionaries by language, in the order in which ties are settled."""

    dictionaries: dict[str, bytes]
    level: int = LEVEL
    _coders: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_coders": []}

    def sizes(self, text: str) -> list[int]:
        """Encoded bytes with each dictionary."""
        if not self._coders:
            for d in self.dictionaries.values():
                held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=self.level)
                self._coders.append(zstandard.ZstdCompressor(level=self.level, dict_data=held, write_content_size=False, write_dict_id=False))
        data = letters_only(text)
        pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)] or [b""]
        return [sum(len(c.compress(p)) for p in pieces) for c in self._coders]

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language and margin: how much smaller the best encoding is than the next, from 0 to 1."""
        if text is None or not self.dictionaries or not LETTER.search(text):
            return UNDETERMINED, 0.0
        names, sizes = list(self.dictionaries), self.sizes(text)
        ranked = sorted(range(len(names)), key=sizes.__getitem__)
        if len(ranked) == 1:
            return names[0], 1.0
        best, second = sizes[ranked[0]], sizes[ranked[1]]
        return names[ranked[0]], (second - best) / second


def fit(labelled: DataFrame, languages: int = LANGUAGES, texts: int = TEXTS, dictionary_bytes: int = BYTES) -> Model:
    """Dictionaries from rows (text, lang); nothing else of a row is looked at.

    The sample is bounded: the `languages` most frequent languages; of each at most `texts` different texts,
    those with the least hashes, and fewer where ALL_TEXTS or ALL_BYTES would be passed; and of them
    dictionary_bytes a language.  So what is collected and sent to the tasks does not grow with the corpus.
    Rows with a null or empty text or a null language are left out, and texts that repeat count once.  Ties
    between languages go to the one with more documents.  An empty table gives a model that knows no language.
    """
    rows = labelled.where("lang is not null and text is not null and length(text) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    each = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("different"))
    held = each.orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not held:
        return Model({})
    counts = {r["lang"]: r["n"] for r in held}
    texts = max(1, min(texts, ALL_TEXTS // len(counts)))
    dictionary_bytes = min(dictionary_bytes, ALL_BYTES // len(counts))
    # Hashes below a bound that some four times as many different texts as are wanted pass; copies fold before the shuffle.
    bounds = [(r["lang"], min((1 << 63) - 1, (4 * texts << 64) // r["different"] - (1 << 63))) for r in held]
    bounds = labelled.sparkSession.createDataFrame(bounds, "lang string, most long")
    rows = rows.withColumn("lang", F.col("lang").cast("string")).join(F.broadcast(bounds), "lang").where("h <= most")  # a row a language
    by = Window.partitionBy("lang").orderBy("h")
    ids = rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(by)).where(f"n <= {texts}").select("lang", "h")
    # A text may give at most an eighth, so that one long text can't be the whole dictionary.
    share = dictionary_bytes // 8
    picked = rows.join(F.broadcast(ids), ["lang", "h"])  # at most ALL_TEXTS rows
    picked = picked.groupBy("lang", "h").agg(F.min(F.substring("text", 1, share)).alias("text"))
    found: dict[str, list] = {}
    for r in picked.toLocalIterator():
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out = {}
    for lang in sorted(found, key=lambda x: (-counts[x], x)):
        parts, room = [], dictionary_bytes
        for _, text in sorted(found[lang]):
            part = letters_only(text)[: min(room, share)]
            parts.append(part)
            room -= len(part)
            if room <= 0:
                break
        out[lang] = b"".join(reversed(parts))
    return Model(out)


def identify(docs: DataFrame, model: Model, min_margin: float = 0.005) -> DataFrame:
    """docs with lang_pred, score and rejected added; columns of docs with these names are replaced.

    Every row stays, repeated ones too, and an empty table gives no rows.  A null text or one without letters is `und` with score 0 and is rejected;
    else a document is rejected if its score, the margin between the best two
    sizes, is below min_margin.
    """
    rows = docs.drop("lang_pred", "score", "rejected")
    names = rows.columns
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most ALL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            got = [own.classify(t.as_py()) for t in batch.column("text")]
            lang, score = [g[0] for g in got], [g[1] for g in got]
            rejected = [a == UNDETERMINED or b < min_margin for a, b in got]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [*names, "lang_pred", "score", "rejected"],
            )

    kind = StructType([*rows.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(run, kind)


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: whether it was held out, the language found, and the margin between the best two sizes."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
