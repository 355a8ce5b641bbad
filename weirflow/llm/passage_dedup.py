"""Removal of repeated passages by prefix-free parsing.

Texts are cut into phrases by rolling-hash triggers: of the hashes in the span
of one match (50 bytes) the least names the trigger, so equal strings have the
same trigger at the same place.  All matches that share a trigger start in one
run of positions; the phrase of that run, extended by the match length,
contains each of them whole.  Phrases form the dictionary, and the order of
their occurrences in the corpus, by document, is the parse.

1. Texts are gathered in chunks, and each phrase that a chunk has is sent once,
   as trigger hash, phrase hash and first document, to the bucket of its trigger.
   Later occurrences in the chunk are repeats already, so a passage that very
   many documents share gives its bucket one row a chunk.
2. A bucket holds every phrase with its triggers.  A phrase that an earlier
   document has is a repeat as a whole.  A trigger that only one document has,
   or that only one phrase has, is settled too.  In copied text that is nearly
   all of it.
3. For triggers with several phrases, one occurrence of each phrase sends its
   bytes.  They are the dictionary, whose suffix array is built to the depth of
   a match, by the bytes themselves, with the places where neighbours part
   before that depth.  The parse, in the order of its phrases' ranks and then of
   the corpus, says which document has each phrase first; along a run of
   suffixes that agree in a whole match the least of these is the first
   document of that match.
4. Each chunk joins what it was told and removes the covered bytes.

Since a match is no longer than what a phrase is extended by, suffixes that tie
in the dictionary need not be told apart by what follows in the parse: its
suffix array is needed to the depth of one phrase.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm._shared import materialize, table

MATCH = 50
TRIGGER = 20
SPAN = MATCH - TRIGGER + 1
#: Bytes of text in a chunk, and of text whose phrases share a bucket, up to PLAIN bytes in all.  A (chunk, bucket)
#: pair is one row, so both grow with the root of what is beyond, up to MOST times, which is what memory bounds.
CHUNK_BYTES, BUCKET_BYTES, PLAIN, MOST = 4 << 20, 16 << 20, 100 << 30, 4
LAST = np.iinfo(np.int64).max

_rng = np.random.default_rng(20261126)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C, _P = (np.uint64(int(x) * 2 + 1) for x in _rng.integers(1 << 61, 1 << 63, 4))

#: What a bucket says of an occurrence.
NEW, REPEAT, ASK = 0, 1, 2


def pack(a: np.ndarray) -> bytes:
    """Bytes of an array, by significance, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def trigger_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the TRIGGER bytes at each position."""
    n = len(data) - TRIGGER + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = words[:n] * _A
    h ^= h >> np.uint64(32)
    h += words[8 : n + 8]
    h *= _B
    h ^= h >> np.uint64(32)
    h += words[TRIGGER - 8 : n + TRIGGER - 8]
    h *= _P
    return _mix(h)


_power = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first n powers of _P, kept for the next call unless a single text asks for very many."""
    global _power
    if len(_power) >= n:
        return _power[:n]
    out = np.full(n, _P)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if n <= 4 * CHUNK_BYTES:
        _power = out
    return out


def stretch_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of the data."""
    n = len(data)
    power = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    return _mix((total[start + size] - total[start]) * power[n - start] + np.asarray(size).astype(np.uint64) * _A)


class Parse:
    """Phrases of a chunk: the first start of each, the number of starts, the document, and its trigger's hash."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, lens: np.ndarray, block: int = (1 << 19) - 64) -> None:
        self.ids, self.data, self.lens = ids, data, lens
        self.offsets = np.concatenate([[0], np.cumsum(lens)])[:-1]
        n = max(0, len(data) - MATCH + 1)
        at = np.empty(n, np.int64)
        key = np.zeros(n and len(data) - TRIGGER + 1, np.uint64)
        low = np.uint32((1 << 19) - 1)
        for b in range(0, n, block):
            part = data[b : min(b + block, n) + MATCH - 1]
            h = trigger_hashes(part)
            key[b : b + len(h)] = h
            # The top 13 bits choose, and of equal ones the first place.
            h = ((h >> np.uint64(51)).astype(np.uint32) << np.uint32(19)) | np.arange(len(h), dtype=np.uint32)
            size = 1
            while size * 2 <= SPAN:
                h = np.minimum(h[:-size], h[size:])
                size *= 2
            if size < SPAN:
                h = np.minimum(h[: -(SPAN - size)], h[SPAN - size :])
            at[b : b + len(h)] = (h & low).astype(np.int64) + b
        ok = np.ones(n, bool)
        for o, m in zip(self.offsets.tolist(), lens.tolist(), strict=True):
            ok[max(o, o + m - MATCH + 1) : o + m] = False
        first = ok.copy()
        first[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
        self.start = np.flatnonzero(first)
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        ends = np.append(self.start[1:], n)
        self.size = np.minimum(ends, (self.offsets + lens - MATCH + 1)[self.doc]) - self.start
        self.trigger = key[at[self.start]]

    def phrase_hashes(self) -> np.ndarray:
        """A 64-bit hash of each phrase with the bytes that extend it."""
        return stretch_hashes(self.data, self.start, self.size + MATCH - 1)

    def deduplicate(self) -> np.ndarray:
        """Set `heads`, the first occurrence of each distinct phrase, and for all phrases `head_at`, its place there; return the hashes of the heads."""
        phrases = self.phrase_hashes()
        order = np.argsort(phrases, kind="stable")  # the chunk's documents stand by doc_id
        new = np.append(True, phrases[order][1:] != phrases[order][:-1])[: len(order)]
        head = order[new][np.cumsum(new) - 1] if len(order) else order
        if len(odd := order[~self.same_bytes(order, head)]):
            # Phrases that share a hash but not their bytes get hashes that nothing else has, so step 3 compares them.
            phrases[odd] ^= _mix(odd.astype(np.uint64) * _A + self.trigger[odd])
            order = np.argsort(phrases, kind="stable")
            new = np.append(True, phrases[order][1:] != phrases[order][:-1])[: len(order)]
        self.heads = order[new]
        self.head_at = np.empty(len(order), np.int64)
        self.head_at[order] = np.cumsum(new) - 1
        return phrases[self.heads]

    def same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each phrase of a has the bytes of that of b, eight at a time."""
        same = self.size[a] == self.size[b]
        pairs = np.flatnonzero((a != b) & same)
        words = np.ndarray((max(0, len(self.data) - 7),), "<u8", self.data, strides=(1,))
        last = self.size[a[pairs]] + MATCH - 1 - 8
        for step in range(0, int(last.max(initial=-8)) + 8, 8):
            at = np.minimum(step, last)
            same[pairs] &= words[self.start[a[pairs]] + at] == words[self.start[b[pairs]] + at]
        return same

    def buckets(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket with the places of its phrases in `heads`, in order; none for texts that are all shorter than a match."""
        if not len(self.heads):
            return
        bucket = ((self.trigger[self.heads] >> np.uint64(40)) % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        held, at = np.unique(bucket[order], return_index=True)
        for b, own in zip(held.tolist(), np.split(order, at[1:]), strict=True):
            yield b, own


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (chunk, ids, lens, data): whole texts as UTF-8 by doc_id, gathered up to chunk_bytes or one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, n = [], [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            by_id = sorted(range(len(ids)), key=ids.__getitem__)
            lens = np.array([len(texts[i]) for i in by_id], np.int64)
            data = zstandard.ZstdCompressor(level=3).compress(b"".join([texts[i] for i in by_id]))
            held = [pack(np.array([ids[i] for i in by_id], np.int64)), pack(lens), data]
            return pa.RecordBatch.from_arrays(
                [pa.array([task + n], pa.int64()), *(pa.array([x], pa.binary()) for x in held)], ["chunk", "ids", "lens", "data"]
            )

        for batch in batches:
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = (t.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(i.as_py() if i.is_valid else LAST)
                texts.append(text)
                size += len(text)
                if size >= chunk_bytes or len(ids) >= 1 << 16:
                    yield row()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "chunk long, ids binary, lens binary, data binary")


def _opened(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, Parse]:
    ids, lens, data = (batch.column(c)[k].as_py() for c in ("ids", "lens", "data"))
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    held = unpack(ids, np.int64)
    return held, Parse(held, text, unpack(lens, np.int64))


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)


def _deltas(ids: np.ndarray) -> np.ndarray:
    return np.diff(ids, prepend=np.int64(0))


def phrase_rows(chunked: DataFrame, n_buckets: int) -> DataFrame:
    """Rows (bucket, chunk, triggers, phrases, docs) for each bucket that a chunk has phrases for."""
    names, kinds = ["bucket", "chunk", "triggers", "phrases", "docs"], [pa.int32(), pa.int64(), *[pa.binary()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, parse = _opened(batch, k)
                phrases, chunk = parse.deduplicate(), batch.column("chunk")[k].as_py()
                low, docs = parse.trigger[parse.heads].astype(np.uint32), ids[parse.doc[parse.heads]]
                yield _rows(
                    names,
                    kinds,
                    [(b, chunk, low[own].tobytes(), phrases[own].tobytes(), pack(_deltas(docs[own]))) for b, own in parse.buckets(n_buckets)],
                )

    return chunked.mapInArrow(run, "bucket int, chunk long, triggers binary, phrases binary, docs binary")


def judge(trigger: np.ndarray, phrase: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """NEW, REPEAT or ASK for each occurrence in a bucket."""
    order = np.lexsort((doc, phrase, trigger))
    t, p, d = trigger[order], phrase[order], doc[order]
    new_t = np.append(True, t[1:] != t[:-1])
    new_p = new_t.copy()
    new_p[1:] |= p[1:] != p[:-1]
    at_t, at_p = np.flatnonzero(new_t), np.flatnonzero(new_p)
    group_t, group_p = np.cumsum(new_t) - 1, np.cumsum(new_p) - 1
    least, most = np.minimum.reduceat(d, at_t), np.maximum.reduceat(d, at_t)
    phrases = np.add.reduceat(new_p.astype(np.int64), at_t)
    repeat = d > d[at_p][group_p]
    ask = ~repeat & ((phrases > 1) & (least < most))[group_t]
    out = np.empty(len(order), np.uint8)
    out[order] = np.where(repeat, REPEAT, np.where(ask, ASK, NEW))
    return out


def verdicts(rows: DataFrame) -> DataFrame:
    """(chunk, bucket, verdict) for the occurrences of each phrase row, in its order."""

    def run(held: pa.Table) -> pa.Table:
        trigger = [np.frombuffer(x.as_py(), np.uint32) for x in held["triggers"]]
        phrase = [np.frombuffer(x.as_py(), np.uint64) for x in held["phrases"]]
        doc = [np.cumsum(unpack(x.as_py(), np.int64)) for x in held["docs"]]
        out = judge(np.concatenate(trigger), np.concatenate(phrase), np.concatenate(doc))
        parts = np.split(out, np.cumsum([len(x) for x in trigger])[:-1])
        return pa.table({"chunk": held["chunk"], "bucket": held["bucket"], "verdict": pa.array([pack(x) for x in parts], pa.binary())})

    return rows.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, verdict binary")


def _told(batch: pa.RecordBatch, k: int, name: str) -> dict[int, bytes]:
    return {x["bucket"]: x["told"] for x in batch.column(name)[k].as_py() or ()}


def dictionary_rows(judged: DataFrame, n_buckets: int) -> DataFrame:
    """Rows (bucket, chunk, triggers, docs, sizes, bytes) of the phrases that need comparing byte by byte."""
    names = ["bucket", "chunk", "triggers", "docs", "sizes", "bytes"]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                told = _told(batch, k, "verdicts")
                ids, parse = _opened(batch, k)
                parse.deduplicate()
                chunk, out = batch.column("chunk")[k].as_py(), []
                for b, own in parse.buckets(n_buckets):
                    own = parse.heads[own[unpack(told[b], np.uint8) == ASK]]
                    if not len(own):
                        continue
                    sizes = parse.size[own] + MATCH - 1
                    ends = np.cumsum(sizes)
                    take = np.arange(ends[-1]) + np.repeat(parse.start[own] - ends + sizes, sizes)
                    out.append(
                        (b, chunk, parse.trigger[own].astype(np.uint32).tobytes(), pack(_deltas(ids[parse.doc[own]])), sizes.astype(np.uint8).tobytes(), zstandard.ZstdCompressor(level=1).compress(parse.data[take].tobytes()))
                    )
                yield _rows(names, kinds, out)

    return judged.mapInArrow(run, "bucket int, chunk long, triggers binary, docs binary, sizes binary, bytes binary")


def suffix_array(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the suffixes at these places in the order of their first MATCH bytes, and which differ in them from the one before.

    Suffixes that tie are sorted on by their next eight bytes, until none ties or the depth of a match is reached.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    # The last eight bytes of a match overlap the ones before, which are the same by then.
    spots = [*range(0, MATCH - 7, 8), *([MATCH - 8] if MATCH % 8 else [])]
    first = words[at].astype(np.uint64)
    order = np.argsort(first)
    new = np.append(True, first[order][1:] != first[order][:-1])
    for spot in spots[1:]:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        group, own = (np.cumsum(new) - 1)[tied], order[tied]
        key = words[at[own] + spot].astype(np.uint64)
        by_key = np.argsort(key)
        rank = np.empty(len(key), np.int64)
        rank[by_key] = np.cumsum(np.append(False, key[by_key][1:] != key[by_key][:-1]))
        both = group << np.int64(32) | rank
        within = np.argsort(both)
        order[tied] = own[within]
        both = both[within]
        new[tied] = np.append(True, both[1:] != both[:-1])
    return order, new


def repeated_starts(data: np.ndarray, sizes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each phrase of a dictionary a bit for each start whose match an earlier document has.

    doc is the parse: the document of each occurrence.  Only suffixes of at least MATCH bytes are sorted.
    """
    starts = sizes - MATCH + 1
    owner = np.repeat(np.arange(len(sizes)), starts)
    place = np.arange(len(owner)) - (np.cumsum(starts) - starts)[owner]
    order, new = suffix_array(data, (np.cumsum(sizes) - sizes)[owner] + place)
    runs = np.flatnonzero(new)
    # Each run's suffixes stand for the occurrences of their phrases; the parse puts the least document first.
    owned = doc[owner[order]]
    least = np.minimum.reduceat(owned, runs)
    found = order[least[np.cumsum(new) - 1] < owned]
    bits = np.zeros(len(sizes), np.uint64)
    np.bitwise_or.at(bits, owner[found], np.uint64(1) << place[found].astype(np.uint64))
    return bits


def answers(rows: DataFrame) -> DataFrame:
    """(chunk, bucket, answer) for the phrases of each dictionary row, in its order."""

    def run(held: pa.Table) -> pa.Table:
        sizes = [np.frombuffer(x.as_py(), np.uint8).astype(np.int64) for x in held["sizes"]]
        doc = np.concatenate([np.cumsum(unpack(x.as_py(), np.int64)) for x in held["docs"]])
        trigger = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in held["triggers"]])
        data = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint8) for x in held["bytes"]])
        size = np.concatenate(sizes)
        # Phrases with different triggers have no match in common, so the dictionary is sorted in parts that keep triggers whole.
        order = np.argsort(trigger, kind="stable")
        bits = np.zeros(len(size), np.uint64)
        at = np.cumsum(size) - size
        edges = np.flatnonzero(np.append(True, trigger[order][1:] != trigger[order][:-1]))
        cut = [0]
        for e in edges.tolist()[1:]:
            if e - cut[-1] >= 1 << 16:
                cut.append(e)
        for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
            own = order[a:b]
            ends = np.cumsum(size[own])
            take = np.arange(ends[-1]) + np.repeat(at[own] - ends + size[own], size[own])
            bits[own] = repeated_starts(data[take], size[own], doc[own])
        parts = np.split(bits, np.cumsum([len(x) for x in sizes])[:-1])
        return pa.table({"chunk": held["chunk"], "bucket": held["bucket"], "answer": pa.array([pack(x) for x in parts], pa.binary())})

    return rows.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, answer binary")


def removed_bytes(parse: Parse, told: dict[int, bytes], answered: dict[int, bytes], n_buckets: int) -> np.ndarray:
    """Which bytes of a chunk are covered by a match that an earlier document has."""
    parse.deduplicate()
    repeat = np.zeros(len(parse.heads), bool)
    bits = np.zeros(len(parse.heads), np.uint64)
    for b, own in parse.buckets(n_buckets):
        verdict = unpack(told[b], np.uint8)
        repeat[own] = verdict == REPEAT
        if b in answered:
            bits[own[verdict == ASK]] = unpack(answered[b], np.uint64)
    whole = repeat[parse.head_at] | (parse.ids[parse.doc] > parse.ids[parse.doc[parse.heads]][parse.head_at])
    bits = np.where(whole, np.uint64(0), bits[parse.head_at])
    step = np.zeros(len(parse.data) + 1, np.int32)
    np.add.at(step, parse.start[whole], 1)
    np.add.at(step, parse.start[whole] + parse.size[whole] + MATCH - 1, -1)
    some = np.flatnonzero(bits)
    for place in range(SPAN):
        at = parse.start[some[(bits[some] >> np.uint64(place)) & np.uint64(1) > 0]] + place
        np.add.at(step, at, 1)
        np.add.at(step, at + MATCH, -1)
    return np.cumsum(step[:-1]) > 0


def without_repeats(docs: DataFrame, chunk_bytes: int | None = None, bucket_bytes: int | None = None, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of docs.

    A byte is removed if a string of MATCH bytes that covers it starts in a
    document with a smaller doc_id too.  Null texts are empty.  A null doc_id
    comes after all others.  Rows that share a doc_id are one document as far
    as "earlier" goes.  An empty table gives no rows.  kept holds the remaining
    bytes, which need not be whole characters.  Other columns of docs are left
    out.  Chunks and buckets follow the size of the table unless they are given.
    """
    if chunk_bytes is None or bucket_bytes is None:
        total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        times = min(MOST, max(1, math.sqrt(total / PLAIN)))
        chunk_bytes, bucket_bytes = chunk_bytes or int(CHUNK_BYTES * times), bucket_bytes or int(BUCKET_BYTES * times)
    chunked = materialize(chunks(docs, chunk_bytes), "chunks")
    n_chunks = chunked.count()
    n_buckets = max(4, -(-n_chunks * chunk_bytes // bucket_bytes))

    def told(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.groupBy("chunk").agg(F.collect_list(F.struct("bucket", F.col(column).alias("told"))).alias(name))

    said = materialize(verdicts(phrase_rows(chunked, n_buckets)), "verdicts")
    judged = chunked.join(told(said, "verdict", "verdicts"), "chunk")
    found = materialize(answers(dictionary_rows(judged, n_buckets)), "answers")
    last = chunked.join(told(said, "verdict", "verdicts"), "chunk", "left").join(told(found, "answer", "answers"), "chunk", "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if keep_text else 5]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, parse = _opened(batch, k)
                gone = removed_bytes(parse, _told(batch, k, "verdicts"), _told(batch, k, "answers"), n_buckets)
                out = []
                for i, o, m in zip(ids.tolist(), parse.offsets.tolist(), parse.lens.tolist(), strict=True):
                    g = gone[o : o + m]
                    kept = parse.data[o : o + m][~g].tobytes()
                    spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(m > 0 and g[0])
                    out.append((None if i == LAST else i, m, m - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
                yield _rows(names, kinds, out)

    return last.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its bytes, those removed and in how many runs, and the SHA-256 of the rest."""
    return without_repeats(table(spark, sf_dir, "documents"))


#: Two hexadecimal digits stand for a byte.
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - {MATCH - 1})) AS p, h FROM d WHERE len(h) >= {2 * MATCH}),
x AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * MATCH}) AS s FROM w),
m AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
c AS (SELECT doc_id, p FROM x JOIN m USING (s) WHERE first < doc_id),
o AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {MATCH} THEN 0 ELSE 1 END AS opens FROM c),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
s AS (SELECT doc_id, min(p) AS a, max(p) + {MATCH} AS b FROM r GROUP BY doc_id, run),
k AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
t AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)"""
