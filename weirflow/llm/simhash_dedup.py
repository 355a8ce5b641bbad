"""SimHash near-dedup by tiled exact comparison.

Fingerprints are collapsed to distinct values first, so copies cost one row.
Distinct fingerprints are laid out in tiles by the population counts of their
four 16-bit quarters.  Every differing bit changes one quarter's count by one,
so two tiles whose counts differ by more than the radius in sum cannot hold a
link and the pair is skipped; all other tile pairs are compared in full with
numpy exclusive-or and bit counts.  A large cell is dealt over several tiles,
so no task holds more than two tiles at once.

`similar_groups` is for corpora: texts that share at least four fifths of their
five-word shingles.  Such texts differ in about ten bits, and in up to eighteen;
with that radius no pair of tiles could be skipped and one random pair in a
thousand would pass.  So besides the tiles, bands of MinHash values propose
pairs, and every pair is judged by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm._graph import components
from weirflow.llm._shared import materialize, table

SEED = 42
TILE = 2048
QUARTER = 16
#: Of similar_groups: words in a shingle and least Jaccard similarity; bands, values in a band, and members of which all pairs are judged.
SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS, FEW = 24, 6, 8
#: Least number of equal signature bytes, of BANDS x ROWS, for a pair of a large group to be judged; bytes of text in a tile.
LEAST, TILE_BYTES = 98, 32 << 20


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of `size` words joined by spaces, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    runs = zip(*(words[i:] for i in range(size)), strict=False)
    return np.fromiter((digest(b" ".join(r), SEED) for r in runs), np.uint64, len(words) - size + 1)


def bit_totals(hashes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """How many hashes set each bit, bit 63 first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, size: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = shingle_hashes(words, size)
    bits = bit_totals(hashes) * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text as a signed bigint.

    Words are those between white space with A to Z lower-cased.  A text of
    fewer words than a shingle has one hash of all its words; a text without
    words, null included, has fingerprint 0.  Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def linked_roots(a: np.ndarray, b: np.ndarray, same: bool, radius: int, block: int = 256) -> list[tuple[int, int]]:
    """Index pairs that link a to b; of the links inside one pair of tiles a spanning forest is enough."""
    parent = list(range(len(a) + (0 if same else len(b))))
    base = 0 if same else len(a)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for at in range(0, len(a), block):
        near = np.bitwise_count(a[at : at + block, None] ^ b[None, :]) <= radius
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = int(i) + at, int(j)
            if same and x >= y:
                continue
            p, q = root(x), root(y + base)
            if p != q:
                parent[p] = q
                out.append((x, y))
    return out


def near_links(reps: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(a, b): links between ids of distinct fingerprints, enough to connect all that lie within the radius.

    reps has one row (id, fp) for each distinct fingerprint.
    """
    counts = [
        F.bit_count(F.shiftrightunsigned("fp", QUARTER * q).bitwiseAND(F.lit(0xFFFF))).cast("int") for q in range(4)
    ]
    cell = counts[0] * 4913 + counts[1] * 289 + counts[2] * 17 + counts[3]
    rows = reps.select("id", "fp", cell.alias("cell"))
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes.select("cell", F.ceil(F.col("n") / tile).cast("int").alias("parts")), "cells")
    # At most 17^4 cells, so the table of cells is bounded whatever the corpus.
    rows = rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = materialize(
        rows.groupBy("cell", "part").agg(F.collect_list(F.struct("fp", "id")).alias("m")).select(
            "cell", "part", F.transform("m", lambda x: x["fp"]).alias("fps"), F.transform("m", lambda x: x["id"]).alias("ids")
        ),
        "tiles",
    )
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    ahead = sorted({d[0] * 4913 + d[1] * 289 + d[2] * 17 + d[3] for d in steps if d >= (0, 0, 0, 0)})
    heads = tiles.select(F.col("cell"), F.col("part"))
    near = heads.select(
        F.col("cell").alias("cell_a"), F.col("part").alias("part_a"), F.explode(F.array(*[F.col("cell") + d for d in ahead])).alias("cell")
    ).join(heads, "cell").where("cell_a < cell or part_a <= part")
    a = tiles.select(F.col("cell").alias("cell_a"), F.col("part").alias("part_a"), F.col("fps").alias("fa"), F.col("ids").alias("ia"))
    work = near.join(a, ["cell_a", "part_a"]).join(tiles, ["cell", "part"])
    work = work.select("fa", "ia", "fps", "ids", ((F.col("cell") == F.col("cell_a")) & (F.col("part") == F.col("part_a"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            cols = [batch.column(c) for c in ("fa", "ia", "fps", "ids", "same")]
            for k in range(batch.num_rows):
                fa, ia, fb, ib = (cols[c][k].values.to_numpy(zero_copy_only=False) for c in range(4))
                for x, y in linked_roots(fa.view(np.uint64), fb.view(np.uint64), cols[4][k].as_py(), radius):
                    out_a.append(ia[x])
                    out_b.append(ib[y])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return work.mapInArrow(run, "a long, b long")


def same_document(fps: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): links between the representatives of fingerprints that rows of one doc_id have."""
    many = fps.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    held = fps.select("doc_id", "fp").distinct().join(many, "doc_id").join(reps, "fp").select("doc_id", "id")
    least = held.groupBy("doc_id").agg(F.min("id").alias("b"))
    return held.join(least, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")


def near_duplicate_groups(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id reachable over fingerprints that differ in at most `radius` bits.

    Every row of docs gives a row.  A doc_id that repeats with different texts
    is one document with several fingerprints, which it links.  Texts without
    words share fingerprint 0 and so link with each other.  An empty table gives
    no rows.  Rows whose doc_id is null get a component only through rows with a
    doc_id, else null.  Other columns of docs are left out.
    """
    fps = materialize(fingerprints(docs, size), "fingerprints")
    named = fps.where("doc_id is not null")
    reps = materialize(named.groupBy("fp").agg(F.min("doc_id").alias("id")), "reps")
    found = components(near_links(reps, radius).unionAll(same_document(named, reps)))
    classes = reps.join(found, reps["id"] == found["node"], "left").select(
        reps["fp"], F.coalesce("component", "id").alias("component_id")
    )
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def least_hashes(hashes: np.ndarray, step: int = 1 << 12) -> np.ndarray:
    """The least of each of BANDS x ROWS permuted hashes."""
    rng = np.random.default_rng(SEED)
    flip, odd = rng.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), step):
        part = (hashes[at : at + step, None] ^ flip) * (odd << np.uint64(1) | np.uint64(1))
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of least hashes.  No hashes have keys too."""
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def sketches(docs: DataFrame) -> DataFrame:
    """(digest, fp, keys, signature) of rows (digest, text): SimHash, band keys and a byte of each least hash of the five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, BANDS), np.uint64)
            signatures = []
            for k, t in enumerate(batch.column("text")):
                hashes = shingle_hashes((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split(), SHINGLE)
                bits = bit_totals(hashes) * 2 > len(hashes)
                fps[k] = int.from_bytes(np.packbits(bits).tobytes(), "big")
                least = least_hashes(hashes)
                keys[k] = band_keys(least)
                signatures.append(least.astype(np.uint8).tobytes())
            flat = pa.array(keys.view(np.int64).ravel())
            held = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
            cols = [batch.column("digest"), pa.array(fps.view(np.int64)), held, pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["digest", "fp", "keys", "signature"])

    return docs.select("digest", "text").mapInArrow(run, "digest string, fp long, keys array<long>, signature binary")


def shingle_set(text: str | None) -> set:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) > SHINGLE else {tuple(words)}


def jaccard_reached(a: set, b: set) -> bool:
    both = len(a & b)
    return both >= SIMILAR * (len(a) + len(b) - both)


def similar(pairs: DataFrame) -> DataFrame:
    """(a, b) of those rows (a, b, text_a, text_b) whose shingles have a Jaccard similarity of SIMILAR or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, held, near = None, set(), []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a != last:
                    last, held = a, shingle_set(x.as_py())
                other = shingle_set(y.as_py())
                near.append(jaccard_reached(held, other))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def band_members(reps: DataFrame) -> DataFrame:
    """(key, id, n, x, y): the members of each band key that several texts have, their number, the least one, and one that differs by band."""
    each = reps.select("id", F.explode("keys").alias("key"))
    groups = each.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("x"), F.min_by("id", F.xxhash64("id", "key")).alias("y")
    )
    return each.join(groups.where("n > 1"), "key")


def candidates(reps: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b, of rows (id, fp): pairs that may be similar.

    Texts with the same key in some band: all pairs of up to FEW, else each with the least id and
    with one that differs by band, so a large group of copies makes two pairs a member; `apart`
    and `settled` have the rest of such groups.  And the links of the tiles.
    """
    few = members.where(f"n <= {FEW}").select("key", "id")
    pairs = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
    many = members.where(f"n > {FEW}").select("id", F.explode(F.array("x", "y")).alias("to"))
    firsts = materialize(reps.groupBy("fp").agg(F.min("id").alias("first")), "reps")
    tiles = near_links(firsts.select(F.col("first").alias("id"), "fp"))
    copies = reps.join(firsts, "fp").select(F.col("id"), F.col("first").alias("to"))
    links = many.unionAll(copies).unionAll(tiles.toDF("id", "to")).where("id <> to")
    return pairs.unionAll(links.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"))).distinct()


def tile_pairs(rows: DataFrame, group: str, fields: list[str], size: Column, tile: int) -> DataFrame:
    """(ma, m, same): each pair of tiles of a group, as arrays of structs of `fields`, and whether it is one tile.

    A tile has about `tile` rows, fewer where their size is above TILE_BYTES.
    """
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum(size) / TILE_BYTES)).cast("int")
    counts = rows.groupBy(group).agg(parts.alias("parts"))
    dealt = rows.join(counts, group).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tiles = materialize(dealt.groupBy(group, "part").agg(F.collect_list(F.struct(*fields)).alias("m")), "tiles")
    heads = tiles.select(group, "part")
    work = heads.toDF(group, "part_a").join(heads, group).where("part_a <= part")
    work = work.join(tiles.toDF(group, "part_a", "ma"), [group, "part_a"]).join(tiles, [group, "part"])
    return work.select("ma", "m", (F.col("part_a") == F.col("part")).alias("same"))


class Forest:
    """Which things are connected so far."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(p, p)
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[self.root(x)] = self.root(y)


def alike_pairs(a: pa.StructArray, b: pa.StructArray, same: bool, block: int) -> Iterator[tuple[int, int]]:
    """Places in two tiles of members that are not connected yet, and whose signatures say that they may be similar."""

    def opened(x: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        signature = np.frombuffer(b"".join(x.field("signature").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        return x.field("component").to_numpy(), signature

    (ca, sa), (cb, sb) = opened(a), opened(b)
    for at in range(0, len(ca), block):
        near = (sa[at : at + block, None, :] == sb[None, :, :]).sum(axis=2) >= LEAST
        for x, y in zip(*(v.tolist() for v in np.nonzero(near & (ca[at : at + block, None] != cb[None, :]))), strict=True):
            if not same or at + x < y:
                yield at + x, y


def links_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def apart(reps: DataFrame, members: DataFrame, found: DataFrame, tile: int = 512, block: int = 16) -> DataFrame:
    """(a, b), a < b: members of one large band group that are not connected yet, and whose signatures say that they may be similar.

    A group's members are dealt to tiles, and tiles are compared in pairs, so a task holds two.  Of
    144 least hashes similar texts share 115 on average; one pair in five thousand at exactly SIMILAR shares fewer
    than LEAST.  Of each pair of tiles a spanning forest is enough to say who may be similar to whom in the end.
    """
    known = members.where(f"n > {FEW}").select("key", "id").join(found.toDF("id", "component"), "id", "left")
    known = known.withColumn("component", F.coalesce("component", "id"))
    open_ = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    held = known.join(open_, "key").join(reps.select("id", "signature"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ma, m, same in zip(batch.column("ma"), batch.column("m"), batch.column("same"), strict=True):
                ia, ib, forest, out = ma.values.field("id").to_numpy(), m.values.field("id").to_numpy(), Forest(), []
                for x, y in alike_pairs(ma.values, m.values, same.as_py(), block):
                    if forest.root(ia[x]) != forest.root(ib[y]):
                        forest.join(ia[x], ib[y])
                        out.append((ia[x], ib[y]))
                yield links_of(out)

    return tile_pairs(held, "key", ["id", "component", "signature"], F.lit(0), tile).mapInArrow(run, "a long, b long").distinct()


def settled(maybe: DataFrame, reps: DataFrame, texts: DataFrame, found: DataFrame, tile: int = 256, block: int = 16) -> DataFrame:
    """(a, b): links that the shingles confirm among the members that `maybe` (a, b) connects.

    Texts (id, text) that may be similar are tiled once more, now with their texts, and each pair of tiles is judged
    where it lies: pairs that are connected by then are left out, so copies of copies cost little, and what is
    returned is a spanning forest and not all pairs.
    """
    clusters = components(maybe).toDF("id", "cluster")
    held = clusters.join(found.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    held = held.join(reps.select("id", "signature"), "id").join(texts, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ma, m, same in zip(batch.column("ma"), batch.column("m"), batch.column("same"), strict=True):
                sides, forest, out = (ma.values, m.values), Forest(), []
                ids, comps = [s.field("id").to_numpy() for s in sides], [s.field("component").to_numpy() for s in sides]
                sets: tuple[dict, dict] = ({}, {})
                for x, y in alike_pairs(*sides, same.as_py(), block):
                    if forest.root(comps[0][x]) == forest.root(comps[1][y]):
                        continue
                    for held, side, k in zip(sets, sides, (x, y), strict=True):
                        if k not in held:
                            held[k] = shingle_set(side.field("text")[k].as_py())
                    if jaccard_reached(sets[0][x], sets[1][y]):
                        forest.join(comps[0][x], comps[1][y])
                        out.append((ids[0][x], ids[1][y]))
                yield links_of(out)

    work = tile_pairs(held, "cluster", ["id", "component", "signature", "text"], F.octet_length("text"), tile)
    return work.mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, component): a row for each distinct text of rows (doc_id, text).

    digest is the text's MD5, doc_id its least, null after all others, and component the same for
    texts that similar pairs connect.  Texts without words are similar, null ones too.  Repeated rows
    are one text; an empty table gives no rows; other columns of docs are left out.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), text_digest(F.col("text")).alias("digest"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    ids = materialize(
        docs.groupBy("digest").agg(least["doc_id"].alias("doc_id")).withColumn("id", F.monotonically_increasing_id()), "texts"
    )
    made = materialize(sketches(docs), "sketches").groupBy("digest").agg(
        F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("signature").alias("signature")
    )
    reps = materialize(made.join(ids, "digest").select("id", "fp", "keys", "signature"), "sketches")
    members = materialize(band_members(reps), "bands")

    def asked(pairs: DataFrame) -> DataFrame:
        own = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(ids, "id").select("id", "digest")
        texts = docs.select("digest", "text").join(own, "digest").groupBy("id").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
        return materialize(texts, "candidates")

    pairs = materialize(candidates(reps, members), "pairs")
    texts = asked(pairs)
    links = materialize(similar(pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")), "links")
    found = materialize(components(links), "components")
    maybe = materialize(apart(reps, members, found), "apart")
    if not maybe.isEmpty():
        found = components(links.unionAll(settled(maybe, reps, asked(maybe), found)))
    return ids.join(found, ids["id"] == found["node"], "left").select("digest", "doc_id", F.coalesce("component", "id").alias("component"))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its SimHash of three-word shingles, and the least doc_id of its component."""
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
