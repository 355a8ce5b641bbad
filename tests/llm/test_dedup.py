"""Line, SimHash and passage dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weirflow.llm import line_dedup, passage_dedup, simhash_dedup
from weirflow.llm._graph import components


# -- lines ----------------------------------------------------------------------


def chunks_of(docs):
    return {r["doc_id"]: r["c"] for r in docs.select("doc_id", line_dedup.line_chunks(F.col("text")).alias("c")).collect()}


def test_chunks_are_the_text(docs, corpus):
    held = chunks_of(docs)
    for i, text, *_ in corpus:
        assert "\n".join(c["content"] for c in held[i]) == (text or "")
        assert all(1 <= c["n_lines"] for c in held[i])


def test_boundaries_withstand_shifts(spark):
    lines = [f"line {i * i % 97} of {i}" for i in range(200)]
    a, b = "\n".join(lines), "\n".join(["new"] * 3 + lines[:50] + ["put in"] + lines[50:])
    held = chunks_of(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"))
    x, y = ({c["content"] for c in held[k]} for k in (1, 2))
    assert len(x - y) <= 3


def line_cuts(lines):
    """Where chunks end, from the rule itself."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    rolled = [(x + line_dedup.BASE * (h[i - 1] if i else 0)) % line_dedup.MODULUS for i, x in enumerate(h)]
    return [i + 1 for i, r in enumerate(rolled) if i == len(lines) - 1 or r % line_dedup.ONE_IN == 0]


def slow_line_dedup(texts):
    """(kept text, number of chunks that go) by document: chunks in order, each extended line by line beside its first occurrence."""
    cut, first = {}, {}
    for i in sorted(texts):
        lines = texts[i].split("\n") if texts[i] else []
        ends = line_cuts(lines) if lines else []
        cut[i] = lines, list(zip([0, *ends], ends))
        for p, (b, e) in enumerate(cut[i][1]):
            first.setdefault("\n".join(lines[b:e]), (i, p))
    out = {}
    for i, (lines, chunks) in cut.items():
        gone, spans = set(), set()
        for p, (b, e) in enumerate(chunks):
            j, q = first["\n".join(lines[b:e])]
            if (j, q) == (i, p) or not re.search(r"[^\x20\x09-\x0D]", "\n".join(lines[b:e])):
                continue
            theirs, others = cut[j]
            (fb, fe), lo, hi = others[q], 0, 0
            before = (chunks[max(0, p - 2)][0], others[max(0, q - 2)][0])
            after = (chunks[p + 1][1] if p + 1 < len(chunks) else e, others[q + 1][1] if q + 1 < len(others) else fe)
            while b - lo > before[0] and fb - lo > before[1] and lines[b - lo - 1] == theirs[fb - lo - 1]:
                lo += 1
            while e + hi < after[0] and fe + hi < after[1] and lines[e + hi] == theirs[fe + hi]:
                hi += 1
            if e - b + lo + hi >= 2:
                gone |= set(range(b - lo, e + hi))
                spans.add((b - lo, e + hi))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(spans), len(gone)
    return out


def test_later_chunks_go(spark, tables, corpus):
    want = slow_line_dedup({i: t for i, t, *_ in corpus})
    for r in line_dedup.op1_line_dedup(spark, tables["full"]).collect():
        kept, chunks, lines = want[r["doc_id"]]
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest(), r["doc_id"]
        assert (r["n_removed"], r["n_removed_lines"]) == (chunks, lines)
    assert sum(n for _, n, _ in want.values()) > 20


def test_shared_passages_go_whole(spark):
    """Passages of five lines in the middle of otherwise different documents: most go, and then with their first and last lines."""
    rng = random.Random(9)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    rows, passages = [], [[line() for _ in range(5)] for _ in range(60)]
    for i, p in enumerate(passages):
        rows += [(2 * i, "\n".join([line(), line(), *p, line()])), (2 * i + 1, "\n".join([line(), *p, line(), line(), line()]))]
    got = {r["doc_id"]: r for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r["n_removed_lines"] == 0 for i, r in got.items() if i % 2 == 0)
    gone = [got[2 * i + 1]["n_removed_lines"] for i in range(60)]
    assert set(gone) <= {0, 2, 3, 4, 5} and sum(n == 5 for n in gone) >= 35
    assert all(t in got[2 * i + 1]["text"].split("\n") for i in range(60) for t in (rows[2 * i + 1][1].split("\n")[0],))


def test_hash_twins_are_told_apart_by_bytes(spark, monkeypatch):
    """With a hash that is the same for all, only equal bytes are repeats."""
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.lit(4).cast("bigint"))
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c\nd"), (3, "a\nb")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got[1] == 0 and got[2] == 0


# -- SimHash --------------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints_and_groups(spark, tables, corpus):
    rows = simhash_dedup.op5_simhash_dedup(spark, tables["full"]).collect()
    texts = {i: t for i, t, *_ in corpus}
    for r in rows:
        if len(texts[r["doc_id"]] or "") < 5000:
            assert int(r["fingerprint"], 16) == slow_fingerprint(texts[r["doc_id"]]) and len(r["fingerprint"]) == 16
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {r["doc_id"]: r["component_id"] for r in rows} == reachable(fps, links)
    assert fps[80] == fps[81] == fps[82] == 0


@pytest.mark.parametrize("tile", [3, 2048])
def test_links_find_every_pair(spark, tile):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            fps.add(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    fps |= {0, 1, 3, (1 << 64) - 1, (1 << 64) - 2, 1 << 63}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    found = simhash_dedup.near_links(spark.createDataFrame(rows, "id long, fp long"), 2, tile).collect()
    ordered = sorted(fps)
    links = [(a, b) for a in range(len(ordered)) for b in range(a) if (ordered[a] ^ ordered[b]).bit_count() <= 2]
    assert all((ordered[r["a"]] ^ ordered[r["b"]]).bit_count() <= 2 for r in found)
    assert reachable(range(len(ordered)), [(r["a"], r["b"]) for r in found]) == reachable(range(len(ordered)), links)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(3, 3), (90, 91), (91, 90)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = reachable({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != 3}


# -- passages -------------------------------------------------------------------


def slow_removal(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone, own = bytearray(len(data)), set()
        for p in range(len(data) - 49):
            w = data[p : p + 50]
            own.add(w)
            if w in seen:
                gone[p : p + 50] = b"\1" * 50
        seen |= own
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [500, 1 << 22])
def test_passages(docs, corpus, chunk):
    got = passage_dedup.without_repeats(docs, chunk, 4 * chunk).collect()
    want = slow_removal({i: t for i, t, *_ in corpus})
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_periodic_and_boundary_texts(spark):
    base = "".join(chr(97 + (i * i) % 26) for i in range(300))
    texts = {1: "a" * 400, 2: "b" + "a" * 120, 3: base, 4: base[:49], 5: base[:50], 6: "x" + base[100:149] + "y", 7: "x" + base[100:150] + "y", 8: base[120:] + base[:120], 9: "ab" * 99, 10: "ba" * 60}
    got = passage_dedup.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), keep_text=True).collect()
    assert {r["doc_id"]: tuple(r)[1:5] for r in got} == slow_removal(texts)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_suffixes_that_share_a_hash(monkeypatch):
    """With a hash that is the same for all, the bytes decide."""
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 3, 60, dtype=np.uint8) for _ in range(6)]
    parts.append(parts[2].copy())
    data, sizes, doc = np.concatenate(parts), np.full(7, 60), np.array([5, 1, 2, 3, 4, 6, 9])
    want = passage_dedup.repeated_starts(data, sizes, doc)
    monkeypatch.setattr(passage_dedup, "stretch_hashes", lambda d, s, n: np.zeros(len(s), np.uint64))
    assert (passage_dedup.repeated_starts(data, sizes, doc) == want).all()
    assert want[6] == (1 << 11) - 1 and not want[:6].any()


def test_suffix_array():
    """The order is that of the first MATCH bytes, and new says where those differ."""
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 99, 400, dtype=np.uint8), np.zeros(120, np.uint8), rng.integers(0, 256, 100, dtype=np.uint8), np.full(90, 255, np.uint8)])
    data = np.concatenate([data, data[100:300]])
    at = rng.permutation(len(data) - passage_dedup.MATCH)
    order, new = passage_dedup.suffix_array(data, at)
    heads = [data[a : a + passage_dedup.MATCH].tobytes() for a in at[order]]
    assert heads == sorted(heads) and new.tolist() == [True] + [a != b for a, b in zip(heads, heads[1:])]


def test_phrases_that_share_a_hash(spark, monkeypatch):
    """With a phrase hash that is the same for all, a chunk's phrases are told apart by their bytes."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abc ") for _ in range(300))
    texts = {i: "".join(rng.choice("abc ") for _ in range(rng.randrange(200))) + passage[10 * i :] for i in range(6)}
    data = b"".join(texts[i].encode() for i in texts)
    ids = np.array(list(texts), np.int64)
    parse = passage_dedup.Parse(ids, np.frombuffer(data, np.uint8), np.array([len(t) for t in texts.values()]))
    parse.deduplicate()
    phrase = lambda k: data[parse.start[k] : parse.start[k] + parse.size[k] + passage_dedup.MATCH - 1]
    assert all(phrase(k) == phrase(parse.heads[h]) for k, h in enumerate(parse.head_at))
    assert len({phrase(k) for k in parse.heads}) == len(parse.heads) < len(parse.start)
    monkeypatch.setattr(passage_dedup.Parse, "phrase_hashes", lambda self: np.full(len(self.start), 7, np.uint64))
    parse.deduplicate()
    assert all(phrase(k) == phrase(parse.heads[h]) for k, h in enumerate(parse.head_at))
