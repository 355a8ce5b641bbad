"""What has lost rows, crashed or gone wrong before, and whole queries against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import reachable, slow_line_dedup
from weirflow.llm import language_id, length_packing, license_scan, quality_rules, simhash_dedup, source_mix, token_rollup

KIND = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def coder():
    return token_rollup._encoding(token_rollup.tokenizers()[0])


# -- token counts ---------------------------------------------------------------


def test_runs_of_white_space_are_cut_where_the_pattern_cuts(coder, monkeypatch):
    monkeypatch.setattr(token_rollup, "LONG_SPACE", regex.compile(r"\p{White_Space}{2,}"))
    rng, spaces = random.Random(1), " \n\t\r　\x1c\x85​"
    for _ in range(3000):
        parts = [rng.choice(["".join(rng.choice(spaces) for _ in range(rng.randrange(1, 7))), rng.choice(["a", "Zu", "7", "'s", "!", "é", " x"])]) for _ in range(rng.randrange(1, 9))]
        text = "".join(parts)
        assert token_rollup.count_tokens(coder, text) == len(coder.encode_ordinary(text)), repr(text)


def test_very_long_texts_are_counted(spark, coder):
    texts = [" " * 5_000_000 + "a", "\n" * 5_000_000, "ab" * 2_500_000, "a" + "\n " * 2_500_000 + "b"]
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["tokens"]["bpe-50k"] for r in token_rollup.token_counts(df, token_rollup.tokenizers()).collect()}
    piece = lambda s: len(coder._encode_single_piece(s))
    assert got[0] == piece(" " * 4_999_999) + len(coder.encode_ordinary(" a"))
    assert got[1] == piece("\n" * 5_000_000)
    assert got[2] == len(coder.encode_ordinary(texts[2]))
    assert got[3] == 1 + piece(("\n " * 2_500_000)[:-1]) + len(coder.encode_ordinary(" b"))


def test_one_of_two_writers_commits(spark, tmp_path, monkeypatch):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path))
    rows = spark.createDataFrame([("s", "en", "v", 5)], "source string, lang string, version string, tokens long")
    assert rollup.commit("a/b", token_rollup.inserts(rows))
    monkeypatch.setattr(rollup, "batches", set)  # the second one has looked before the first renames
    assert not rollup.commit("a/b", token_rollup.inserts(rows))
    monkeypatch.undo()
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 1, 5)] and rollup.batches() == {"a/b"}
    rollup.compact()
    assert not rollup.commit("a/b", token_rollup.inserts(rows))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 1, 5)]


# -- SimHash --------------------------------------------------------------------


def test_a_doc_id_links_all_its_texts(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(50)) for k in "abc")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (9, b), (11, c), (None, c), (None, b), (None, "x")], "doc_id long, text string")
    got = sorted(((str(r["doc_id"]), r["component_id"]) for r in simhash_dedup.near_duplicate_groups(docs).collect()), key=str)
    assert got == sorted([("3", 3), ("5", 3), ("5", 3), ("9", 3), ("9", 3), ("11", 11), ("None", 11), ("None", 3), ("None", None)], key=str)


def test_large_band_groups_are_compared_in_whole(spark):
    """Members that neither of the two chosen ones is like find each other through their signatures, and the shingles decide."""
    rng = random.Random(2)
    rows, texts = [], []
    for k in range(30):
        words = [f"{k}w{i}" for i in range(200)]
        other = list(words)
        for at in range(3, 200, 25 if k % 2 else 9):  # 40 or 110 of 196 shingles change
            other[at] = f"x{rng.random()}"
        for i, own in ((2 * k, words), (2 * k + 1, other)):
            texts.append((i, " ".join(own)))
            least = simhash_dedup.least_hashes(simhash_dedup.shingle_hashes([w.encode() for w in own], 5))
            rows.append((i, bytes(least.astype(np.uint8))))
    reps = spark.createDataFrame(rows, "id long, signature binary")
    members = reps.select(F.lit(1).cast("long").alias("key"), "id", F.lit(len(rows)).cast("long").alias("n"))
    found = spark.createDataFrame([(2, 2), (3, 2)], "node long, component long")
    sets = [simhash_dedup.shingle_set(t) for _, t in texts]
    want = {(2 * k, 2 * k + 1) for k in range(30) if k != 1 and simhash_dedup.jaccard_reached(sets[2 * k], sets[2 * k + 1])}
    maybe = simhash_dedup.apart(reps, members, found, tile=7, block=3)
    assert want <= {(r["a"], r["b"]) for r in maybe.collect()} <= {(2 * k, 2 * k + 1) for k in range(30)} - {(2, 3)}
    got = simhash_dedup.settled(maybe, reps, spark.createDataFrame(texts, "id long, text string"), found, tile=5).collect()
    assert {(r["a"], r["b"]) for r in got} == want


def test_chains_in_one_band_group(spark, monkeypatch):
    """Every text shares 0.8 with its neighbours in a chain only; with bands of one value all of them share many groups."""
    monkeypatch.setattr(simhash_dedup, "FEW", 2)
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join([*words[6 * i : 6 * i + 150]])) for i in range(40)]
    texts += [(100 + i, " ".join(f"z{i}q{k}" for k in range(60))) for i in range(10)]
    sets = {i: simhash_dedup.shingle_set(t) for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and simhash_dedup.jaccard_reached(sets[a], sets[b])]
    want = reachable(list(sets), links)
    got = {r["doc_id"]: r["component"] for r in simhash_dedup.similar_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {frozenset(i for i in got if got[i] == c) for c in got.values()} == {frozenset(i for i in want if want[i] == c) for c in want.values()}


# -- licenses, language, rules --------------------------------------------------


def test_places_in_a_long_text():
    text = "all rights reserved; one cc by two. " * 20000
    words, hits = license_scan.Scanner(license_scan.BASE).scan(text)
    got = Counter((h.notice.label, h.first_word % 7) for h in hits)
    assert len(words) == 140000 and got == {("reserved", 0): 20000, ("cc-by", 4): 20000}


def slow_model(rows):
    """The model from (text, lang), by the rule: different texts by their hashes, an eighth of a dictionary at most from each."""
    by_lang: dict = {}
    for text, lang in rows:
        if lang is not None and text:
            by_lang.setdefault(lang, []).append(text)
    out = {}
    for lang in sorted(by_lang, key=lambda x: (-len(by_lang[x]), x)):
        signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
        held = b""
        for t in sorted(set(by_lang[lang]), key=signed)[: language_id.TEXTS]:
            part = language_id.letters_only(t[: language_id.BYTES // 8])[: min(language_id.BYTES - len(held), language_id.BYTES // 8)]
            held = part + held
        out[lang] = held
    return language_id.Model(out)


def test_language_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs}
    model = slow_model([(r["text"], r["lang"]) for r in docs if not held[r["doc_id"]]])
    got = {r["doc_id"]: tuple(r)[1:] for r in language_id.op8_language_id(spark, sf_dir).collect()}
    for r in docs:
        lang, score = model.classify(r["text"])
        assert got[r["doc_id"]] == (held[r["doc_id"]], lang, score, lang == "und" or score < 0.005)
    told = [(r["lang"], got[r["doc_id"]]) for r in docs if held[r["doc_id"]] and r["lang"]]
    assert sum(lang == g[1] for lang, g in told) >= 0.95 * len(told)


def test_many_languages_stay_bounded(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join(f"l{k}w{rng.randrange(30)}" for _ in range(20)), f"lang{k}") for k in range(40) for _ in range(6)]
    monkeypatch.setattr(language_id, "ALL_TEXTS", 80)
    monkeypatch.setattr(language_id, "ALL_BYTES", 40 * 300)
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.dictionaries) == 40 and max(map(len, model.dictionaries.values())) <= 300
    assert len(language_id.fit(spark.createDataFrame(rows, "text string, lang string"), languages=7).dictionaries) == 7


def test_a_length_does_not_change_the_verdict():
    """A text of 599 bytes and one of 600 are encoded the same way."""
    model = language_id.Model({"a": b"the river and the house " * 30, "b": b"der fluss und das haus " * 30})
    scores = [model.classify("the river and der house und the fluss "[: 38] * 20 + "x" * 0 + "the " * 3)[1] for _ in range(2)]
    sizes = [model.sizes("the river " * n) for n in (59, 60, 61)]
    assert scores[0] == scores[1] and all(abs(a - b) <= 3 for x, y in zip(sizes, sizes[1:]) for a, b in zip(x, y))


def slow_first_condition(rows, bins=32):
    """The threshold with the greatest gain, by trying all of them on all rows."""
    grow = [(bad, x) for bad, held, x in rows if not held]
    p0, n0 = sum(b for b, _ in grow), sum(1 - b for b, _ in grow)
    best = 0.0
    for f in quality_rules.RATIOS:
        for cut in sorted({x[f] for _, x in grow}):
            for up in (True, False):
                own = [b for b, x in grow if (x[f] >= cut) == up]
                p = sum(own)
                if p >= 8 and len(own) - p < n0:
                    best = max(best, p * (np.log2(p / len(own)) - np.log2(p0 / (p0 + n0))))
    return best


def test_the_first_condition_gains_most(spark):
    """With as many bins as values, no other threshold gains more than the one that a rule starts with."""
    rng = random.Random(12)
    texts = [(" ".join(rng.choice(["word", "Tree", "$$", "##", "9", "ab"]) for _ in range(rng.randrange(4, 40))), rng.random()) for _ in range(240)]
    docs = spark.createDataFrame([(i, t, int(not (t.count("$") > 8 or u < 0.03))) for i, (t, u) in enumerate(texts)], "doc_id long, text string, quality int")
    stats = quality_rules.text_stats(docs)
    rules = quality_rules.learn(stats, bins=1000, max_rules=1, max_conditions=1, min_precision=0.0)
    hashed = F.xxhash64("n_words", "word_chars", "n_symbols", "n_distinct_words", "n_upper")
    rows = stats.select((1 - F.col("quality")).alias("bad"), (F.pmod(hashed, F.lit(3)) == 0).alias("held"), *[F.expr(e).alias(f) for f, e in quality_rules.RATIOS.items()]).collect()
    held = [(r["bad"], r["held"], r.asDict()) for r in rows]
    grow = [(b, x) for b, h, x in held if not h]
    (c,) = rules.rules[0].conditions
    own = [b for b, x in grow if (x[c.feature] >= c.threshold) == c.at_least]
    p0 = sum(b for b, _ in grow)
    gain = sum(own) * (np.log2(sum(own) / len(own)) - np.log2(p0 / len(grow)))
    assert gain == pytest.approx(slow_first_condition(held), rel=0.02)


# -- nulls, repeats and the pipeline --------------------------------------------

ROWS = [
    (None, None, None, None, None),
    (None, "a b c", "en", None, 5),
    *[(1, "one two three\nfour five\nsix", "en", "s", 27)] * 2,
    (1, "another text altogether with seven words", "en", "s", 40),
    (2, "one two three\nfour five\nsix", "en", "s", 27),
    (2, "", "en", "", 0),
    (3, "w " * 5000, "de", "t", 10000),
]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(ROWS, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pieces_of_repeated_rows(spark, folder):
    got = length_packing.op7_length_packing(spark, folder).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        n = len(re.findall(SPACES, t or ""))
        for k in range(max(1, -(-n // 2048))):
            want[i, k, 2048 * k, min(2048, n - 2048 * k)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == want
    places = [(r["bucket"], r["batch"], r["slot"]) for r in got]
    assert len(set(places)) == len(places)


def test_a_hot_doc_id_is_dealt_over_shares(spark, monkeypatch):
    monkeypatch.setattr(length_packing, "SHARE", 50)
    rows = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    packed = length_packing.pack(length_packing.pieces(rows, F.lit(2)))
    assert packed.select("bucket", "batch", "slot").distinct().count() == 2000
    held = packed.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(held) >= 1 and sum(r["count"] for r in held) == 2000


def test_rollup_of_repeated_rows(spark, folder, coder):
    want = Counter()
    two = token_rollup._encoding(token_rollup.tokenizers()[1])
    for i, t, lang, source, _ in ROWS:
        if i == 2:
            continue
        version, enc = ("bpe-50k", coder) if lang == "en" else ("bpe-multi-50k", two)
        want[source, lang, version, "docs"] += 1
        want[source, lang, version, "tokens"] += len(enc.encode_ordinary(t or ""))
    got = Counter()
    for r in token_rollup.op9_token_rollup(spark, folder).collect():
        got[r["source"], r["lang"], r["version"], "docs"] += r["docs"]
        got[r["source"], r["lang"], r["version"], "tokens"] += r["tokens"]
    assert +got == +want


def test_stages_on_nulls_and_repeats(spark, folder):
    docs = spark.createDataFrame(ROWS, KIND)
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    told = corpus_pipeline.identify_language(spark, docs, folder).collect()
    assert all(r["text"] for r in told) and {r["doc_id"] for r in told} <= {None, 1, 2, 3}
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, folder)
    short = lambda x: (x[0], "", *x[2:4], 0) if x[0] == 2 else x  # noqa: E731  # row 1 has these lines first
    assert rows(lines) == sorted(map(str, [short((i, t, a, b, None if t is None else len(t))) for i, t, a, b, _ in ROWS]))
    near = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    kept = [ROWS[1], ROWS[2], ROWS[4], ROWS[6], ROWS[7]]
    assert rows(near) == sorted(map(str, kept))
    mixed = Counter(map(str, (tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, folder).collect())))
    assert all(n <= 2 * sum(str(x) == k for x in ROWS) for k, n in mixed.items()) and set(mixed) <= {str(x) for x in ROWS}
    pieces = corpus_pipeline.pack_sequences(spark, docs, folder)
    assert sum(r["length"] for r in pieces.collect()) == sum(len(re.findall(SPACES, t or "")) for _, t, *_ in ROWS)


def slow_near(rows):
    """Rows that stay: of texts that chains of Jaccard 0.8 over five-word shingles connect, the one with the least doc_id."""
    sets = {}
    for i, t in rows:
        words = re.findall(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = reachable(ids, links)
    return {i for i in ids if root[i] == i}


def test_pipeline_by_brute_force(spark, tables, corpus):
    """All five stages by hand: the model, the line rule, all pairs of texts, the mix in SQL, and whole pieces."""
    model = slow_model([(t, lang) for _, t, lang, _ in corpus])
    told = {}
    for i, t, _, source in corpus:
        lang, score = model.classify(t)
        if lang != "und" and score >= 0.005:
            told[i] = t, source
    kept = {i: t for i, (t, _, _) in slow_line_dedup({i: t for i, (t, _) in told.items()}).items()}
    near = slow_near(list(kept.items()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, kept[i], told[i][1]) for i in sorted(near)])
    draws = {r["doc_id"]: r["draws"] for r in con.sql(source_mix.OP4_SQL).df().to_dict("records")}
    want = Counter()
    for i, n in draws.items():
        words = len(re.findall(SPACES, kept[i]))
        for k in range(max(1, -(-words // 2048))):
            want[i, k, 2048 * k, min(2048, words - 2048 * k)] += int(n)
    rows = corpus_pipeline.run(spark, tables["full"]).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == +want
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows) and all(r["length"] <= r["bucket_length"] for r in rows)
