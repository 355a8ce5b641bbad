"""Language, licenses, mixing, packing and token counts."""

import itertools
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.conftest import sentence
from weirflow.llm import language_id, length_packing, license_scan, source_mix, token_rollup


# -- language -------------------------------------------------------------------


def test_language_held_out(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang, 40), lang) for i in range(150) for lang in [("en", "de", "fr")[i % 3]]]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    fresh = [(i, sentence(rng, lang, 30), lang) for i in range(60) for lang in [("en", "de", "fr")[i % 3]]]
    right = sum(model.classify(t)[0] == lang for _, t, lang in fresh)
    assert right >= 57
    assert all(model.classify(t.upper() + " $$$ 99")[0] == lang for _, t, lang in fresh[:9])


def test_language_edges(spark, tables):
    got = {r["doc_id"]: r for r in language_id.op8_language_id(spark, tables["full"]).collect()}
    for i in (80, 81, 82, 84):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"]
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "fr", "und") for r in got.values())


def test_narrow_margins_are_rejected(spark):
    model = language_id.Model({"a": b"xyz " * 50, "b": b"xyz " * 50})
    df = spark.createDataFrame([(1, "xyz xyz")], "doc_id long, text string")
    assert language_id.identify(df, model).first()["rejected"]


def test_nothing_to_learn_from(spark):
    model = language_id.fit(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string"))
    assert model.classify("anything")[0] == "und"


# -- licenses -------------------------------------------------------------------

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def test_license_base(spark, tables, corpus):
    texts = {i: t for i, t, *_ in corpus}
    for r in license_scan.op3_license_scan(spark, tables["full"]).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or ""))
        places = [(k, label) for p, label in PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        want = (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_license_within_edits():
    """A notice with up to its edits is found with its span; beyond them it is not."""
    notice = license_scan.Notice("released under the mit license", "mit", 3)
    scanner, rng = license_scan.Scanner((notice,)), random.Random(4)
    for n in range(6):
        for _ in range(20):
            damaged = list(notice.text)
            for _ in range(n):
                at = rng.randrange(1, len(damaged) - 1)
                damaged[at] = rng.choice("qxz") if damaged[at] != " " else " "
            damaged = "".join(damaged)
            _, hits = scanner.scan(f"some words before {damaged} and after")
            if edits(notice.text, damaged) <= 3:
                assert [(h.first_word, h.last_word) for h in hits] == [(3, 7)] and hits[0].edits == edits(notice.text, damaged)
            else:
                assert not hits


def test_license_overlaps_count():
    notice = license_scan.Notice("a b a", "x", 0)
    assert [h.first_word for h in license_scan.Scanner((notice,)).scan("a b a b a")[1]] == [0, 2]


# -- mixing ---------------------------------------------------------------------


def slow_targets(sizes):
    total = sum(sizes.values()) * 1.5
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    stopped: dict = {}
    while True:
        rest = total - sum(stopped.values())
        free = [s for s in names if s not in stopped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark, tables, corpus):
    rows = source_mix.op4_source_mix(spark, tables["full"]).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, source_mix.op4_source_mix(spark, tables["full"]).collect()))
    source = {i: s for i, _, _, s in corpus}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in corpus}
    sizes: Counter = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    want, taken = slow_targets(sizes), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s])
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        least = max([n for i, n in size.items() if source[i] == s])
        assert abs(taken[s] - want[s]) <= max(least, 1)


def test_splitting_tree():
    quotas = [50, 7, 0, 300, 1]
    for shards in (1, 3, 16):
        out = source_mix.split_quotas(quotas, shards, 9)
        assert [sum(c) for c in zip(*out, strict=True)] == quotas and out == source_mix.split_quotas(quotas, shards, 9)
        totals = [sum(r) for r in out]
        assert max(totals) - min(totals) <= 4
    draws = [source_mix.split_quotas([30, 70], 5, seed)[2][0] for seed in range(2000)]
    assert abs(sum(draws) / 2000 - 6) < 0.2 and min(draws) >= 0 and max(draws) <= 20


def test_a_document_is_taken_as_often_as_a_quota_covers_it(spark, docs, monkeypatch):
    """Shards hold what the tree gave them, block by block; a quota that is lost loses its documents."""
    monkeypatch.setattr(source_mix, "BLOCK_DOCS", 4)
    got = source_mix.mix(docs, 4, 3).draws.collect()
    want = {(r["doc_id"], r["source"]): len(r["shards"]) for r in got}
    assert {s for r in got for s in r["shards"]} <= set(range(4))
    real = source_mix.quota_tree
    monkeypatch.setattr(source_mix, "quota_tree", lambda *a: [(p, n if k else n - n) for k, (p, n) in enumerate(real(*a))][1:])
    less = {(r["doc_id"], r["source"]): len(r["shards"]) for r in source_mix.mix(docs, 4, 3).draws.collect()}
    assert sum(less.values()) < sum(want.values())


def test_mixed_rows_follow_the_draws(docs, spark, tables):
    got = Counter(r["doc_id"] for r in source_mix.mixed_documents(docs).collect())
    want = {r["doc_id"]: r["draws"] for r in source_mix.op4_source_mix(spark, tables["full"]).collect()}
    assert got == Counter({k: v for k, v in want.items() if v})


# -- packing --------------------------------------------------------------------


def waste(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())


def test_boundaries_are_best():
    rng = random.Random(8)
    for _ in range(40):
        histogram = {x: rng.randrange(1, 20) for x in rng.sample(range(1, 60), 8)}
        for k in (1, 2, 3, 8, 12):
            got = length_packing.optimal_boundaries(histogram, k)
            top = max(histogram)
            best = min(waste(histogram, (*c, top)) for m in range(min(k, 8)) for c in itertools.combinations(sorted(histogram), m))
            assert got[-1] == top and len(got) <= k and waste(histogram, got) == best
    assert length_packing.optimal_boundaries({}, 3) == []


def test_packing(spark, tables, corpus):
    rows = length_packing.op7_length_packing(spark, tables["full"]).collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for i, t, *_ in corpus:
        n, pieces = len((t or "").split()), sorted(got[i])
        assert sum(p[2] for p in pieces) == n and [p[1] for p in pieces] == [2048 * k for k in range(len(pieces))]
    batches: dict = {}
    for r in rows:
        assert r["length"] <= r["bucket_length"]
        batches.setdefault((r["bucket"], r["bucket_length"], r["batch"]), []).append(r["slot"])
    for (bucket, length, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * length <= max(length, length_packing.TOKEN_BUDGET)
    for bucket in {b for b, _, _ in batches}:
        numbers = sorted(n for b, _, n in batches if b == bucket)
        assert numbers == list(range(len(numbers)))


# -- token counts ---------------------------------------------------------------


def test_rollup(spark, tables, corpus):
    coders = {t.version: token_rollup._encoding(t) for t in token_rollup.tokenizers()}
    toxic = {i for i in range(0, 90, 2) if i % 7 == 0}
    want: Counter = Counter()
    for i, t, lang, s in corpus:
        if i not in toxic:
            v = "bpe-50k" if lang == "en" else "bpe-multi-50k"
            want[s, lang, v, "docs"] += 1
            want[s, lang, v, "tokens"] += len(coders[v].encode_ordinary(t or ""))
    got = Counter()
    for r in token_rollup.op9_token_rollup(spark, tables["full"]).collect():
        got[r["source"], r["lang"], r["version"], "docs"], got[r["source"], r["lang"], r["version"], "tokens"] = r["docs"], r["tokens"]
    assert +got == +want


def test_batches_count_once(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    rows = lambda *xs: spark.createDataFrame(list(xs), "source string, lang string, version string, tokens long")
    assert rollup.commit("a/1", token_rollup.inserts(rows(("s", "en", "v", 5), (None, None, "v", 2))))
    assert not rollup.commit("a/1", token_rollup.inserts(rows(("s", "en", "v", 99))))
    rollup.compact()
    assert not rollup.commit("a/1", token_rollup.inserts(rows(("s", "en", "v", 99))))
    rollup.commit("b", token_rollup.deletes(rows((None, None, "v", 2))))
    revised = spark.createDataFrame([("s", "en", "v", 5, "s", "en", "w", 7)], "source string, lang string, version string, tokens long, new_source string, new_lang string, new_version string, new_tokens long")
    rollup.commit("c", token_rollup.revisions(revised))
    want = [("s", "en", "w", 1, 7)]
    assert [tuple(r) for r in rollup.totals().collect()] == want
    rollup.compact()
    again = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert [tuple(r) for r in again.totals().collect()] == want and again.batches() == {"a/1", "b", "c"}


# -- the pipeline ---------------------------------------------------------------


def test_pipeline_by_hand(spark, tables, docs):
    """Each stage against what it should leave of its own input."""
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    told = corpus_pipeline.identify_language(spark, docs, "")
    assert not {80, 81, 82, 84} & set(ids(told)) and set(range(60)) <= set(ids(told))
    lined = corpus_pipeline.drop_repeated_lines(spark, told, "")
    assert ids(lined) == ids(told) and all(r["n_chars"] == len(r["text"]) for r in lined.collect())
    apart = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert not {60, 61, 62, 63, 64} & set(ids(apart)) and set(range(5)) <= set(ids(apart))
    assert set(ids(corpus_pipeline.mix_sources(spark, docs, ""))) <= set(ids(docs))
    assert corpus_pipeline.run(spark, tables["full"]).count() > 0
