import re
from collections import Counter

from pyspark.sql import functions as F

from weirflow.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    held = {i + j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(held)


def test_statistics(docs, corpus):
    got = {r["doc_id"]: r for r in q.text_stats(docs.select("doc_id", "text")).collect()}
    for i, text, *_ in corpus:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(text), i


def test_base_and_kept(spark, tables):
    for r in q.op2_quality_rules(spark, tables["full"]).collect():
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["rule"] == 0)


def labelled(spark, rows):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_exclaim"]
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in cols) + ", quality int")


def test_learns_conjunctions(spark):
    """Bad where many symbols meet many upper-case letters; either alone is fine."""
    rows = []
    for i in range(1200):
        symbols, upper = (i * 7) % 100, (i * 13) % 90
        rows.append((100, 500 + i % 50, symbols, 0, 0, 10, 80, upper * 5, 0, 0, 0 if symbols >= 60 and upper >= 50 else 1))
    rules = q.learn(labelled(spark, rows))
    assert len(rules.rules) >= 1 and {c.feature for c in rules.rules[0].conditions} == {"symbols_a_word", "upper_share"}
    got = labelled(spark, rows).withColumn("bad", rules.rule_number() > 0)
    assert got.where(F.col("bad") & (F.col("quality") == 1)).count() <= 12
    assert got.where(~F.col("bad") & (F.col("quality") == 0)).count() <= 60


def test_one_class_or_noise_gives_no_rule(spark):
    assert q.learn(labelled(spark, [(100, 500, i, 0, 0, 10, 80, 0, 0, 0, 1) for i in range(50)])).rules == ()
    noise = [(100 + i % 7, 500 + i % 11, i % 13, 0, 0, 10, 80, 0, 0, 0, int(hash((i, "x")) % 2)) for i in range(60)]
    assert all(r.bad > r.good for r in q.learn(labelled(spark, noise)).rules)


def test_first_rule_wins(spark):
    a = q.Rule((q.Condition("n_words", False, 10.0),), 1, 0)
    b = q.Rule((q.Condition("n_words", False, 20.0),), 1, 0)
    df = labelled(spark, [(5, 1, 0, 0, 0, 1, 1, 0, 0, 0, 1), (15, 1, 0, 0, 0, 1, 1, 0, 0, 0, 1), (25, 1, 0, 0, 0, 1, 1, 0, 0, 0, 1)])
    assert [r[0] for r in df.select(q.DecisionList((a, b)).rule_number()).collect()] == [1, 2, 0]
