import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, place int, h long, score double, shards string, bucket string"
WORDS = {
    "en": "the of and to in is that for with was river mountain walking thinking water house children".split(),
    "de": "der die und nicht mit von eine schule straße würde kirche bücher wieder zwischen".split(),
    "fr": "le la les des être avec pour dans où était maison rivière toujours pourquoi".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, repeated lines, notices, nulls, blanks and a very long text."""
    rng = random.Random(11)
    shared = sentence(rng, "en", 60)
    out = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        text = "\n".join(sentence(rng, lang, rng.randrange(4, 30)) for _ in range(rng.randrange(2, 9)))
        if i % 9 == 0:
            text += "\n" + shared + "\n" + shared[:200] + "\nReleased under the MIT Licence."
        out.append((i, text, lang, f"s{i % 4}"))
    out += [(60 + i, out[i][1], out[i][2], "s1") for i in range(5)]
    out += [(70 + i, out[i][1] + " river", out[i][2], "s2") for i in range(5)]
    out += [
        (80, None, "en", "s1"),
        (81, "", "de", None),
        (82, " \n\t ", None, "s0"),
        (83, "single", "en", "s0"),
        (84, "12 34 $$ 56 " * 12, None, None),
        (85, "ab " * 20000 + "\n" + shared, "en", "s3"),
        (86, "aa bb cc dd ee ff gg hh " * 9, "en", "s3"),
        (87, "GENERAL   Public\nlicense, all rights reserved. CC-BY cc by cc by", "en", "s1"),
        (88, "Gneral pubic license and licensd under the apache licence version 2.0", "en", "s1"),
        (89, "a\nb\nb\na\nÄÖ €😀\r\nb", None, "é"),
        (90, shared, "en", ""),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    rows = [(i, t, lang, s, None if t is None else len(t), 7, 8, 9, 0.5, "x", "y") for i, t, lang, s in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(tmp_path_factory, docs, nothing, spark):
    """Folders with documents and labels: the corpus, and empty tables."""
    out = {}
    for name, df in (("full", docs), ("empty", nothing)):
        top = tmp_path_factory.mktemp(name)
        df.write.parquet(f"{top}/documents.parquet")
        labels = [(i, i % 5 != 0, i % 7 == 0) for i in range(0, 90, 2)] if name == "full" else []
        spark.createDataFrame([(i, int(q), int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
        out[name] = str(top)
    return out
