"""Every operator over nulls, blanks, ties, repeated rows, clashing columns, very long texts and empty tables."""

import duckdb
import pytest

import corpus_pipeline
from weirflow.llm import registry

QUERIES = registry.queries() | {"pipeline": corpus_pipeline.run}


def test_all_ten_are_there():
    assert {q.split("_")[0] for q in QUERIES} == {*(f"op{n}" for n in range(1, 11)), "pipeline"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table(name, spark, tables, corpus):
    rows = QUERIES[name](spark, tables["full"]).collect()
    if name not in ("op9_token_rollup", "pipeline"):
        assert {r["doc_id"] for r in rows} == {i for i, *_ in corpus}
    if name not in ("op7_length_packing", "op9_token_rollup", "pipeline"):
        assert len(rows) == len(corpus)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(name, spark, tables):
    assert QUERIES[name](spark, tables["empty"]).count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op9_token_rollup", "pipeline", "op7_length_packing"}))
def test_nulls_and_repeats(name, spark, tmp_path):
    """A row that is null throughout, and rows that are there twice."""
    rows = [(None, None, None, None, None), (None, "a b c", "en", None, 5), *[(1, "one two three\nfour five\nsix", "en", "s", 27)] * 2, (2, "one two three\nfour five\nsix", "en", "s", 27)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == len(rows)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage(k, spark, docs, nothing, tables):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, tables["full"])
    if k < len(corpus_pipeline.STAGES) - 1:
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        assert [f.dataType for f in out.schema] == [docs.schema[c].dataType for c in corpus_pipeline.COLUMNS]
    assert out.count() > 0
    assert stage(spark, nothing, tables["empty"]).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
@pytest.mark.parametrize("where", ["full", "empty", "data"])
def test_sql(name, where, spark, tables, sf_dir):
    """The same rows from SQL, over the corpus of these tests, no rows, and the test data."""
    folder = tables.get(where, sf_dir)
    con = duckdb.connect()
    files = f"{folder}/documents.parquet" + ("" if where == "data" else "/*.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    rel = con.sql(registry.oracle_sql()[name])
    cols = sorted(rel.columns)
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == cols
    want = [tuple(dict(zip(rel.columns, r, strict=True))[c] for c in cols) for r in rel.fetchall()]
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
