import glob
import os

import duckdb
import pytest
from conftest_llm import docs_of

import corpus_pipeline as cp
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op6_html_extraction": ["page_id", "url", "text", "n_chars", "n_template", "n_marked"],
    "op7_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op8_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op9_token_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == COLUMNS[name]
    whole = "pages" if name in ("op5_url_filter", "op6_html_extraction") else "documents"
    assert got.count() == spark.read.parquet(f"{SF}/{whole}.parquet").count()


def test_scratch_is_shared_on_a_cluster(spark, monkeypatch):
    from tidemark.errors import UsageError
    from tidemark.sinks import scratch

    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(UsageError, match="spark.checkpoint.dir"):
        scratch.scratch(Elsewhere(), "x")


@pytest.mark.parametrize("name", queries.ORACLE)
def test_oracle(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.ORACLE[name])
    at = [want.columns.index(c) for c in got.columns]
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert key(tuple(r) for r in got.collect()) == key(tuple(r[i] for i in at) for r in want.fetchall())


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before kept, held against what its operator says of its own input."""
    from tidemark.llm import decontaminate, jaccard_join, mixing

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.01")
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        given = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= given
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
            gone = [labels[d] for d in given - ids if d in labels]
            kept = [labels[d] for d in ids if d in labels]
            assert sum(gone) >= 0.95 * len(gone)
            assert sum(kept) <= 0.03 * len(kept)
        if name == "ngram_jaccard_join":
            assert ids == {r.component_id for r in jaccard_join.jaccard_components(before).collect()}
        if name == "decontamination":
            benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
            assert ids == {r.doc_id for r in decontaminate.find_contamination(before, benchmark).where("not contaminated").collect()}
        if name == "mixing":
            ratio = {r.doc_id: r.taken / r.size for r in mixing.mix(before).collect() if r.size}
            times = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert all(abs(times.get(d, 0) - x) < 1.00001 for d, x in ratio.items())
        if name == "token_output":
            assert docs.count() == before.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "a few words"), (4, "A few words"), (5, "x " * 30_000), (None, "no id"), (None, None), (3, "a few words"), (6, "one text"), (6, "another text of it")]
    docs = docs_of(spark, rows)
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = [r.doc_id for r in docs.collect()]
        if name in ("toxicity", "ngram_jaccard_join", "decontamination"):
            assert ids.count(None) == 2, name
            assert ids.count(6) == 2, name
            assert ids.count(3) == 2, name
            assert ids.count(4) == (1 if name == "toxicity" else 0), name
    assert 5 in ids
    empty = docs_of(spark, [])
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, empty, SF).write.parquet(str(tmp_path / f"e{k}"))
        empty = spark.read.parquet(str(tmp_path / f"e{k}"))
    assert empty.count() == 0
