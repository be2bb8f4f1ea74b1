import pytest
from oracle import both

import corpus_pipeline
from folioflow.llm import decontaminate, linededup, neardup, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    rows, expected = both(spark, small, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_covers_its_table(spark, small, name):
    rows = queries.QUERIES[name](spark, small).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= ids and (name == "op9_benchmark_leaks" or len(rows) == len(ids))


def test_pipeline_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["line_dedup"](spark, docs, small)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert {(r.doc_id, r.text, r.n_chars) for r in lines.collect()} == {(r.doc_id, r.text, len(r.text)) for r in linededup.dedup_lines(docs).collect()}
    near = stages["near_duplicates"](spark, docs, small)
    classes = neardup.link(docs, 5, 80).collect()
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {r.component_id for r in classes}
    clean = stages["decontamination"](spark, docs, small)
    held = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert held and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - held
    fine = stages["toxicity"](spark, docs, small)
    assert fine.columns == docs.columns and 0 < fine.count() < docs.count()


def test_pipeline(spark, small):
    out = corpus_pipeline.run(spark, small)
    rows = out.collect()
    assert rows and all(r.round_trip for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    nothing = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, small).count() == 0
