"""The pipeline's stages, one after the other, and the registry."""

import corpus_pipeline
from locusframe.llm import quality
from locusframe.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if at < 4:
            assert kept.columns == docs.columns
            assert {r.doc_id for r in kept.select("doc_id").collect()} <= set(rows)
        if name == "quality_rules":
            want = {i for i, r in rows.items() if not any(x.rejects(quality.Document(r.text)) for x in quality.PRODUCTION_RULES)}
            assert {r.doc_id for r in kept.collect()} == want
        docs_before, docs = docs, kept
        if name == "secret_scans":
            assert kept.count() == docs_before.count() and not [r for r in kept.collect() if "AKIA" in r.text]
        if name == "packing":
            assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs_before.select("doc_id").collect()}


def test_oracles(spark):
    from locusframe.llm.queries import ORACLES
    from oracle_check import compare, duck

    for name, sql in ORACLES.items():
        count, problem = compare(spark, duck(SF_DIR), name, QUERIES[name], sql, SF_DIR)
        assert problem is None and count > 0
