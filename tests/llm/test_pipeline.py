"""The pipeline's stages, each against its own input."""

import corpus_pipeline
from stancepanel.llm import best_fit_packing, secret_scans
from stancepanel.llm.common import stage

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = (docs, stage(out, name))
        docs = seen[name][1]
    for name in ("toxicity", "near_copies", "benchmark"):
        before, after = ({r.doc_id: r.text for r in t.collect()} for t in seen[name])
        assert after.items() <= before.items()
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in seen["near_copies"])
    assert len(set(before.values())) >= len(after) == len(set(after.values()))
    before, after = ({r.doc_id: r for r in t.collect()} for t in seen["secrets"])
    assert before.keys() == after.keys()
    for key, row in after.items():
        assert row.text == secret_scans.masked(before[key].text) and row.n_chars == len(row.text)
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(after)


def test_run_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SMALL)
    assert docs.count() == 0


def test_packing_reads_small_batches(spark, monkeypatch):
    seen = []
    pieces = best_fit_packing.pieces

    def watched(docs, *rest):
        seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return pieces(docs, *rest)

    monkeypatch.setattr(best_fit_packing, "pieces", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    packed = corpus_pipeline.pack_sequences(spark, docs, SMALL)
    assert seen == [1_000] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
