import public_tokenizers

import corpus_pipeline
from stancepanel.llm import best_fit_packing
from stancepanel.llm.common import BATCH_ROWS, small_batches


def test_stages_send_few_texts_at_once_and_run_restores_the_setting(spark, monkeypatch):
    rows = [(i, f"text {i}", "en", "s", 6) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    tables = {"documents": docs, "labels": spark.createDataFrame([], "doc_id long, toxic int"),
              "benchmark": spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")}
    monkeypatch.setattr(corpus_pipeline, "read", lambda spark, sf_dir, name: tables[name])
    for name, step in corpus_pipeline.STAGES:
        if name in ("toxicity", "benchmark", "secrets"):
            with small_batches(spark, 20_000):
                out = step(spark, docs, "")
                assert spark.conf.get(BATCH_ROWS) == str(corpus_pipeline.TEXTS)
                assert sorted(out.collect()) == sorted(docs.collect())
    before = spark.conf.get(BATCH_ROWS)
    packed = corpus_pipeline.run(spark, "")
    assert spark.conf.get(BATCH_ROWS) == before
    assert sorted(r.doc_id for r in packed.collect()) == list(range(30))


def test_packing_remembers_as_many_words_as_it_is_told():
    path = public_tokenizers.path("word_bpe_49k.json")
    few, library = best_fit_packing.Encoder(path, remembered=10), best_fit_packing.encoder(path)
    assert best_fit_packing.encoder(path, 10) is not library and library.remembered > 10
    for n in range(20):
        texts = [f"w{n}x{i} same" for i in range(8)]
        assert few.encode(texts) == library.encode(texts)
        assert len(few.known) <= 10 + 9
