import corpus_pipeline
from callgauge.llm.common import settled, table
from tests.oracle import SF


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = settled(stage(spark, docs, SF))
        if stage is not corpus_pipeline.bpe_encode:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        if stage in (corpus_pipeline.quality_rules, corpus_pipeline.simhash_near_dedup):
            assert 0 < out.count() < before and out.join(docs, "doc_id", "left_anti").count() == 0
            before = out.count()
        if stage is corpus_pipeline.suffix_array_dedup:
            assert out.count() == before
        docs = out
    assert docs.filter("size(ids) = 0 AND n_chars > 0").count() == 0
