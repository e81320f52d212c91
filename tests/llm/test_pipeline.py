"""The pipeline's stages, each on what the one before kept."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SF, clashing, odd_documents, unharmed
from tests.llm.test_exact import components_by_hand
from tidelog.llm import quality
from tidelog.llm.bpe import VOCABULARY
from tidelog.llm.common import staged


def test_stages(spark, documents):
    docs, after = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, SF))
        after[name] = docs
        if name == "quality classifier":
            model = quality.learned(before, spark.read.parquet(f"{SF}/labels.parquet"))
            rejected = {r.doc_id for r in quality.score(before, model).where("not keep").collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - rejected
            labels = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
            assert labels.where("quality = 0").count() <= 0.1 * labels.count()
        elif name == "exact dedup":
            best = {}
            for r in before.collect():
                key = (r.text or "").encode().lower()
                best[key] = max(best.get(key, -1), r.doc_id)
            assert {r.doc_id for r in docs.collect()} == set(best.values())
        elif name == "n-gram Jaccard join":
            found = components_by_hand([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c for _, _, c in found})
        elif name.startswith("mixing"):
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    mixed, tokens = list(after.values())[-2:]
    assert tokens.count() == mixed.count()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in tokens.limit(50).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows(spark, tables, empty):
    docs = odd_documents(spark).limit(0) if empty else odd_documents(spark)
    sf = tables(documents=docs, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == 0 if empty else out.count() > 0
    if not empty:
        docs = clashing(docs)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, sf))
            assert unharmed(docs), name
        assert stage is corpus_pipeline.mix and corpus_pipeline.encode(spark, docs, sf).count() == docs.count() == out.count()
