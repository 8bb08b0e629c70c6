"""The pipeline against its stages in plain Python on a small table."""

from __future__ import annotations


import corpus_pipeline
from test_documents import brute_components
from tillroll.llm import language, quality

SMALL = "/root/testdata/sf0.001"


def test_run_keeps_what_each_stage_keeps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    first = docs.filter(docs.doc_id.isin([d for d, k in judged.items() if k]))
    contents = language.dictionaries(first)
    spoken = [r["doc_id"] for r in language.predict(first, contents, ["doc_id"]).filter("NOT rejected").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = brute_components([(d, texts[d]) for d in spoken])
    want = {}
    for d, (_, head) in groups.items():
        if d == head:
            want[d] = len(texts[d].encode()) + 1
    found: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == want and want


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert step(spark, docs.limit(0), SMALL).count() == 0


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("quality = 1")
    long = docs.filter(docs.text.rlike(r"(\S+\s+){10}"))
    judged = {r["doc_id"]: r for r in quality.judge(long).collect()}
    sound = [d for d, r in judged.items() if not r["base_failed"]]
    assert sum(judged[d]["kept"] for d in sound) >= 0.99 * len(sound)
