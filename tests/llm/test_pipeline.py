import corpus_pipeline
from graphloom.llm.common import staged


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = staged(stage(spark, docs, sf), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            assert 0.5 * docs.count() < out.count() <= docs.count()
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        docs = out


def test_run(spark, docs):
    item = "one two three four five six seven eight nine ten"
    text = "these are the words of a document that nothing else holds and that is long enough"
    d = docs([(1, None), (2, ""), (3, text), (4, text), (5, f"{text} {item} and then some more words to follow here and there"), (6, "token=abcdefgh12 in plain words"), (None, "no id at all"), (7, "12 34")])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} == {3, 5, 6, None}
    assert corpus_pipeline.run(spark, docs([])).count() == 0
