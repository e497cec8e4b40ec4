import corpus_pipeline
from tidemark.llm import decontaminate, jaccard_join, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "tokens"]
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept.append(docs.count())
        ids = {r.doc_id for r in docs.collect()}
        if name == "near_duplicates":
            want = {r.component_id for r in jaccard_join.jaccard_join(before).collect()}
            assert ids == want and kept[-1] == len(want)
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
            assert ids == {r.doc_id for r in before.collect()} - bad
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
            assert ids == {r.doc_id for r in before.collect()} - bad
    assert kept == sorted(kept, reverse=True) and kept[-1] < kept[0]
    assert corpus_pipeline.run(spark, SF).count() == kept[-1]


def test_odd_rows_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", "en", "s", 1), (1, "a b c d e f g h", "en", "s", 1), (None, "a b c d e f g h", "en", None, None), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(map(str, got)) == ["1", "2", "None"]
