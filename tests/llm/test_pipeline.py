import __spark_entry__
import corpus_pipeline
from ravelog.llm import decontaminate, line_dedup, simhash_dedup, toxicity
from test_llm_helpers import brute_components_of


def test_stages_follow_each_other(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontaminate", "mix"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        after = {r.doc_id: r for r in out.collect()}
        sizes.append(len(after))
        if name != "mix":
            assert out.columns == columns
        if name == "line_dedup":
            again = {(r.doc_id, r.line_no) for r in line_dedup.repeated_lines(docs).collect()}
            for doc, text in before.items():
                kept = "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, i) not in again)
                assert (after[doc].text == kept and after[doc].n_chars == len(kept)) if doc in after else not kept.strip()
        if name == "simhash_dedup":
            assert set(after) == brute_components_of(before)
        if name == "decontaminate":
            bad = {r.doc_id for r in decontaminate.report(docs, bench).where("contaminated").collect()}
            assert set(after) == set(before) - bad
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert set(after) == {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}
        if name == "mix":
            assert set(after) == set(before)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sizes == sorted(sizes, reverse=True)
    run = corpus_pipeline.run(spark, sf)
    assert run.count() == sizes[-1] and corpus_pipeline.ORACLE_SQL is None


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


def test_stages_take_odd_tables(spark, sf, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).count() == 0, name
        assert stage(spark, odd_docs, sf).count() <= odd_docs.count(), name
    assert simhash_dedup.drop_near_duplicates(odd_docs).columns == odd_docs.columns
