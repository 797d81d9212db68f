import corpus_pipeline
from meterlake.llm import quality
from meterlake.llm.common import written
from tests.conftest import TINY
from tests.llm import test_containment, test_jaccard
from tests.llm.cases import no_documents, odd_documents


def test_stages_agree_with_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, TINY), name)
        steps.append(docs)
        assert docs.columns == columns or name == "sharding"
    good, single, clean, mix, shards = steps
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    first = spark.read.parquet(f"{TINY}/documents.parquet")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in quality.sampled(first, labels)[0].where("selected").collect())
    groups = test_jaccard.brute([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, _, c in groups if d == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in test_containment.brute([(r.doc_id, r.text) for r in single.collect()], items)}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if r.doc_id not in leaks)
    assert {r.doc_id for r in mix.collect()} <= {r.doc_id for r in clean.collect()} and mix.count() > 0
    assert sorted(r.doc_id for r in shards.collect()) == sorted(r.doc_id for r in mix.collect())
    assert corpus_pipeline.run(spark, TINY).count() == shards.count()


def test_stages_take_odd_and_no_documents(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, TINY), name)
            assert docs.columns == columns or name == "sharding"


def test_the_mix_keeps_documents_without_an_id(spark):
    rows = [(None if i % 2 else i // 4, f"text number {i} of one source", "a") for i in range(40)]
    docs = spark.createDataFrame([*rows, (None, None, "a")], "doc_id long, text string, source string")
    mix = corpus_pipeline.source_mix(spark, docs, TINY)
    assert sorted(map(tuple, mix.collect()), key=str) == sorted(rows, key=str)
