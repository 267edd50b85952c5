"""The pipeline's stages against plain versions of what each one decides, on the smallest tables."""

import corpus_pipeline
from ledgerline.llm import queries
from tests.conftest import FOLDER
from tests.llm.test_operators import plain_components, plain_fingerprint, plain_judgement, plain_targets, plain_words


def test_stages(spark):
    docs = queries.table(spark, FOLDER, "documents")
    bench = [(str(r.item_id), r.text) for r in queries.table(spark, FOLDER, "benchmark").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_duplicates", "decontamination", "pii_pseudonyms", "mixing"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    read = stages[0](spark, docs, FOLDER)
    assert read.columns == docs.columns and read.count() >= 0.95 * docs.count()
    rows = read.collect()
    named = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows], 2)
    single = stages[1](spark, read, FOLDER)
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.doc_id for r in rows if named[plain_fingerprint(r.text)] == r.doc_id)
    clean = stages[2](spark, single, FOLDER)
    left = {r.doc_id: r for r in clean.collect()}
    assert set(left) == {r.doc_id for r in single.collect() if not plain_judgement(r.text, bench)[-1]}
    private = stages[3](spark, clean, FOLDER).collect()
    assert {r.doc_id for r in private} == set(left) and all(r.n_chars == len(r.text) for r in private)
    assert any(r.text != left[r.doc_id].text for r in private)
    mixed = stages[4](spark, spark.createDataFrame(private, docs.schema), FOLDER).collect()
    sizes, taken = {}, {}
    for r in private:
        sizes[r.source] = sizes.get(r.source, 0) + len(plain_words(r.text))
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + r.words
    assert all(abs(taken.get(s, 0) - t) <= 128 for s, t in plain_targets(sizes).items())


def test_awkward_tables(spark):
    docs = queries.table(spark, FOLDER, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (2, "x", "en", "s", 1), (2, "x", "en", "s", 1)], docs.schema)
    for table in (docs.limit(0), odd, docs.limit(30).union(odd)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, FOLDER)
            if name != "mixing":
                assert out.columns == docs.columns
            out.collect()


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert {"shard", "nth", "source", "doc_id", "words", "text"} <= set(out.columns) and out.count() > 0
