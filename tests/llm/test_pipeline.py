"""The corpus pipeline, each stage against a plain restatement on its own input."""

import corpus_pipeline
from millrace.llm.oracles import ORACLE_SQL
from tests.llm.test_documents import WORD, brute_dedup
from tests.oracle import connect


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, sf).write.parquet(f"{out}/documents.parquet")
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.read.parquet(f"{out}/documents.parquet")
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns and len(after) == len({r.doc_id for r in after})
        ids = {r.doc_id for r in after}
        source = sf if k == 0 else str(tmp_path / str(k - 1))
        if name == "quality rules":
            assert ids == {i for i, kept in connect(source).sql(f"SELECT doc_id, kept FROM ({ORACLE_SQL['op3_quality']})").fetchall() if kept}
        elif name == "n-gram Jaccard join":
            assert ids == {i for i, c in connect(source).sql(f"SELECT doc_id, component_id FROM ({ORACLE_SQL['op10_jaccard_join']})").fetchall() if i == c}
        elif name == "substring dedup":
            want = {i: (n, gone) for i, n, gone, _ in brute_dedup([(i, r.text) for i, r in before.items()])}
            assert ids == {i for i, (n, gone) in want.items() if not gone or gone < n}
            for r in after:
                n, gone = want[r.doc_id]
                assert (r.text == before[r.doc_id].text) if not gone else len(WORD.findall(r.text)) == n - gone
                assert r.n_chars == len(r.text)
        elif name == "mixing sources to target weights":
            assert ids < set(before) and all(before[r.doc_id] == r for r in after)
        else:
            assert ids == set(before)


def test_odd_rows(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd_docs.columns
        docs = spark.createDataFrame(docs.collect(), odd_docs.schema)
    assert docs.count() > 0


def test_clashing_names_and_empty_tables(spark, odd_docs):
    """Columns named like those inside stages, and no rows at all."""
    docs = odd_docs.withColumnsRenamed({"key": "_kept_0", "rank": "_kept_1", "n_words": "component_id"})
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, given, "")
            assert out.columns == docs.columns
            rows = out.collect()
            given = spark.createDataFrame(rows, docs.schema)
        assert bool(rows) == (corpus_pipeline.STAGES[4][1](spark, given, "").count() > 0)
