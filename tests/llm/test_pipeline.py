"""The pipeline's stages: each works on all its predecessor kept, and its decisions take effect."""

import collections

from tessella.llm import toxicity
from tessella.llm.base import settle, table

import corpus_pipeline as pipeline
from pyspark.sql import functions as F


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = {}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir), "test-stage")
        kept[name] = (before, docs)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = kept["toxicity"]
    model = toxicity.fit(before, table(spark, sf_dir, "labels"))
    assert after.count() == toxicity.scored(before, model).where("score < 0.3").count()
    before, after = kept["line dedup"]
    texts = {r.doc_id: r.text.split("\n") for r in before.collect()}
    for r in after.collect():
        left = iter(texts[r.doc_id])
        assert all(x in left for x in r.text.split("\n")) and r.n_chars == len(r.text)
    before, after = kept["n-gram Jaccard"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()} and after.count() == after.select("doc_id").distinct().count()
    before, after = kept["mixing"]
    assert max(collections.Counter(r.doc_id for r in after.collect()).values()) <= 3
    before, after = kept["SentencePiece"]
    assert before.count() == after.count() and after.where("n_ids <> size(ids)").count() == 0
    assert pipeline.run(spark, sf_dir).count() == after.count()


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, ids of several texts and clashing columns, through every stage."""
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(1, same, "a"), (2, same + " x", "a"), (3, None, "a"), (4, "", None), (None, "no id at all in this row", "b"), (None, None, None), (5, "one\n\ntwo three", "b"), (5, "other text under that id", "b"), (6, "again and again and again here", "a"), (6, "again and again and again here", "a"), (7, "word " * 60_000, "c"), (8, "z" * 300_000, "c")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit("x") for n in "removed _d _text h _h name _name score ids n".split()})
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = settle(out, "test-odd")
        kept[name] = docs.collect()
    assert len(kept["toxicity"]) == len(rows)
    texts = lambda name: {(r.doc_id, r.text) for r in kept[name]}
    assert texts("line dedup") == {(i, t) for i, t, _ in rows if i != 2}
    assert texts("n-gram Jaccard") == texts("line dedup") and len(kept["n-gram Jaccard"]) == len(texts("line dedup"))
    assert texts("mixing") <= texts("line dedup") and {r.doc_id for r in kept["SentencePiece"]} == {i for i, _ in texts("mixing")}
    empty = docs_of_nothing = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        empty = settle(stage(spark, empty, str(tmp_path)), "test-none")
    assert empty.count() == docs_of_nothing.count() == 0
