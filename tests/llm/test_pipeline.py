import corpus_pipeline
from loomgraph.llm.common import materialize


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, n = docs.columns, docs.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == names
        kept.append(docs.count())
    assert n >= kept[0] >= kept[1] >= kept[2] >= kept[3] > n * 0.7
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.select("doc_id").distinct().count() == kept[3]
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_empty_and_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None, "s", 0, "u"), (1, "", "en", "s", 0, "u"), (2, "...", None, None, 3, "u"), (3, "the text of all", "en", "s", 15, "u"), (3, "the text of all", "en", "s", 15, "u")], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, ""), name)
        assert docs.count() == (1 if docs.count() else 0)


def test_columns_with_clashing_names_pass_through(spark):
    names = ["spans", "lang_pred", "removed_lines", "_uid", "_by", "sketch", "n_removed", "score", "held_out", "_gone", "k"]
    texts = ["the first text is about one thing and the other thing of it", "a second and quite different text stands here for all to read", "the first text is about one thing and the other thing of it"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), name)
        assert docs.columns[5:] == names
    assert sorted((r["doc_id"], r["spans"], r["_uid"], r["lang_pred"]) for r in docs.collect()) == [(k, f"spans{k}", f"_uid{k}", f"lang_pred{k}") for k in (0, 1)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 2
