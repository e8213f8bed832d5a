"""Queries over odd texts against their SQL."""

import duckdb

from loomgraph.plans import catalog

ODD = [
    "DOESBO DORA EL Ñ ES, CIÓNMIÍRR ASESRR ÑOS UEÍOS and more words follow.",
    "ÉAI ÉONLEEAU POUR AN ÉONQUEÊ AIVI AI, ÉENAITREOIAUX and more words follow.",
    "under_DNA RNA2 ABCdef ÀDNA DNAÀ DNÁ XYZ and more words follow here too.",
]


def both(spark, tmp_path, name, texts=ODD):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in told.description]
    return sorted(map(tuple, got.select(*names).collect())), sorted(told.fetchall())


def test_idea_query_string_words_end_as_in_ascii(spark, tmp_path):
    got, told = both(spark, tmp_path, "idea_query_string")
    assert got == told and len(got) == 3


def test_mock_idea_entities_end_as_in_ascii(spark, tmp_path):
    got, told = both(spark, tmp_path, "mock_idea")
    assert got == told and len(got) == 3


BREAKS = [
    "Title: a\rfirst words, more words and then some more words to be long enough. Next.",
    "A line\u2028Abstract: words, more words and then some more words to be long enough. Next.",
    "Journal: x\x85words, more words and then some more words to be long enough\nand on. Next.",
    "\xa0\u3000words, more words and then some more words to be long enough\u2003\xa0. Next.",
    "DNA words\x01more words and then some more words to be long enough, so many. RNA next.",
    "words, more words and then some more words to be long enough, so many \u2003\u2028",
]


def test_mock_idea_lines_and_spaces_as_in_sql(spark, tmp_path):
    got, told = both(spark, tmp_path, "mock_idea", BREAKS)
    assert got == told and len(got) == 4  # the first and the third are headers up to \\n, or to the end


LONG = ["a - b\tc  é f\ng h", "", "  ", "É é", "--- a1", "one two three four five six seven", " 1 2 3 4 5é 6ñx y", "İstanbul K ΑΣ x", "é" * 40_000 + " a b", "- " * 40_000 + "z", "w" * 40_000 + " v", "x " * 40_000]


def test_slugs_of_odd_texts(spark, tmp_path):
    got, told = both(spark, tmp_path, "slugify", LONG)
    assert got == told and len(got) == len(LONG)


def test_slugs_read_no_more_than_six_words(spark):
    from pyspark.sql import functions as F

    from loomgraph.functions.text import slugify

    plan = spark.range(1).select(F.repeat(F.lit("some words "), 9).alias("s")).select(slugify(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(regexp_replace(lower(" not in plan


def test_ideas_of_long_texts_whose_heads_end_anywhere(spark, tmp_path):
    long, short = "words, more words and then some more words to be long enough", "short ones. "
    ends = [long + ". Next words", long + "\nContent (a. b\nc): d", long + "!\nTitle: x. y", long + "\n Title: x. y " + long + ". z", long + "\x01" + long, long + ".  \n ", long + "?", "Title: " + long + ". ", "no gap." + long, "Abstract: \n \n" + long + ". "]
    pads = [short * n + "w" * m + " " for n in (0, 1, 70, 75, 76, 77, 80, 82, 83, 84, 170) for m in (1, 7, 48)]
    texts = [p + e + tail for p in pads for e in ends for tail in ("", " and the end", ". " + long)]
    texts += ["Content (" + "x. " * 500 + "): " + long, "Content (" + "x. " * 500 + long + ". more"]
    got, told = both(spark, tmp_path, "mock_idea", texts)
    assert got == told and len(got) > 800


def test_ideas_split_no_more_than_heads(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomgraph.operators.ideas import mock_idea_sentence

    texts = spark.range(2).select(F.concat(F.lit("words " * 20 + ". next. "), F.repeat(F.lit("a. "), 3000)).alias("t"))
    found = texts.select(mock_idea_sentence(F.col("t")).alias("s")).where(F.length("s") < 200)
    assert found.count() == 2
    assert "substring(t" in texts.localCheckpoint().select(mock_idea_sentence(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
