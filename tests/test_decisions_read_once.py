"""What makes ideas reads whole texts, so decisions reads its ideas once."""

from pyspark.sql import functions as F

from loomgraph.operators import ideas as I

TEXTS = [f"word{i % 7} some words of an idea that is told by number {i % 5}" for i in range(40)]


def test_ideas_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(TEXTS)], "id long, statement string, level int")
    I.decisions(rows.mapInPandas(seen, rows.schema)).collect()
    assert made.value == len(TEXTS)


def test_named_ideas_are_decided_alike(spark):
    rows = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(TEXTS)], "id long, statement string, level int")
    one = sorted(map(tuple, I.decisions(rows).collect()))
    assert sorted(map(tuple, I.decisions(I.first_wordings(rows).withColumn("relation", F.lit("x"))).collect())) == one
    assert len(one) == len(TEXTS)
