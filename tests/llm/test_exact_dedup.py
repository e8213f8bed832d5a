import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.llm.exact_dedup import exact_dedup, stream_state

ROWS = [(1, "Abc"), (2, "aBC"), (3, "abd"), (4, None), (5, ""), (6, "É"), (7, "é"), (7, "é"), (None, "abc"), (9, "x" * 100_000), (10, "X" * 100_000), (11, "İ")]


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def check(rows, out):
    groups = defaultdict(list)
    for d, t in rows:
        groups[fold(t)].append(d)
    assert len(out) == len(rows)
    got = defaultdict(list)
    for r in out:
        got[r["text_sha256"]].append(r)
    for t, ids in groups.items():
        mine = got[hashlib.sha256(t.encode()).hexdigest()]
        top = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, (r["doc_id"] for r in mine))) == sorted(map(str, ids))
        assert all(r["keep_id"] == top and r["group_size"] == len(ids) for r in mine)
        assert sum(r["kept"] for r in mine) == 1 and next(r for r in mine if r["kept"])["doc_id"] == top


def test_groups(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"file": F.lit("x"), "digest": F.lit("y")}).repartition(3).write.parquet(f"{tmp_path}/d")
    check(ROWS, exact_dedup(spark, f"{tmp_path}/d").collect())


def test_colliding_digests_are_told_apart_by_bytes(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    check(ROWS, exact_dedup(spark, f"{tmp_path}/d", digest=lambda t: F.length(t).cast("string")).collect())


def test_state_goes_on_when_files_come(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df.where("doc_id < 4").write.parquet(f"{tmp_path}/d")
    stream_state(spark, f"{tmp_path}/d", where=f"file://{tmp_path}/s").collect()
    df.where("doc_id IS NULL OR doc_id >= 4").write.mode("append").parquet(f"{tmp_path}/d")
    check(ROWS, exact_dedup(spark, f"{tmp_path}/d", where=f"file://{tmp_path}/s").collect())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    assert exact_dedup(spark, f"{tmp_path}/d").count() == 0
