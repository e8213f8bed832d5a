"""Exact dedup: stateful streaming deduplication.

The text column of a file source is read as a stream. A disk-backed state
store (RocksDB, no expiry) keeps for each digest of the normalised text how
often it came, the identifier that stays (the largest) and a content locator
(file and row in it). Rows of one digest are combined on each task before the
shuffle, so a digest that a third of all rows share costs one state row per
task. Rows that hit a digest seen more than once are then read again and
their full bytes compared; should two texts share a digest, they are grouped
by their bytes instead.

Defined results: a null text equals an empty one; a null doc_id is smaller
than any other; of rows that tie on doc_id the one with the largest locator
stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed size of the set of digest prefixes that is broadcast to find hits.
PREFIXES = 1 << 18


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(df: DataFrame, digest) -> DataFrame:
    text = normalised(F.col("text"))
    place = F.struct(F.col("doc_id").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(place.alias("place"), text.alias("norm")).select("place", "norm", digest(F.col("norm")).alias("digest"))


def _glob(path: str) -> str:
    """A pattern that fits path alone: a stream takes a single file only as a pattern."""
    return f"{path[:-1]}[{path[-1]}]"


def stream_state(spark: SparkSession, path: str, digest=sha256_digest, max_bytes: int = 256 << 30, where: str | None = None, partitions: int | None = None) -> DataFrame:
    """Run the stream over all files of path; (digest, n, keep) as the state holds it.

    partitions of the state: the session's shuffle partitions unless given; a checkpoint
    keeps those of its first run, so give what the whole corpus will need.
    max_bytes bounds one micro-batch. `where` is the folder of checkpoint and
    output: given again after new files came, the stream goes on from there.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    where = where or shared_dir(spark)
    keys = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    if partitions:
        keys["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        events = _located(spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(_glob(path)), digest)
        state = events.groupBy("digest").agg(F.count("*").alias("n"), F.max("place").alias("keep"))
        state.writeStream.outputMode("update").queryName(f"exact_{uuid.uuid4().hex}").foreachBatch(
            lambda df, k: df.write.mode("overwrite").parquet(f"{where}/state/batch={k}")
        ).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    empty = spark.createDataFrame([], state.schema)
    try:
        updates = spark.read.parquet(f"{where}/state").select("digest", "n", "keep")
    except Exception as e:  # an empty input makes no batch
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return empty
    # n and keep only grow, so the latest update is the largest
    return updates.groupBy("digest").agg(F.max("n").alias("n"), F.max("keep").alias("keep"))


def exact_dedup(spark: SparkSession, path: str, digest=sha256_digest, max_bytes: int = 256 << 30, where: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row per row of path: doc_id, keep_id, group_size, kept, text_sha256."""
    state = materialize(stream_state(spark, path, digest, max_bytes, where, partitions), "digests")
    rows = _located(spark.read.parquet(path), digest)
    prefix = F.pmod(F.xxhash64("digest"), F.lit(PREFIXES)).alias("prefix")
    hits = state.where("n > 1").select(prefix).distinct()  # PREFIXES rows at most
    seen = rows.select("norm", "digest", prefix).join(F.broadcast(hits), "prefix", "left_semi")
    same = seen.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    clash = materialize(same.where("low <> high").select("digest"), "clashes")
    if clash.isEmpty():
        return _decided(rows.select("place", "digest").join(state, "digest", "left"), F.col("digest") if digest is sha256_digest else None, rows, state)
    # two texts with one digest: those rows are grouped by their bytes
    plain = rows.join(clash, "digest", "left_anti").join(state, "digest", "left").select("place", "norm", "n", "keep")
    odd = rows.join(clash, "digest", "left_semi")
    groups = odd.groupBy("digest", "norm").agg(F.count("*").alias("n"), F.max("place").alias("keep"))
    odd = odd.join(groups, ["digest", "norm"]).select("place", "norm", "n", "keep")
    both = plain.unionByName(odd)
    return _final(both.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256)))


def _decided(joined: DataFrame, sha: Column | None, rows: DataFrame, state: DataFrame) -> DataFrame:
    if sha is None:
        return _final(rows.join(state, "digest", "left").withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256)))
    return _final(joined.withColumn("sha", sha))


def _final(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("place.doc_id").alias("doc_id"),
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("place").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
