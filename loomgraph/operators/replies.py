"""What a model was asked and said, as a content-addressed table: nothing is asked twice.

A reply's key is the hash of the model's name, the task and what is asked, so a table serves any
number of queries, and a run that was broken off asks what is missing only. Rows are appended; a
key that two writers asked at once has two rows, of which the greater is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.models import ModelError, vectors_of


class Replies:
    """Replies of the model called `name` below path. kind: their type, as a column's."""

    def __init__(self, spark: SparkSession, path: str, name: str, kind: str = "string", tasks: int = 16):
        self.spark, self.path, self.name, self.kind, self.tasks = spark, path, name, kind, tasks

    def read(self) -> DataFrame:
        """(key, reply), a row a key."""
        schema = f"key string, reply {self.kind}"
        try:
            rows = self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        return rows.groupBy("key").agg(F.max("reply").alias("reply"))

    def key(self, asked: Column, task: str) -> Column:
        return F.sha2(F.concat_ws("\x00", F.lit(self.name), F.lit(task), asked), 256)

    def ask(self, rows: DataFrame, asked: str, call: Callable[[Column], Column], task: str = "") -> DataFrame:
        """rows with a reply to column `asked`; null where that is null. call(column) asks the model.

        Each text is asked once, by `tasks` tasks at most, which bounds the calls at one time. Null
        replies are failures: the others are stored, then ModelError is raised.
        """
        keyed = rows.withColumn("_key", F.when(F.col(asked).isNotNull(), self.key(F.col(asked), task)))
        wanted = keyed.where("_key IS NOT NULL").select(F.col("_key").alias("key"), asked).groupBy("key").agg(F.min(asked).alias("_asked"))
        new = wanted.join(self.read().select("key"), "key", "left_anti").repartition(self.tasks, "key")
        new.select("key", call(F.col("_asked")).alias("reply")).where("reply IS NOT NULL").write.mode("append").parquet(self.path)
        known = self.read()
        if failed := wanted.join(known.select("key"), "key", "left_anti").count():
            raise ModelError(f"{failed} calls failed; what was said is stored, so a new run asks these only")
        return keyed.join(known.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def embedded_by(rows: DataFrame, text: str, make, replies: Replies) -> DataFrame:
    """rows with vec, the vector of column `text` by the model that make() gives in a task; null for null.

    replies (kind array<double>) keeps vectors by model and text: only new texts are asked, and those of
    two models never meet.
    """
    return replies.ask(rows, text, lambda t: vectors_of(make, t), "embed").withColumnRenamed("reply", "vec")
