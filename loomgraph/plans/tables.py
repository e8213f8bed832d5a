"""Written tables that cut lineage, in the shared folder the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # one machine only
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, own, True)
        base = "file://" + own
    return f"{base.rstrip('/')}/loomgraph-{uuid.uuid4().hex}"


def scratch(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """write(df, name): df as a table below spark.checkpoint.dir, read again."""
    where = folder(spark)

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{where}/{name}")
        return spark.read.schema(df.schema).parquet(f"{where}/{name}")

    return write
