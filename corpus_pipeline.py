"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.

Defined results: nulls, empty texts and repeated rows are handled as each
stage's operator says; of an empty table every stage returns no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, shelve
from loomgraph.llm.langid import UNKNOWN, held_out, learn, predict
from loomgraph.llm.line_dedup import dedup_lines
from loomgraph.llm.near_dedup import dedup_near
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.suffix_dedup import dedup_substrings

#: Bytes that a repeated passage must have at least to be cut: fewer than 50 words have.
PASSAGE = 240


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; without letters (and so in none) they go."""
    model = learn(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    if not model.langs:
        return docs
    inner, restore = shelve(docs, "text")
    return restore(predict(inner, model, *inner.columns).where(F.col("lang_pred") != UNKNOWN))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to an earlier one."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return dedup_near(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of long passages; the first copy stays."""
    return dedup_substrings(docs, PASSAGE, keep_first=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids and their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("suffix_array_dedup", substrings),
    ("best_fit_packing", packing),
]

#: No stage of the chain after language ID is one SQL query; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
