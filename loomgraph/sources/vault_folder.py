"""Vaults kept as folders of JSON files: papers/<id>/paper.json, ideas/<slug>/idea.json, index/embeddings.json.

Papers and ideas are read file by file in tasks; the index is one JSON object, so one task reads it.
It comes with the model's name, or in the older layout as keys and vectors alone (model null). Its
keys name a kind and an id, as `idea:<slug>`. Folders or files that are not there give empty tables; a
file that is no JSON is an error. A record without an id is known by its folder. Of a paper's
links to one idea, or an idea's edges of one relation to one target, the first counts. A link that only
one of the two records holds counts too, after those of the paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph import schemas

LINKS = "array<struct<slug:string,pmid:string,relation:string>>"
EDGES = "array<struct<relation:string,target:string,note:string>>"


def _records(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(pattern)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema).withColumn("_metadata", F.struct(F.lit("").alias("file_path")))


def _known(key: str) -> Column:
    return F.coalesce(F.nullif(key, F.lit("")), F.url_decode(F.regexp_replace(F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1), r"\+", "%2B")))


def _first(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*columns)


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.VECTOR)
    named = F.from_json("value", "model string, vectors map<string,array<double>>", {"mode": "FAILFAST"})
    flat = F.from_json("value", "map<string,array<double>>", {"mode": "FAILFAST"})
    dated = F.get_json_object("value", "$.vectors").isNotNull()
    both = text.select(F.when(dated, named["model"]).alias("model"), F.explode(F.when(dated, named["vectors"]).otherwise(flat)).alias("key", "vec"))
    at = F.instr("key", ":")
    kind = F.when(at > 0, F.substring_index("key", ":", 1)).otherwise("")
    return both.select(kind.alias("kind"), F.expr("substr(key, instr(key, ':') + 1)").alias("id"), "vec", "model")


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables papers, ideas, links, edges and vectors of such a folder."""
    folder = folder.rstrip("/")
    papers = _records(spark, f"{folder}/papers/*/paper.json", f"{schemas.PAPER}, ideas {LINKS}").withColumn("pmid", _known("pmid"))
    ideas = _records(spark, f"{folder}/ideas/*/idea.json", f"{schemas.IDEA}, papers {LINKS}, edges {EDGES}").withColumn("slug", _known("slug"))
    own = papers.select("pmid", F.posexplode("ideas").alias("_at", "_l")).select("pmid", "_l.slug", "_l.relation", F.lit(0).alias("_side"), "_at")
    theirs = ideas.select("slug", F.posexplode("papers").alias("_at", "_l")).select("_l.pmid", "slug", "_l.relation", F.lit(1).alias("_side"), "_at")
    links = own.unionByName(theirs).withColumn("seq", (F.col("_side") * F.lit(1 << 32) + F.col("_at")).cast("long"))
    edges = ideas.select(F.col("slug").alias("source"), F.posexplode("edges").alias("seq", "_e")).select("source", "_e.target", "_e.relation", "_e.note", F.col("seq").cast("long"))
    return {
        "papers": papers.select("pmid", "title", "abstract", "journal", "year", F.coalesce("mesh", F.array().cast("array<string>")).alias("mesh"), "source", "summary"),
        "ideas": ideas.select("slug", "statement", "type", "domain", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities")),
        "links": _first(links, ["pmid", "slug"], ["seq"], ["pmid", "slug", "relation", "seq"]),
        "edges": _first(edges, ["source", "target", "relation"], ["seq"], ["source", "target", "relation", "note", "seq"]),
        "vectors": _vectors(spark, f"{folder}/index/embeddings.json"),
    }
