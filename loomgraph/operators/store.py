"""The vault: tables of papers, ideas, links, edges, vectors and findings, one keyed log each.

An upsert appends its rows to the buckets of their keys; see `keyed_log` for what readers and
other writers see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.operators.keyed_log import KeyedLog

KEYS = {"papers": ["pmid"], "ideas": ["slug"], "links": ["pmid", "slug"], "edges": ["source", "target", "relation"], "vectors": ["kind", "id"], "findings": ["run", "seq"], "nodes": ["paper", "id"]}
SCHEMAS = {"papers": schemas.PAPER, "ideas": schemas.IDEA, "links": schemas.LINK, "edges": schemas.EDGE, "vectors": schemas.VECTOR, "findings": schemas.FINDING, "nodes": schemas.NODE}


class Vault:
    """A named, independent set of tables below root. A vault of many terabytes should begin with more buckets."""

    def __init__(self, spark: SparkSession, root: str, name: str = "main", buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, f"{root.rstrip('/')}/{name}", buckets

    def table(self, table: str) -> KeyedLog:
        return KeyedLog(self.spark, f"{self.path}/{table}", KEYS[table], SCHEMAS[table], self.buckets)

    def read(self, table: str) -> DataFrame:
        return self.table(table).read()

    def write(self, table: str, rows: DataFrame) -> None:
        """Rows become the whole table."""
        self.table(table).replace(rows)

    def upsert(self, table: str, rows: DataFrame) -> None:
        """New rows replace old ones of the same key; the others stay."""
        self.table(table).upsert(rows)

    def create_ideas(self, rows: DataFrame) -> None:
        """Add ideas whose slug is new; those that exist are left as they are."""
        old = self.read("ideas")
        n = F.row_number().over(Window.partitionBy("slug").orderBy("statement"))
        fresh = rows.join(old.select("slug"), "slug", "left_anti").withColumn("_n", n).where("_n = 1").select(*old.columns)
        self.upsert("ideas", fresh)

    def adopt(self, tables: dict[str, DataFrame]) -> None:
        """Take in another vault's tables, such as those of `sources.vault_folder`; rows here of the same key are replaced."""
        for table, rows in tables.items():
            self.upsert(table, rows)

    def compact(self) -> None:
        """Merge the changes of every table, and delete what no reader of the last week can hold."""
        for table in KEYS:
            log = self.table(table)
            if log.snapshots():
                log.compact()
                log.vacuum()

    def point(self, table: str, **key) -> DataFrame:
        return self.table(table).point(**key)

    def vector(self, kind: str, ident: str) -> list[float] | None:
        """One vector by key, or None."""
        row = self.point("vectors", kind=kind, id=ident).first()
        return None if row is None else row["vec"]

    def keys(self, table: str) -> DataFrame:
        return self.read(table).select(KEYS[table][0]).distinct().orderBy(KEYS[table][0])

    def vectors(self, kind: str, model: str | None = None) -> DataFrame:
        """Vectors of a kind; refuses those of another model."""
        df = self.read("vectors").where(F.col("kind") == kind)
        if model and (other := df.where(F.col("model").isNotNull() & (F.col("model") != model)).select("model").first()):
            raise ValueError(f"the index holds vectors of {other[0]!r}, not of {model!r}; they can't be compared")
        return df


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).where("_n = 1").drop("_n")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Of runs (topic, mode, day, number) the newest of each topic and mode: by day, then by number as a number."""
    return runs.groupBy("topic", "mode").agg(F.max(F.struct("day", "number")).alias("_r")).select("topic", "mode", "_r.day", "_r.number")


def existing(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.join(table.select(key), key, "left_semi")


def missing(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.join(table.select(key), key, "left_anti")


def extraction_path(papers: DataFrame, processed: DataFrame, fulltext: DataFrame) -> DataFrame:
    """(pmid, path): how each paper is read. skip: done, or nothing to read; fulltext: three paragraphs or more and no local source; else abstract."""
    n = fulltext.groupBy("pmid").agg(F.count("*").alias("_p"))
    done = processed.select("pmid").distinct().withColumn("_done", F.lit(True))
    joined = papers.join(n, "pmid", "left").join(done, "pmid", "left")
    full = (F.coalesce("_p", F.lit(0)) >= 3) & (F.coalesce("source", F.lit("")) == "")
    path = F.when(F.col("_done"), "skip").when(full, "fulltext").when(F.coalesce("abstract", F.lit("")) != "", "abstract").otherwise("skip")
    return joined.select("pmid", path.alias("path"))


def paper_view(papers: DataFrame, links: DataFrame, ideas: DataFrame) -> DataFrame:
    """(pmid, markdown) of every paper, with its linked ideas that exist."""
    named = links.join(ideas.select("slug", "statement"), "slug").groupBy("pmid").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.concat(F.lit("- "), "relation", F.lit(": "), "statement").alias("line")))), lambda x: x["line"]), "\n").alias("_l")
    )
    p = papers.join(named, "pmid", "left")
    own = F.coalesce("summary", F.lit(""))
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), F.coalesce("title", "pmid")),
        F.concat_ws(" · ", F.nullif("journal", F.lit("")), F.nullif("year", F.lit("")), "pmid"),
        F.when(F.size("mesh") > 0, F.concat(F.lit("MeSH: "), F.array_join("mesh", ", "))),
        F.when(own != "", F.concat(F.lit("## Summary\n\n"), own)),
        F.when((F.coalesce("abstract", F.lit("")) != "") & (F.col("abstract") != own), F.concat(F.lit("## Abstract\n\n"), "abstract")),
        F.when(F.col("_l").isNotNull(), F.concat(F.lit("## Ideas\n\n"), "_l")),
    )
    return p.select("pmid", text.alias("markdown"))


def idea_view(ideas: DataFrame, links: DataFrame, papers: DataFrame, edges: DataFrame) -> DataFrame:
    """(slug, markdown) of every idea: papers by title (or id), edges whose target exists."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("pmid"))
    cited = links.join(papers.select("pmid", "title"), "pmid", "left").groupBy("slug").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.concat(F.lit("- "), "relation", F.lit(": "), title).alias("line")))), lambda x: x["line"]), "\n").alias("_p")
    )
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" — "), "note")).otherwise("")
    out = edges.join(ideas.select(F.col("slug").alias("target"), F.col("statement").alias("_t")), "target").groupBy(F.col("source").alias("slug")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.concat(F.lit("- "), "relation", F.lit(": "), "_t", note).alias("line")))), lambda x: x["line"]), "\n").alias("_e")
    )
    i = ideas.join(cited, "slug", "left").join(out, "slug", "left")
    text = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), "statement"), F.concat_ws(" · ", "type", "domain", F.concat(F.lit("level "), F.col("level").cast("string"))),
        F.when(F.size("entities") > 0, F.array_join("entities", ", ")), F.concat(F.lit("## Papers\n\n"), "_p"), F.concat(F.lit("## Edges\n\n"), "_e"),
    )
    return i.select("slug", text.alias("markdown"))
