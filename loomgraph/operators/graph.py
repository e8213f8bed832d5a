"""Roll-ups of the graph for a view: nodes, edges, degrees, domains, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.edges import collapsed, neighbours
from loomgraph.operators.similarity import knn_join


def nodes(ideas: DataFrame, links: DataFrame) -> DataFrame:
    """(slug, statement, type, domain, level, papers, cites)."""
    cited = links.groupBy("slug").agg(F.count("*").alias("papers"), F.array_join(F.sort_array(F.collect_set(F.col("pmid").cast("string"))), ",").alias("cites"))
    return ideas.join(cited, "slug", "left").select("slug", "statement", "type", "domain", "level", F.coalesce("papers", F.lit(0)).alias("papers"), F.coalesce("cites", F.lit("")).alias("cites"))


def degrees(ideas: DataFrame, edges: DataFrame) -> DataFrame:
    """(slug, degree): distinct neighbours."""
    n = neighbours(edges).groupBy("id").agg(F.count("*").alias("degree"))
    return ideas.select("slug").join(n, F.col("slug") == F.col("id"), "left").select("slug", F.coalesce("degree", F.lit(0)).alias("degree"))


def radius(degree, papers):
    return 3.5 + F.sqrt(degree) * 1.6 + F.when(papers > 1, 2.0).otherwise(0.0)


def domain_slots(ideas: DataFrame, slots: int = 8) -> DataFrame:
    """(domain, n, slot): the largest domains get slots 1.. and all others slot 0."""
    counted = ideas.groupBy("domain").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "domain").limit(slots).withColumn("slot", F.row_number().over(Window.orderBy(F.desc("n"), "domain")))
    return counted.join(F.broadcast(top.select("domain", "slot")), "domain", "left").select("domain", "n", F.coalesce("slot", F.lit(0)).cast("long").alias("slot"))


def header(ideas: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """One row: numbers of nodes, drawn edges and papers."""
    one = ideas.agg(F.count("*").alias("nodes"))
    two = collapsed(edges).agg(F.count("*").alias("edges"))
    three = links.agg(F.count_distinct("pmid").alias("papers"))
    return one.crossJoin(two).crossJoin(three)


def cited_papers(papers: DataFrame, links: DataFrame) -> DataFrame:
    """(pmid, title, local) of cited papers that exist; the id where there is no title."""
    cited = links.select("pmid").distinct()
    title = F.when(F.coalesce("title", F.lit("")) == "", F.col("pmid").cast("string")).otherwise(F.col("title"))
    return papers.join(cited, "pmid", "left_semi").select("pmid", title.alias("title"), (F.coalesce("source", F.lit("")) != "").alias("local"))


OTHER = "other"


def visible(ideas: DataFrame, text: str | None = None, domains: list[str] | None = None, shown: DataFrame | None = None) -> DataFrame:
    """Ideas of one of domains that a search finds.

    `other` among domains stands for all without a slot of their own. shown: slugs that a semantic
    search found; they then count instead of the wording.
    """
    out = ideas
    if domains is not None:
        fits = F.col("domain").isin(*domains)
        if OTHER in domains:
            slots = domain_slots(ideas).where("slot = 0").select("domain", F.lit(True).alias("_other"))
            out = out.join(slots, "domain", "left")
            fits = fits | F.col("_other").isNotNull()
        out = out.where(fits).drop("_other")
    if shown is not None:
        return out.join(shown.select("slug"), "slug", "left_semi")
    return out if not text else out.where(F.contains(F.lower("statement"), F.lit(text.lower())))


FADED, FAR, BESIDE, PLAIN = 0.12, 0.15, 0.95, 0.9


def emphasis(ideas: DataFrame, seen: DataFrame, edges: DataFrame, selected: DataFrame | None = None, searching: bool = False) -> DataFrame:
    """(slug, weight): how strongly a view draws each idea. selected: one slug, whose neighbours stand out."""
    marked = ideas.select("slug").join(seen.select("slug", F.lit(True).alias("_seen")), "slug", "left")
    plain = F.lit(1.0 if searching else PLAIN)
    if selected is not None:
        chosen = selected.select("slug").withColumn("_own", F.lit(True))
        beside = neighbours(edges).join(chosen, F.col("id") == F.col("slug")).select(F.col("other").alias("slug"), F.lit(True).alias("_beside")).distinct()
        marked = marked.join(chosen, "slug", "left").join(beside, "slug", "left")
        plain = F.when(F.col("_own"), 1.0).when(F.col("_beside"), BESIDE).otherwise(FAR)
    return marked.select("slug", F.when(F.col("_seen"), plain).otherwise(FADED).alias("weight"))


def previews(rows: DataFrame, key: str, *order, n: int = 3) -> DataFrame:
    """The first n rows of each key with their place, and how many more there are."""
    w = Window.partitionBy(key)
    placed = rows.withColumns({"place": F.row_number().over(w.orderBy(*order)), "more": F.greatest(F.count("*").over(w) - n, F.lit(0))})
    return placed.where(F.col("place") <= n)


def expansions(slugs: DataFrame, edges: DataFrame, relevance: DataFrame) -> DataFrame:
    """(slug, target, relation, relevance): what each idea's edges to existing ideas lead to; 0.5 where nothing is known.

    relevance: slug, relevance (null or absent without a vector), a row for each existing idea.
    """
    known = relevance.select(F.col("slug").alias("target"), "relevance")
    out = edges.join(slugs.select(F.col("slug").alias("source")), "source", "left_semi").join(known, "target")
    return out.select(F.col("source").alias("slug"), "target", "relation", F.coalesce("relevance", F.lit(0.5)).alias("relevance"))


def paper_signals(asked: DataFrame, papers: DataFrame, relevance: DataFrame) -> DataFrame:
    """(pmid, relevance, domains) of papers that a query found: 0 for those that can't be had, 0.3 without a vector; the first five subjects."""
    found = asked.join(papers.select("pmid", "mesh", F.lit(True).alias("_here")), "pmid", "left").join(relevance.select("pmid", "relevance"), "pmid", "left")
    worth = F.when(F.col("_here").isNull(), 0.0).otherwise(F.coalesce("relevance", F.lit(0.3)))
    subjects = F.when(F.col("mesh").isNull(), F.array().cast("array<string>")).otherwise(F.slice("mesh", 1, 5))
    return found.select("pmid", worth.alias("relevance"), subjects.alias("domains"))


def similar_unlinked(vectors: DataFrame, edges: DataFrame, k: int = 25, asked: DataFrame | None = None) -> DataFrame:
    """(query, candidate, score, rank): the k nearest other ideas (id, vec) of each, of any score, that are no neighbours.

    asked: the ideas that search; all if absent, which scores every pair.
    """
    linked = neighbours(edges).select(F.col("id").alias("query"), F.col("other").alias("candidate"))
    return knn_join(vectors if asked is None else asked, vectors, k, exclude=linked).select("query", "candidate", "score", "rank")


def best_match(ideas: DataFrame, degree: DataFrame, text: str, nearest: DataFrame | None = None) -> DataFrame:
    """What a search jumps to: the nearest idea (slug, score) of a semantic search, else the visible one of largest degree."""
    if nearest is not None:
        return ideas.join(nearest.orderBy(F.desc("score"), "slug").limit(1), "slug")
    return visible(ideas, text).join(degree, "slug").orderBy(F.desc("degree"), "slug").limit(1)
