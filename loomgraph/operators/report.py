"""Reports: retrieval of ideas for questions, assembly, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import capitalised, squeezed, strip
from loomgraph.operators.similarity import knn_join

PER_SECTION = 40


def retrieved(questions: DataFrame, ideas: DataFrame, k: int = PER_SECTION) -> DataFrame:
    """(question, idea, rank, score): the k ideas nearest to each question (both: id, vec)."""
    shift = (1 << 62)
    asked = questions.select((F.col("id") + F.lit(shift)).alias("id"), "vec")  # ids apart from the ideas'
    return knn_join(asked, ideas.select("id", "vec"), k).select((F.col("query") - F.lit(shift)).alias("question"), F.col("candidate").alias("idea"), "rank", "score")


def most_cited(links: DataFrame, k: int = PER_SECTION) -> DataFrame:
    """The k ideas of most papers, ties by slug: what a report uses where there is no index."""
    return links.groupBy("slug").agg(F.count_distinct("pmid").alias("papers")).orderBy(F.desc("papers"), "slug").limit(k)


def cited_ids(text: Column) -> Column:
    """Distinct numbers after `PMID`, ascending; ids of local documents aren't numbers and are left out."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"PMID:? ?([0-9]{1,18})"), F.lit(1)), lambda x: x.cast("bigint"))))


def assembled(topic: Column, head: Column, sections: Column) -> Column:
    """Title, summary, sections, the summary's open questions, and computed sources."""
    mark = "## Open questions"
    at = F.instr(head, mark)
    summary = strip(F.when(at > 0, F.substring(head, F.lit(1), at - 1)).otherwise(head))
    open_ = F.when(at > 0, strip(F.substring(head, at, F.length(head)))).otherwise("")
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), capitalised(topic)), summary, sections, open_)
    ids = cited_ids(body)
    sources = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("- https://pubmed.ncbi.nlm.nih.gov/"), i.cast("string"), F.lit("/"))), "\n")
    return squeezed(F.when(F.size(ids) > 0, F.concat(body, F.lit("\n\n## Sources\n\n"), sources)).otherwise(body))


def recent(findings: DataFrame, by: str, order: str, n: int = 120) -> DataFrame:
    """The last n findings of each run, in their order."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return findings.withColumn("_n", back).where(F.col("_n") <= n).drop("_n")
