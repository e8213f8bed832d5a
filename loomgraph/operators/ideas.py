"""From documents to ideas, and from ideas to a canonical set with links.

The deterministic model (no network) is written as column expressions: leading
sentences are the summary, the first long sentence is the idea, equal wording
merges, a near idea of another level is a part.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import acronyms, collapse, sentences, slugify, strip, without_headers
from loomgraph.functions.vectors import bow_embedding
from loomgraph.operators.edges import components
from loomgraph.operators.similarity import id_ranges, knn_join
from loomgraph.plans.tables import scratch
from loomgraph.schemas import IDEA_RELATIONS, IDEA_TYPES, PAPER_RELATIONS

MERGE = 0.80
LINK = 0.62
NEIGHBOURS = 8


def default_link(merge: float) -> float:
    return max(0.5, round(merge - 0.18, 2))


def body_sentences(text: Column) -> Column:
    return sentences(without_headers(text))


def mock_summary(text: Column) -> tuple[Column, Column]:
    """(summary, key finding): the first two sentences, at most 400 characters; the first, at most 200."""
    s = body_sentences(text)
    head = F.substring(F.array_join(F.slice(s, 1, 2), " "), 1, 400)
    summary = F.when(head == "", F.substring(without_headers(text), 1, 400)).otherwise(head)
    return summary, F.substring(F.coalesce(F.try_element_at(s, F.lit(1)), F.lit("")), 1, 200)


#: Characters of a text in which its first long sentence is looked for before the whole text is.
HEAD = 1000


def mock_idea_sentence(text: Column) -> Column:
    """The first sentence of 50 characters or more; null if there is none.

    Whatever follows a text's head, its sentences but the last are those of the whole text, unless a header
    that may span lines begins there. So the whole text is split only where these hold no long sentence.
    """
    first = lambda s: F.try_element_at(F.filter(s, lambda x: F.length(x) >= 50), F.lit(1))
    head = F.substring(text, 1, HEAD)
    # one element of an array, so that the head is split once
    early = F.transform(F.array(body_sentences(head)), lambda s: first(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))))
    return F.coalesce(F.when(~F.contains(head, F.lit("Content (")), F.get(early, F.lit(0))), first(body_sentences(text)))


def mock_ideas(docs: DataFrame, key: str, text: str, level: Column | None = None) -> DataFrame:
    """(key, statement, type, relation, domain, entities, level) of the rows that yield an idea."""
    # exploded, since a filter on a column would find the sentence again
    found = docs.withColumn("_s", F.explode_outer(F.array(mock_idea_sentence(F.col(text))))).where(F.col("_s").isNotNull())
    return found.select(
        key,
        collapse(F.rtrim(F.col("_s"), F.lit("."))).alias("statement"),
        F.lit("finding").alias("type"),
        F.lit("supports").alias("relation"),
        F.lit("mock").alias("domain"),
        acronyms(F.col("_s")).alias("entities"),
        (F.lit(0) if level is None else level).cast("int").alias("level"),
    )


def normalised_reply(ideas: Column) -> Column:
    """Coerce a model's ideas: unknown types and relations get defaults, blank statements go, entities are cut to five."""
    domain = lambda i: F.lower(strip(F.when(F.coalesce(i["domain"], F.lit("")) == "", "general").otherwise(i["domain"])))
    shaped = F.transform(
        F.coalesce(ideas, F.array()),
        lambda i: F.struct(
            strip(i["statement"]).alias("statement"),
            F.when(i["type"].isin(*IDEA_TYPES), i["type"]).otherwise("finding").alias("type"),
            F.when(i["relation_to_paper"].isin(*PAPER_RELATIONS), i["relation_to_paper"]).otherwise("supports").alias("relation"),
            domain(i).alias("domain"),
            F.slice(F.filter(F.coalesce(i["entities"], F.array().cast("array<string>")), lambda e: e.isNotNull()), 1, 5).alias("entities"),
        ),
    )
    return F.filter(shaped, lambda i: F.coalesce(i["statement"], F.lit("")) != "")


def extraction_prompt(title: Column, journal: Column, year: Column, mesh: Column, abstract: Column) -> Column:
    """What a model is shown of a paper: a line for each field that is there."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", line("Title", title), line("Journal", journal), line("Year", year), line("Mesh", F.array_join(mesh, ", ")), line("Abstract", abstract))


def extracted(papers: DataFrame, make, key: str = "pmid") -> DataFrame:
    """(key, key_finding, i): the ideas that a model finds in each paper's abstract, one row an idea; make() gives the model in a task."""
    from loomgraph.models import replies
    from loomgraph.prompts import TASKS
    from loomgraph.schemas import EXTRACT_REPLY

    system, schema = TASKS["extract"]
    asked = extraction_prompt(*(F.col(c) for c in ("title", "journal", "year", "mesh", "abstract")))
    told = papers.where("abstract <> ''").select(key, F.from_json(replies(make, system, asked, schema), EXTRACT_REPLY).alias("r"))
    return told.select(key, strip(F.coalesce("r.key_finding", F.lit(""))).alias("key_finding"), F.explode_outer(normalised_reply(F.col("r.ideas"))).alias("i"))


def embedded(ideas: DataFrame) -> DataFrame:
    return ideas.withColumn("vec", bow_embedding("statement"))


def first_wordings(ideas: DataFrame) -> DataFrame:
    """Add canon: the smallest id of those with the same lower-cased statement."""
    return ideas.withColumn("canon", F.min("id").over(Window.partitionBy(F.lower("statement"))))


def candidates(ideas: DataFrame, merge: float = MERGE, link: float = LINK, k: int = NEIGHBOURS, vectors: DataFrame | None = None) -> DataFrame:
    """(id, candidate, rank, score, eligibility) of canonical ideas against those created before them.

    ideas: id (order of arrival), statement. Only first wordings enter the index, so an idea sees
    those of smaller ids; at most k, at least `link` similar. vectors: of the first wordings, as a
    table; without, they are computed and written once.
    """
    if vectors is None:
        found = embedded(first_wordings(ideas).where("id = canon").select("id", "statement"))
        vectors = scratch(ideas.sparkSession)(found.select("id", "vec"), "vectors")
    near = knn_join(vectors, vectors, k, link, earlier=True)
    return near.select(F.col("query").alias("id"), "candidate", "rank", "score", F.when(F.col("score") >= merge, "merge-eligible").otherwise("link-only").alias("eligibility"))


def decisions(ideas: DataFrame, merge: float = MERGE, link: float = LINK, k: int = NEIGHBOURS, vectors: DataFrame | None = None) -> DataFrame:
    """(id, decision, target, relation) of every idea, as the deterministic model and its guards decide.

    A repeated wording merges into its first. A first wording links to its best candidate of
    another level (part_of), else to its best candidate (related_to), else stands alone.
    ideas: id, statement, level; with canon (of first_wordings) as well, a table, which is read as it is.
    """
    write = scratch(ideas.sparkSession)
    if "canon" in ideas.columns:
        named = ideas.select("id", "level", "statement", "canon")
    else:  # read four times below, and what makes ideas reads whole texts
        named = write(first_wordings(ideas.select("id", "statement", "level")), "ideas")
    if vectors is None:
        vectors = write(embedded(named.where("id = canon").select("id", "statement")).select("id", "vec"), "vectors")
    near = candidates(named, merge, link, k, vectors)
    levels = named.select(F.col("id").alias("candidate"), F.col("level").alias("their"))
    own = named.select("id", "level")
    ranked = near.join(levels, "candidate").join(own, "id")
    best = ranked.groupBy("id").agg(
        F.min(F.when(F.col("their") != F.col("level"), F.struct("rank", "candidate"))).alias("other"), F.min(F.struct("rank", "candidate")).alias("any")
    )
    joined = named.join(best, "id", "left")
    merged, part, linked = F.col("id") != F.col("canon"), F.col("other").isNotNull(), F.col("any").isNotNull()
    return joined.select(
        "id",
        F.when(merged, "merge").when(part | linked, "link").otherwise("new").alias("decision"),
        F.when(merged, F.col("canon")).when(part, F.col("other.candidate")).when(linked, F.col("any.candidate")).alias("target"),
        F.when(~merged & part, "part_of").when(~merged & linked, "related_to").alias("relation"),
    )


def guarded(decision: Column, target: Column, ranked: Column, merge: float) -> Column:
    """A model's decision made safe: unknown ones and those for what was not shown are new; a merge needs an eligible candidate, else it links.

    ranked: array of structs (slug, score).
    """
    listed = F.coalesce(F.exists(ranked, lambda r: r["slug"] == target), F.lit(False))
    able = F.exists(ranked, lambda r: (r["slug"] == target) & (r["score"] >= merge))
    return F.when(listed & (decision == "merge") & able, "merge").when(listed & decision.isin("merge", "link"), "link").otherwise("new")


def guard(decision: str | None, target, shown: dict, merge: float) -> tuple[str, object]:
    """What guarded says of one reply, and the target it is left with. shown: the scores of what the model was shown."""
    if decision not in ("merge", "link") or target not in shown:
        return "new", None
    return "merge" if decision == "merge" and shown[target] >= merge else "link", target


#: Ideas of one component that are folded in one task at a time.
GROUP = 16_384


def fold_decisions(ideas: DataFrame, decide, merge: float = MERGE, link: float = LINK, k: int = NEIGHBOURS, group: int = GROUP) -> DataFrame:
    """Canonicalise with any model: decide(idea, ranked) -> {decision, target, relation}.

    Each idea of a vault (columns vault, id, statement, level) sees what the ones before it became, at
    most the k nearest that were not merged. One that is worded like an earlier one of its vault (but
    for case) becomes what that one became, without being asked about. Only ideas that the threshold
    links, over others too, bear on each other: components are folded apart, each in order in a task.
    Of components of more than `group` ideas the ideas come in ranges of ids, one range of each in a
    round; a round is shown the k best of earlier rounds, and of its own range all. Decisions are those
    of one fold over all first wordings.

    Lists of neighbours are cut at 4 * k; where merges leave an idea fewer than k of a cut list, its
    list is made four times as long and the fold repeated, so that no group is paired off whole.
    """
    write = scratch(ideas.sparkSession)
    wording = Window.partitionBy("vault", F.lower("statement"))
    rows = write(ideas.select("vault", "id", "statement", "level").withColumn("first", F.min("id").over(wording)), "ideas")
    firsts = write(rows.where("id = first").drop("first"), "firsts")
    vectors = write(embedded(firsts.select("vault", "id", "statement")).select("vault", "id", "vec"), "vectors")
    depth = 4 * k
    near = write(_listed(vectors, vectors, link, depth), "near")
    while True:
        found = fold_components(firsts, near, decide, merge, k, group)
        short = write(found.where("short").select("id"), f"short{depth}")
        if short.isEmpty():
            break
        depth *= 4
        deeper = _listed(vectors.join(short, "id", "left_semi"), vectors, link, depth)
        near = write(near.join(short, "id", "left_anti").unionByName(deeper), f"near{depth}")
    told = found.drop("short")
    again = rows.where("id <> first").select("vault", F.col("id").alias("_id"), F.col("first").alias("id")).join(told.drop("vault"), "id")
    again = again.select("vault", F.col("_id").alias("id"), F.lit("merge").alias("decision"), F.when(F.col("decision") == "merge", F.col("target")).otherwise(F.col("id")).alias("target"), F.lit(None).cast("string").alias("relation"))
    return told.unionByName(again)


def _listed(asked: DataFrame, vectors: DataFrame, link: float, depth: int) -> DataFrame:
    """(id, candidate, score, cut): the `depth` nearest earlier ideas of the same vault; cut where the list may go on."""
    numbers = vectors.select("vault").distinct().withColumn("domain", F.monotonically_increasing_id())
    numbers = scratch(vectors.sparkSession)(numbers, "vaults")
    one = lambda v: v.join(numbers.withColumnRenamed("vault", "_v"), F.col("vault").eqNullSafe(F.col("_v"))).select("id", "vec", "domain")
    near = knn_join(one(asked), one(vectors), depth, link, earlier=True, same_domain=True)
    return near.select(F.col("query").alias("id"), "candidate", "score", (F.col("rank") == depth).alias("cut"))


def fold_components(rows: DataFrame, near: DataFrame, decide, merge: float, k: int, group: int) -> DataFrame:
    """fold_decisions over given pairs (id, earlier candidate, score, cut); short: fewer than k of a cut list were left."""
    spark = rows.sparkSession
    write = scratch(spark)
    roots = components(near.select(F.col("id").alias("a"), F.col("candidate").alias("b")), write)
    placed = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = placed.groupBy("root").agg(F.count("*").alias("size"))
    placed = write(placed.join(sizes, "root"), "placed")
    large = placed.where(F.col("size") > group)
    n = large.count()
    cuts = id_ranges(large, n, -(-2 * n // group)) if n else []
    ends = near.groupBy("id").agg(F.max("cut").alias("cut"))
    # small components lie together, in order of ids as well: they don't bear on each other
    small = F.pmod(F.xxhash64("root"), F.lit(max(1, 2 * placed.count() // group)))
    own = F.when(F.col("size") > group, F.struct(F.lit(True).alias("large"), F.col("root").alias("of"))).otherwise(F.struct(F.lit(False).alias("large"), small.cast("long").alias("of")))
    placed = placed.join(ends, "id", "left").withColumn("task", own)
    turn = F.lit(0) if not cuts else F.when(F.col("size") > group, sum((F.col("id") >= F.lit(x)).cast("int") for x in cuts)).otherwise(0)
    # in order of turns, so that a round reads its own rows
    placed = write(placed.withColumn("turn", turn).sortWithinPartitions("turn"), "turns")
    turns = placed.select(F.col("id").alias("candidate"), F.col("turn").alias("theirs"), F.col("statement").alias("wording"), F.col("level").alias("their"))
    pairs = write(near.drop("cut").join(placed.select("id", "turn"), "id").join(turns, "candidate").sortWithinPartitions("turn"), "pairs")
    vault = rows.schema["vault"].dataType.simpleString()
    kinds = f"vault {vault}, id long, decision string, target long, relation string, short boolean"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        made, out = set(), []
        for r in pdf.sort_values("id").itertuples():
            seen = [c for c in (r.near if r.near is not None else ()) if c["known"] or c["candidate"] in made]
            ranked = sorted(((c["candidate"], c["score"], {"statement": c["wording"], "level": c["their"]}) for c in seen), key=lambda c: (-c[1], c[0]))[:k]
            told = dict(decide({"id": r.id, "statement": r.statement, "level": r.level}, ranked)) if ranked else {}
            decision, target = guard(told.get("decision"), told.get("target"), {c: s for c, s, _ in ranked}, merge)
            if decision != "merge":
                made.add(r.id)
            relation = told.get("relation") if told.get("relation") in IDEA_RELATIONS else "related_to"
            out.append((r.vault, r.id, decision, target, relation if decision == "link" else None, bool(r.cut) and len(ranked) < k))
        return pd.DataFrame(out, columns=["vault", "id", "decision", "target", "relation", "short"]).astype({"target": "Int64"})

    done = spark.createDataFrame([], kinds)
    parts: list[tuple[int, DataFrame]] = []  # tables of so many rounds: two of one size become one, so a row is written again as often as sizes double
    for t in range(len(cuts) + 1):
        own = pairs.where((F.col("turn") == t) & (F.col("theirs") == t)).withColumn("known", F.lit(False))
        shown = own
        if t:
            before = pairs.where((F.col("turn") == t) & (F.col("theirs") < t)).join(done.where("decision <> 'merge'").select(F.col("id").alias("candidate")), "candidate", "left_semi")
            best = before.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "candidate"))).where(F.col("_n") <= k)
            shown = own.unionByName(best.drop("_n").withColumn("known", F.lit(True)))
        lists = shown.groupBy("id").agg(F.collect_list(F.struct("candidate", "score", "wording", "their", "known")).alias("near"))
        now = placed.where(F.col("turn") == t).join(lists, "id", "left").select("task", "vault", "id", "statement", "level", "near", F.coalesce("cut", F.lit(False)).alias("cut"))
        parts.append((1, write(now.groupBy("task").applyInPandas(fold, kinds), f"done{t}")))
        while len(parts) > 1 and parts[-1][0] == parts[-2][0]:
            (n, one), (_, two) = parts.pop(), parts.pop()
            parts.append((2 * n, write(two.union(one), f"done{t}-{2 * n}")))
        done = reduce(DataFrame.union, [rows for _, rows in parts])
    return done


def with_slugs(ideas: DataFrame) -> DataFrame:
    return ideas.withColumn("slug", slugify(F.col("statement")))
