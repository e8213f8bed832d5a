"""Summary trees: texts become leaves, leaves are grouped and condensed level by level.

Packing is a fold over one text's parts. Column expressions would copy what
is packed so far at every part, so it is one linear pass in Arrow batches. All
documents go up one level together; the loop runs as often as the deepest
tree has levels, and each level is written before the next is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import WS, strip
from loomgraph.models import replies as column_of
from loomgraph.operators.ideas import mock_idea_sentence, mock_summary, normalised_reply
from loomgraph.operators.replies import Replies
from loomgraph.prompts import TASKS
from loomgraph.schemas import SUMMARY_REPLY

LEAF = 1200
GROUP = 3500
MOST = 500


def pieces_of(part: str, limit: int) -> Iterator[str]:
    """A paragraph in pieces of at most limit characters; the last is what is left, maybe nothing.

    A cut is at the last space within the limit if that lies past the middle, else at the limit.
    """
    while len(part) > limit:
        space = part.rfind(" ", 0, limit)
        at = space if space > limit // 2 else limit
        yield part[:at].strip(WS)
        part = part[at:].strip(WS)
    yield part


def leaf_texts(text: str, limit: int = LEAF, separator: str = "\n\n") -> list[str]:
    """Consecutive paragraphs packed into leaves of at most limit characters.

    A paragraph over the limit closes the leaf before it; all its pieces but the last stand
    alone, and the last opens a new leaf.
    """
    made: list[list[str]] = []
    room = -1  # characters left in the last leaf; negative: it is closed
    for whole in text.split(separator):
        *alone, rest = pieces_of(whole.strip(WS), limit)
        if alone:
            made += [[piece] for piece in alone]
            room = -1
        if rest:
            if len(rest) > room:
                made.append([])
                room = limit
            made[-1].append(rest)
            room -= len(rest) + 2
    return ["\n\n".join(parts) for parts in made]


def leaves(text: Column, limit: int = LEAF, separator: str = "\n\n") -> Column:
    return F.pandas_udf(lambda texts: texts.map(lambda t: leaf_texts(t or "", limit, separator)), "array<string>", F.PandasUDFType.SCALAR)(text)


def group_numbers(sizes, limit: int) -> list[int]:
    """Numbers (from 0) of the groups of consecutive parts: a group takes parts while its size stays within limit.

    A part adds its length and two for the separator; a part over the limit is a group of its own.
    """
    numbers, group, room = [], -1, -1
    for n in sizes:
        if n > room:
            group, room = group + 1, limit
        room -= n + 2
        numbers.append(group)
    return numbers


def packed(sizes: Column, limit: int) -> Column:
    return F.pandas_udf(lambda rows: rows.map(lambda r: group_numbers(r if r is not None else [], limit)), "array<int>", F.PandasUDFType.SCALAR)(sizes)


def paragraphs(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")


def grow(text: str, condense, leaf: int = LEAF, limit: int = GROUP, most: int = MOST) -> dict:
    """The tree of one text by a model: condense(content, level) -> summary, key_finding, ideas.

    Returns nodes (id, level, ord, children, content, key_finding, ideas), root last, and how many leaves were
    cut off. Each call sees a group of at most limit characters, so calls grow with the text and not their size.
    """
    texts = leaf_texts(text, leaf)
    row = [{"level": 0, "ord": k, "children": [], "content": t, "key_finding": "", "ideas": []} for k, t in enumerate(texts[:most])]
    nodes = list(row)
    while row and (len(row) > 1 or row[0]["level"] == 0):
        numbers = group_numbers([len(n["content"]) for n in row], limit)
        if len(row) > 1 and numbers[-1] + 1 == len(row):  # else no level would ever shrink
            numbers = [k // 2 for k in range(len(row))]
        level = row[0]["level"] + 1
        groups: list[list[dict]] = [[] for _ in range(numbers[-1] + 1)]
        for n, g in zip(row, numbers, strict=True):
            groups[g].append(n)
        row = []
        for k, group in enumerate(groups):
            told = condense("\n\n".join(n["content"] for n in group), level)
            row.append({"level": level, "ord": k, "children": [n["ord"] for n in group], "content": told["summary"], "key_finding": told["key_finding"], "ideas": told["ideas"]})
        nodes += row
    return {"nodes": nodes, "truncated": max(0, len(texts) - most)}


#: A tree is known by its row's number: rows of one key, or of none, are trees of their own.
KEY = ["paper", "tree"]


def leaf_nodes(docs: DataFrame, key: str, text: str, limit: int = LEAF, separator: str = "\n\n", most: int = MOST) -> DataFrame:
    """(paper, tree, level 0, ord, content) of the first `most` leaves of each text, and how many were cut off.

    tree numbers the rows of docs. Null and blank texts have no leaves.
    """
    cut = docs.select(F.col(key).alias("paper"), F.monotonically_increasing_id().alias("tree"), leaves(F.col(text), limit, separator).alias("_l"))
    return cut.select(*KEY, F.greatest(F.size("_l") - most, F.lit(0)).alias("truncated"), F.posexplode(F.slice("_l", 1, most)).alias("ord", "content")).select(*KEY, F.lit(0).alias("level"), "ord", "content", "truncated")


def grouped(nodes: DataFrame, limit: int = GROUP) -> DataFrame:
    """A row for each tree of nodes of one level: nodes in order, and the number of the group of each.

    A level of a tree has `MOST` leaves at most, so a row has a bounded size. Where every group would
    hold one node and so no level would ever shrink, neighbours are paired.
    """
    rest = [c for c in nodes.columns if c not in (*KEY, "ord")]
    packs = nodes.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("ord", *rest))).alias("nodes"))
    packs = packs.withColumn("groups", packed(F.transform("nodes", lambda n: F.length(n["content"]).cast("long")), limit))
    stuck = (F.size("nodes") > 1) & (F.array_max("groups") + 1 == F.size("nodes"))
    return packs.withColumn("groups", F.when(stuck, F.transform("groups", lambda g: (g / 2).cast("int"))).otherwise(F.col("groups")))


def placed(level: DataFrame) -> DataFrame:
    """The nodes of a grouped level, each with its parent's ordinal."""
    return level.select(*KEY, F.explode(F.zip_with("nodes", "groups", lambda n, g: n.withField("parent", g))).alias("n")).select(*KEY, "n.*")


def joined(level: DataFrame) -> DataFrame:
    """The groups of a grouped level: (paper, tree, level, ord, text, children, first, last); last: it is the tree's only one."""
    start = lambda g: F.array_position("groups", g).cast("int")
    size = lambda g: F.when(g == F.array_max("groups"), F.size("nodes") + 1).otherwise(start(g + 1)) - start(g)
    parts = F.transform(F.sequence(F.lit(0), F.array_max("groups")), lambda g: F.struct(g.alias("ord"), F.slice("nodes", start(g), size(g)).alias("of")))
    rows = level.select(*KEY, F.explode(parts).alias("p"), (F.array_max("groups") == 0).alias("last"))
    return rows.select(*KEY, (F.col("p.of")[0]["level"] + 1).alias("level"), "p.ord", F.array_join("p.of.content", "\n\n").alias("text"), F.size("p.of").alias("children"), F.col("p.of")[0]["first"].alias("first"), "last")


def offline(groups: DataFrame) -> DataFrame:
    """content, key_finding and idea of each group's text by the deterministic model."""
    summary, finding = mock_summary(F.col("text"))
    return groups.withColumns({"content": summary, "key_finding": finding, "idea": mock_idea_sentence(F.col("text"))}).drop("text")


def by_model(make, replies: Replies):
    """condense for build: content, key_finding and ideas as a model tells them.

    make() gives the model in a task. What was told before is taken from the table of replies; a level
    of which calls failed keeps the others' replies and raises, so that a new run asks the rest only.
    """
    system, schema = TASKS["condense"]

    def condense(groups: DataFrame) -> DataFrame:
        user = F.concat(F.when(F.col("level") == 1, "Paragraphs").otherwise("Summaries of its parts"), F.lit(":\n\n"), "text")
        told = replies.ask(groups.withColumn("_user", user), "_user", lambda u: column_of(make, system, u, schema), system).withColumn("_r", F.from_json("reply", SUMMARY_REPLY))
        said = lambda c: strip(F.coalesce(f"_r.{c}", F.lit("")))
        return told.withColumns({"content": said("summary"), "key_finding": said("key_finding"), "ideas": normalised_reply(F.col("_r.ideas"))}).drop("text", "_user", "_r", "reply")

    return condense


def build(leaf: DataFrame, limit: int = GROUP, write=None, condense=offline) -> DataFrame:
    """All nodes of all trees: (paper, tree, level, ord, parent, content, key_finding, children, first, truncated) and what condense adds.

    condense takes groups (see joined) and gives content and key_finding for text. write(df, name)
    cuts lineage between levels (a table in the shared folder); a single leaf still gets one level
    above it. The leaf's own content is its text; first is the ordinal of a node's first leaf.
    A level is one shuffle, of the trees that still have several nodes.
    """
    write = write or (lambda df, name: df.persist())
    now = leaf.select(*KEY, "level", "ord", "content", "truncated", F.col("ord").alias("first"))
    parts: list[DataFrame] = []
    while not parts or not now.isEmpty():
        level = write(grouped(now, limit), f"level{len(parts)}")
        up = write(condense(joined(level)), f"above{len(parts)}")
        parts += [placed(level), up.where("last").drop("last")]
        now = up.where("NOT last").drop("last")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumns({"children": F.coalesce("children", F.lit(0)), "truncated": F.coalesce("truncated", F.lit(0))})


def structure_edges(nodes: DataFrame) -> DataFrame:
    """part_of edges from each child's idea to its parent's first idea, unless the parent has the same one.

    nodes: tree, level, ord, parent, slugs (array).
    """
    up = nodes.select("tree", (F.col("level") - 1).alias("level"), F.col("ord").alias("parent"), F.col("slugs").alias("above"))
    pairs = nodes.where("level > 0").join(up, ["tree", "level", "parent"]).where(F.size("above") > 0)
    child = pairs.select("above", F.explode("slugs").alias("source"))
    return child.where(~F.array_contains("above", F.col("source"))).select("source", F.element_at("above", 1).alias("target"), F.lit("part_of").alias("relation")).distinct()


def totals(nodes: DataFrame) -> DataFrame:
    """Per tree: nodes, leaves, depth, ideas, paragraphs cut off, the key finding of the last built node that has one."""
    built = F.struct("level", "ord")
    ideas = F.coalesce(F.sum(F.size("ideas")), F.lit(0)) if "ideas" in nodes.columns else F.count("idea")
    return nodes.groupBy(*KEY).agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("level") == 0).alias("n_leaves"), F.max("level").cast("long").alias("depth"),
        ideas.alias("n_ideas"), F.max("truncated").cast("long").alias("truncated"),
        F.max_by(F.nullif("key_finding", F.lit("")), F.when(F.coalesce(F.col("key_finding"), F.lit("")) != "", built)).alias("key_finding"),
    )


def outline(nodes: DataFrame) -> DataFrame:
    """Nodes with their pre-order rank in their tree.

    Groups are consecutive, so a node comes before all that begin at a later leaf, and before those below it.
    """
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("first", F.desc("level"))))


EXCERPT = 110


def outline_text(nodes: DataFrame) -> DataFrame:
    """(paper, tree, text): the tree as an indented list, root first; of leaves the first `EXCERPT` characters.

    nodes may have ideas, an array of (slug, statement): a line each below their node.
    A tree has some hundreds of nodes at most, so its list is gathered in one row.
    """
    ideas = F.col("ideas") if "ideas" in nodes.columns else F.array().cast("array<struct<slug:string,statement:string>>")
    pad = F.repeat(F.lit("  "), F.max("level").over(Window.partitionBy(*KEY)) - F.col("level"))
    own = F.when(F.col("level") == 0, F.concat(F.lit("“"), F.translate(F.substring("content", 1, EXCERPT), "\n", " "), F.lit("…”"))).otherwise(F.concat(F.lit("["), F.col("level").cast("string"), F.lit("."), F.col("ord").cast("string"), F.lit("] "), F.col("content")))
    below = F.transform(F.coalesce(ideas, F.array()), lambda i: F.concat(F.lit("  - 💡 ["), i["statement"], F.lit("]("), i["slug"], F.lit(")")))
    lines = outline(nodes).select(*KEY, "rank", pad.alias("_p"), F.concat(F.array(F.concat(F.lit("- "), own)), below).alias("_l"))
    lines = lines.withColumn("line", F.array_join(F.transform("_l", lambda x: F.concat("_p", x)), "\n"))
    whole = lines.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("_t"))
    return whole.select(*KEY, F.array_join("_t.line", "\n").alias("text"))
