"""Leaves and trees against plain definitions, for the queries over a whole table."""

import hashlib
import random
import re

import pytest

from loomgraph.functions.text import WS
from loomgraph.models import OfflineModel
from loomgraph.operators import tree as Tr
from loomgraph.plans import catalog

SF = "/root/testdata/sf0.001"


def plain_leaves(text, limit, separator):
    """Character by character what the rules say: [(leaf, may take more)]."""
    leaves = []
    for par in text.split(separator):
        par = par.strip(WS)
        if len(par) > limit and leaves:
            leaves[-1] = (leaves[-1][0], False)
        while len(par) > limit:
            at = limit
            for k in range(limit - 1, limit // 2, -1):
                if par[k] == " ":
                    at = k
                    break
            leaves.append((par[:at].strip(WS), False))
            par = par[at:].strip(WS)
        if par and leaves and leaves[-1][1] and len(leaves[-1][0]) + 2 + len(par) <= limit:
            leaves[-1] = (leaves[-1][0] + "\n\n" + par, True)
        elif par:
            leaves.append((par, True))
    return [leaf for leaf, _ in leaves]


def test_leaves_equal_the_plain_rules():
    assert [len(x) for x in Tr.leaf_texts("a" * 100 + "\n\n" + " ".join(["b" * 200] * 9), 1200)] == [100, 1004, 803]
    r = random.Random(4)
    for _ in range(400):
        text = "".join(r.choice(["word ", "x" * 30, "\n\n", " ", "\t\n", "é"]) for _ in range(r.randrange(80)))
        limit = r.choice([10, 40, 100])
        assert Tr.leaf_texts(text, limit) == plain_leaves(text, limit, "\n\n")


def said(text):
    """(summary, finding, idea) of the deterministic model."""
    body = re.sub(r"(?m)^(Content \([^)]*\):|Title:.*|Journal:.*|MeSH terms:.*|Abstract:)[ \t\n\r\f]*", "", text).strip(WS)
    parts = [p for x in re.split(r"(?<=[.!?])[ \t\n\r\f]+", body) if (p := x.strip(WS))]
    return " ".join(parts[:2])[:400] or body[:400], parts[0][:200] if parts else "", next((p for p in parts if len(p) >= 50), None)


def plain_tree(text):
    """{(level, ord): (content, parent, finding, idea, children)} and how many leaves were cut off."""
    leaves = plain_leaves(text, Tr.LEAF, "\n")
    row = [(t, None, None, 0) for t in leaves[: Tr.MOST]]
    levels = []
    while row:
        if len(row) == 1 and levels:
            levels.append((row, [None]))
            break
        groups = []
        size = 0
        for content, *_ in row:
            if groups and size + len(content) <= Tr.GROUP:
                groups[-1] += 1
                size += len(content) + 2
            else:
                groups.append(1)
                size = len(content) + 2
        if len(groups) == len(row) > 1:
            groups = [2] * (len(row) // 2) + [1] * (len(row) % 2)
        parents = [k for k, n in enumerate(groups) for _ in range(n)]
        levels.append((row, parents))
        up = []
        for k, n in enumerate(groups):
            whole = "\n\n".join(c for (c, *_), p in zip(row, parents) if p == k)
            up.append((*said(whole)[:1], *said(whole)[1:], n))
        row = up
    nodes = {(lv, k): (c, p, f, i, n) for lv, (rows, parents) in enumerate(levels) for k, ((c, f, i, n), p) in enumerate(zip(rows, parents))}
    return nodes, max(0, len(leaves) - Tr.MOST)


@pytest.fixture(scope="module")
def trees(spark):
    return {r["doc_id"]: plain_tree(r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_leaf_split(spark, trees):
    got = {(r["paper"], r["ord"]): (r["size"], r["digest"], r["truncated"]) for r in catalog.QUERIES["leaf_split"](spark, SF).collect()}
    assert got == {(d, k): (len(v[0]), md5(v[0]), cut) for d, (nodes, cut) in trees.items() for (lv, k), v in nodes.items() if lv == 0}


def test_tree_levels_and_totals(spark, trees):
    got = {(r["paper"], r["level"], r["ord"]): (r["digest"], r["parent"], r["children"]) for r in catalog.QUERIES["tree_levels"](spark, SF).collect()}
    assert got == {(d, *at): (md5(v[0]), v[1], v[4]) for d, (nodes, _) in trees.items() for at, v in nodes.items()}
    got = {r["paper"]: (r["n_nodes"], r["n_leaves"], r["depth"], r["n_ideas"], r["truncated"], r["key_finding"]) for r in catalog.QUERIES["tree_totals"](spark, SF).collect()}
    want = {}
    for d, (nodes, cut) in trees.items():
        if nodes:
            findings = [nodes[at][2] for at in sorted(nodes) if nodes[at][2]]
            want[d] = (len(nodes), sum(lv == 0 for lv, _ in nodes), max(nodes)[0], sum(v[3] is not None for v in nodes.values()), cut, findings[-1] if findings else None)
    assert got == want


def test_outlines_and_structure(spark, trees):
    order, edges = {}, set()

    def slug(idea):
        words = [w for w in re.sub(r"[^a-z0-9 ]", "", idea.lower()).split(" ") if w][:6]
        return "-".join(words or ["idea"]) + "-" + hashlib.sha1(idea.encode()).hexdigest()[:6]

    for d, (nodes, _) in trees.items():
        def walk(at, d=d, nodes=nodes):
            order[d, *at] = 1 + sum(k[0] == d for k in order)
            for below in sorted(k for k, v in nodes.items() if k[0] == at[0] - 1 and v[1] == at[1]):
                mine, above = nodes[below][3], nodes[at][3]
                if below[0] > 0 and mine and above and mine != above:
                    edges.add((slug(mine), slug(above), "part_of"))
                walk(below)

        if nodes:
            walk(max(nodes))
    got = {(r["paper"], r["level"], r["ord"]): r["rank"] for r in catalog.QUERIES["tree_outline"](spark, SF).collect()}
    assert got == order
    assert {(r["source"], r["target"], r["relation"]) for r in catalog.QUERIES["structure_edges"](spark, SF).collect()} == edges
    texts = {}
    for d, level, k in order:  # root first
        nodes = trees[d][0]
        content, idea = nodes[level, k][0], nodes[level, k][3]
        pad = "  " * (max(nodes)[0] - level)
        texts.setdefault(d, []).append(pad + ("- “" + content[:110].replace("\n", " ") + "…”" if level == 0 else f"- [{level}.{k}] {content}"))
        if idea:
            texts[d].append(f"{pad}  - 💡 [{idea}]({slug(idea)})")
    got = {r["paper"]: r["digest"] for r in catalog.QUERIES["tree_outline_text"](spark, SF).collect()}
    assert got == {d: md5("\n".join(lines)) for d, lines in texts.items()}


def test_grown_tree_has_the_same_shape(trees, spark):
    model = OfflineModel()
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 3000").limit(5).collect():
        grown = Tr.grow(r["text"].replace("\n", "\n\n"), model.condense)
        nodes, cut = trees[r["doc_id"]]
        assert {(n["level"], n["ord"]): len(n["children"]) for n in grown["nodes"]} == {at: v[4] for at, v in nodes.items()} and grown["truncated"] == cut


def test_frontier_replay(spark):
    got = {(r["run"], r["step"]): (r["id"], r["score"]) for r in catalog.QUERIES["frontier_replay"](spark, SF).collect()}
    want = {}
    rows = sorted(spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", "value").collect())
    for run in {r["user_id"] for r in rows}:
        waiting, ever, counted, n = [], set(), set(), 0
        for r in rows:
            if r["user_id"] == run:
                if r["event_type"] not in ever:
                    ever.add(r["event_type"])
                    novelty = 1.0 if not counted or r["event_type"] not in counted else 0.0
                    waiting.append((-round(0.55 * r["value"] + novelty, 4), len(ever), r["event_type"]))
                n += 1
                if n % 3 == 0 and waiting:
                    best = min(waiting)
                    waiting.remove(best)
                    counted.add(best[2])
                    want[str(run), n] = best[2], -best[0]
    assert got == want
