"""Canonicalisation by components and ranges equals one fold over all ideas."""

import random
import zlib

import pytest

from loomgraph.operators import edges as E
from loomgraph.operators import ideas as I
from loomgraph.plans.tables import scratch


def model():
    """Any rule that follows from what is shown alone."""

    def decide(idea, ranked):
        h = zlib.crc32(repr((sorted(idea.items()), [(c, round(s, 6)) for c, s, _ in ranked])).encode())
        c = ranked[h % len(ranked)][0]
        return [{"decision": "merge", "target": c}, {"decision": "link", "target": c, "relation": "causes"}, {"decision": "new"}, {"decision": "merge", "target": -5}, {"decision": "link", "target": c, "relation": "odd"}][h // 7 % 5]

    return decide


def folded(rows, pairs, merge, k):
    decide = model()
    near = {}
    for i, c, s in pairs:
        near.setdefault(i, []).append((c, s))
    of, made, out = {r[1]: r for r in rows}, set(), set()
    for vault, i, statement, level in sorted(rows, key=lambda r: r[1]):
        ranked = sorted(((c, s) for c, s in near.get(i, []) if c in made), key=lambda c: (-c[1], c[0]))[:k]
        told = decide({"id": i, "statement": statement, "level": level}, [(c, s, {"statement": of[c][2], "level": of[c][3]}) for c, s in ranked]) if ranked else {}
        scores = dict(ranked)
        decision, target = told.get("decision", "new"), told.get("target")
        if decision != "new" and target not in scores:
            decision = "new"
        if decision == "merge" and scores[target] < merge:
            decision = "link"
        if decision != "merge":
            made.add(i)
        relation = told.get("relation", "related_to")
        out.add((vault, i, decision, target if decision != "new" else None, (relation if relation == "causes" else "related_to") if decision == "link" else None))
    return out


@pytest.mark.parametrize(("seed", "group"), [(0, 14), (1, 22), (2, 1000)])
def test_equals_one_fold(spark, seed, group):
    rng = random.Random(seed)
    ids = rng.sample(range(-50, 500), 60)
    rows = [("ab"[i % 2], i, f"s{i % 9}", i % 3) for i in ids]
    pairs = [(i, c, rng.choice([0.65, 0.7, 0.85, 0.9])) for i in ids for c in ids if c < i and (i - c) % 2 == 0 and rng.random() < 0.06]
    pairs += [(i, c, 0.9) for i in ids for c in ids if c < i and i % 8 == c % 8 == 3]  # all near one another
    near = list({(i, c): (i, c, s) for i, c, s in pairs}.values())
    lists = {}
    for i, c, s in sorted(near, key=lambda p: (p[0], -p[2], p[1])):
        lists.setdefault(i, []).append((i, c, s))
    r = spark.createDataFrame(rows, "vault string, id long, statement string, level int")
    listed = lambda depth: spark.createDataFrame([(*p, k == depth - 1) for v in lists.values() for k, p in enumerate(v[:depth])], "id long, candidate long, score double, cut boolean")
    whole = {tuple(x) for x in I.fold_components(r, listed(99), model(), 0.8, 3, group).drop("short").collect()}
    assert whole == folded(rows, near, 0.8, 3)
    cut = I.fold_components(r, listed(4), model(), 0.8, 3, group).collect()
    first = min((x["id"] for x in cut if x["short"]), default=10**9)
    assert {tuple(x)[:5] for x in cut if x["id"] < first} == {x for x in whole if x[1] < first}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["root"] for r in E.components(spark.createDataFrame(pairs, "a long, b long"), scratch(spark)).collect()}
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_empty(spark):
    r = spark.createDataFrame([], "vault string, id long, statement string, level int")
    assert I.fold_decisions(r, model()).count() == 0


def test_vaults_do_not_see_each_other(spark):
    s = "The quick brown fox jumps over the lazy dog near the river bank"
    r = spark.createDataFrame([("a", 1, s, 0), ("b", 2, s, 0), ("a", 3, s, 0), (None, 4, s, 0), (None, 5, s, 0)], "vault string, id long, statement string, level int")
    got = {x["id"]: (x["vault"], x["decision"], x["target"]) for x in I.fold_decisions(r, lambda i, ranked: {"decision": "merge", "target": ranked[0][0]}).collect()}
    assert got == {1: ("a", "new", None), 2: ("b", "new", None), 3: ("a", "merge", 1), 4: (None, "new", None), 5: (None, "merge", 4)}


def test_cut_lists_grow_until_they_suffice(spark):
    words = "the quick brown fox jumps over the lazy dog near the river bank today".split()
    rows = [("v", k, " ".join([*words, *["more"] * (k % 5), "x" * (k + 1)]), k % 2) for k in range(30)] + [("v", 100, " ".join(words).upper() + " X", 0)]
    r = spark.createDataFrame(rows, "vault string, id long, statement string, level int")
    merging = lambda i, ranked: {"decision": "merge", "target": ranked[-1][0]} if i["id"] > 9 else {"decision": "new"}
    few = {tuple(x) for x in I.fold_decisions(r, merging, k=2).collect()}
    vectors = {x["id"]: x["vec"] for x in I.embedded(r).collect()}
    made = []
    for _, i, _, _ in rows[:-1]:
        cos = lambda c: round(sum(a * b for a, b in zip(vectors[i], vectors[c], strict=True)), 6)
        ranked = sorted((c for c in made if cos(c) >= I.LINK), key=lambda c: (-cos(c), c))[:2]
        merged = i > 9 and ranked and cos(ranked[-1]) >= I.MERGE
        assert ("v", i, "merge", ranked[-1], None) in few if merged else any(x[1] == i and x[2] != "merge" for x in few)
        made += [] if merged else [i]
    assert ("v", 100, "merge", 0, None) in few
