import math

import numpy as np

from loomgraph.llm import embedding_dedup
from loomgraph.llm.embedding_dedup import CoverTree, dual_links, near_vectors


def brute(rows, threshold=0.98):
    n = len(rows)
    def good(r):
        return r[2] is not None and r[1] and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])
    links, root = [0] * n, list(range(n))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {(rows[i][0], links[i], min(groups[find(i)])) for i in range(n)}


def cloud(seed, n, dim=6):
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, dim))
    x = base[r.integers(0, 12, n)] + r.normal(size=(n, dim)) * r.choice([0, 0.01, 0.1, 0.4], n)[:, None]
    return (x * r.choice([0.5, 1, 3], n)[:, None]).astype(np.float32)


def test_links_match_brute_force(spark):
    x = cloud(1, 300)
    rows = [(i, x[i].tolist(), int(i % 3)) for i in range(300)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 6, 1), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (904, [float("nan")] * 6, 1), (905, [float("inf")] + [1.0] * 5, 1), (906, rows[0][1], None), (907, rows[0][1][:3], 0), (908, rows[0][1][:3], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for block in (2048, 20):
        got = near_vectors(df, block=block).collect()
        assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == brute(rows)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert near_vectors(df.limit(0)).count() == 0


def test_cover_tree_invariants():
    x = cloud(2, 200).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(200))
    for c, radius, a, b, kids in tree.nodes:
        inside = tree.order[a:b]
        assert c in inside
        assert np.sqrt(np.maximum(0, 2 - 2 * x[inside] @ x[c])).max() <= radius + 1e-9
        if kids:
            assert sorted((tree.nodes[k][2], tree.nodes[k][3]) for k in kids)[0][0] == a
            assert sum(tree.nodes[k][3] - tree.nodes[k][2] for k in kids) == b - a


def test_bulk_counts_equal_pair_counts():
    r = np.random.default_rng(3)
    x = np.concatenate([np.ones((80, 5)) + r.normal(size=(80, 5)) * 0.01, r.normal(size=(40, 5))])
    w = r.integers(1, 4, len(x))
    for split in (0, 50):
        gain, _ = dual_links(x, w, split, 0.98)
        u = x / np.linalg.norm(x, axis=1)[:, None]
        link = u @ u.T >= 0.98
        np.fill_diagonal(link, False)
        if split:
            link[:split, :split] = False
            link[split:, split:] = False
        assert (gain == link @ w).all()


def test_radii_hold_however_products_are_rounded(monkeypatch):
    far, calls = embedding_dedup._far, []

    def other(x, c):
        calls.append(len(x))
        assert len(calls) < 2000, "the tree does not end"
        d = far(x, c)
        return np.where(d < 5e-8, np.where(np.arange(len(x)) == 0, 2e-8, 0.0), d)  # the first row by another path

    monkeypatch.setattr(embedding_dedup, "_far", other)
    x = cloud(2, 200).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = CoverTree(np.concatenate([x, x[:1], x[:1]]))
    for c, radius, a, b, _ in tree.nodes:
        for p in tree.order[a:b]:
            assert math.sqrt(max(0.0, 2 - 2 * math.fsum(tree.x[p] * tree.x[c]))) <= radius


def test_labels_of_any_type(spark):
    rows = [(k, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(12)]
    for kind, label in (("string", lambda k: "ab"[k % 3 == 0]), ("bigint", lambda k: (1 << 40) + (k % 3 == 0)), ("double", lambda k: 0.5 + (k % 3 == 0))):
        v = spark.createDataFrame([(k, e, label(k)) for k, e in rows] + [(99, [1.0, 0.0], None)], f"vec_id long, embedding array<float>, label {kind}")
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(v).collect()}
        for k, e in rows:
            same = [j for j, f in rows if f == e and label(j) == label(k)]
            assert got[k] == (len(same) - 1, min(same))
        assert got[99] == (0, 99)
