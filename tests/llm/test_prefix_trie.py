import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from loomgraph.llm import prefix_trie as P

SF = "/root/testdata/sf0.01"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        full[c] = tuple(turns.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    children, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for way in members:
        if way:
            children[way[:-1]] += 1
    for way, m in members.items():
        for d in range(len(way) + 1):
            below[way[:d]][0] += children[way] == 0
            below[way[:d]][1] += (len(m) - 1) * len(way[-1][1]) if way else 0
    sha = lambda way: hashlib.sha256(",".join(str(c) for c in members[way] if full[c] == way).encode()).hexdigest()
    return sorted((m[0], len(w), members[w[:-1]][0] if w else -1, len(m), children[w], *below[w], sha(w)) for w, m in members.items())


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, h string, family int").repartition(parts)
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, P.conversation_trie(df).collect()))


def some(seed, ids, most=9):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, None]) if t else 0, rng.choice(["user", "user", None]), rng.choice(["a", "bé", "", None, "ccc"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = [rng.randrange(-250, 1200) for _ in range(150)] + [0, 100, 700, 10**12 + 7]
    rows = some(seed, sorted(set(ids)))
    assert found(spark, rows) == brute(rows)


def test_copies_long_conversations_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "SLAB", 8)
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(3)]
    rows += [(401, t // 3, "r", "x" * (t % 5)) for t in range(900)] + [(400, t, "r", "x") for t in range(40)] + [(402, t // 3, "r", "x" * (t % 5)) for t in range(450)]
    rows += [(None, 1, "user", "x")] * 5 + [(500, 1, "user", "y")] * 30
    assert found(spark, rows, 7) == brute(rows)


def test_absent_bases_and_turnless(spark):
    rows = [(c, 0, "user", "q") for c in range(901, 930)]
    got = found(spark, rows)
    assert got == brute(rows) and got[0][:3] == (901, 0, -1)


def test_empty(spark):
    assert found(spark, []) == []


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = c.execute(P.ORACLE)
    got = P.op11_prefix_trie(spark, SF)
    assert [x[0] for x in want.description] == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
