import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate as D

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    """For each text: words, hit places, ids of items; the longest run shared with an item, if a window."""
    out = []
    tests = [(("" if i is None else str(i)), words(t)) for i, t in items]
    for _, text in docs:
        w, hit, ids, longest = words(text), set(), set(), 0
        for item, t in tests:
            k = min(window, len(t))
            for a in range(len(t) - k + 1) if t else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == t[a : a + k]:
                        hit |= set(range(p, p + k))
                        ids.add(item)
                        n = k
                        while p + n < len(w) and a + n < len(t) and w[p + n] == t[a + n]:
                            n += 1
                        longest = max(longest, n)
        out.append((len(w), sorted(hit), sorted(ids), longest))
    return out


def check(spark, docs, items, told=True, **options):
    d = spark.createDataFrame([(i, t, str(i)) for i, t in docs], "doc_id long, text string, item string")
    found = D.find_leaks(d.select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    brutes = brute(docs, items, options.get("window", 10))
    if not told:  # parts of a text end the longest match
        found, brutes = [r.asDict() | {"longest": 0} for r in found], [(*b[:3], 0) for b in brutes]
    got = sorted((r["n_words"], [q for s in r["spans"] for q in range(s["start"], s["end"])], list(r["items"]), r["longest"]) for r in found)
    assert got == sorted(brutes)


def corpus(seed, n=40):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "cé", "dd", "9", "Éa"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(k))
    items = [(k % 7, text(rng.choice([1, 3, 10, 14, 30]))) for k in range(12)] + [(None, text(12)), (50, None), (51, "--"), (7, "")]
    docs = [(k, text(rng.randint(0, 60)) + (rng.choice(items)[1] or "") + text(rng.randint(0, 20))) for k in range(n)]
    return docs + [(None, None), (3, ""), (3, "-"), (3, docs[0][1])], items


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    check(spark, *corpus(seed))


def test_blocks_of_items_and_cut_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 64)
    docs, items = corpus(5, 12)
    docs[0] = (0, docs[0][1] * 9)
    check(spark, docs, items, told=False, block=16)
    data = np.frombuffer((docs[0][1] * 9).encode(), np.uint8)
    whole = D.word_hashes(data, np.array([0, len(data)]), D.LETTERS)[0]
    for overlap in (0, 9):
        got = np.zeros(len(whole), np.uint64)
        for _, _, h, _, base in D.texts_in_shards(data, np.array([0, len(data)]), overlap, 16):
            got[base : base + len(h)] = h
        assert (got == whole).all()


def test_long_text_is_searched_in_parts():
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 5, 3000).astype(np.uint64)
    test = D.Suffixes([("x", hashes[100:140].tobytes()), ("y", hashes[2000:2012].tobytes())])
    whole, parts = D.Finds(1), D.Finds(1)
    whole.shard(test, 0, 1, hashes, np.zeros(3000, np.int64), 0)
    for at in range(0, 3000, 500):
        base = max(0, at - test.longest + 1)
        part = hashes[base : at + 500]
        parts.shard(test, 0, 1, part, np.zeros(len(part), np.int64), base)
    assert parts.n_words[0] == whole.n_words[0] == 3000 and parts.kinds == whole.kinds and parts.longest == whole.longest
    assert D.joined(parts.spans[0]) == D.joined(whole.spans[0])


def test_pieces_of_long_items(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 7)
    monkeypatch.setattr(D, "SHARD_BYTES", 32)
    text = " ".join(str(k % 11) for k in range(60))
    found = D.item_pieces(spark.createDataFrame([(1, text), (2, "a"), (3, None)], "item_id long, text string")).collect()
    starts = {tuple(np.frombuffer(r["words"], np.uint64)[k : k + 10]) for r in found if r["item"] == "1" for k in range(len(r["words"]) // 8 - 9)}
    h = D.word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), D.LETTERS)[0]
    assert starts == {tuple(h[k : k + 10]) for k in range(51)}
    assert sum(r["item"] == "2" for r in found) == 1 and not any(r["item"] == "3" for r in found)


def test_removal_keeps_columns_and_clean_rows(spark):
    docs, items = corpus(7, 20)
    d = spark.createDataFrame([(i, t, "s", "u") for i, t in docs], "n_words long, text string, items string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = D.decontaminate(d, bench)
    want = [(i, t) for (i, t), b in zip(docs, brute(docs, items), strict=True) if not b[1]]
    assert left.columns == d.columns and sorted(map(str, ((r[0], r[1]) for r in left.collect()))) == sorted(map(str, want))
    assert D.decontaminate(d, bench.limit(0)).count() == len(docs)
    assert D.decontaminate(d.limit(0), bench).count() == 0


def test_query_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = D.op13_decontamination(spark, SF)
    want = c.execute(D.ORACLE)
    assert [x[0] for x in want.description] == got.columns
    rows = want.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows) and any(r[5] for r in rows)
    assert rows[0][4] and all(r[4] == hashlib.sha256(b"").hexdigest() for r in rows if not r[5])


def test_shared_passage_in_every_text(spark):
    passage = " ".join(f"w{k}" for k in range(25))
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("x y "), F.lit(passage), F.lit(" z")).alias("text"))
    got = D.find_leaks(docs, spark.createDataFrame([(k, passage) for k in range(30)], "item_id long, text string")).collect()
    assert len(got) == 600 and all([tuple(s) for s in r["spans"]] == [(2, 27)] and len(r["items"]) == 30 and r["longest"] == 25 for r in got)
