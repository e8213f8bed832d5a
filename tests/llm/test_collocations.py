import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest

from loomgraph.llm import collocations as C

SF = "/root/testdata/sf0.01"


def brute(rows, longest=3, support=10, share=50, top=2000):
    f = Counter()
    n = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {}
    candidates = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= support}
    for (lang, p), a in candidates.items():
        best = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(g == lang and len(q) > len(p) and 100 * c >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), c in candidates.items())
        if not inside:
            found.setdefault(lang, []).append((-best[0], -a, " ".join(p).encode(), f[lang, p[: best[1]]], f[lang, p[best[1] :]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in found.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "É", "x\x00y", "a-b", "œ", "new", "york"]
    ends = [" ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b", "\x0d\n"]
    rows = [(rng.choice(["de", "en", "ed", None, ""]), "".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randint(0, 50)))) for _ in range(60)]
    return rows + [("en", None), ("en", ""), (None, None), ("en", " ,. "), ("en", "New York City " * 40), ("de", "new york city, " * 40)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = texts(seed)
    docs = spark.createDataFrame([(k, l, t, 1) for k, (l, t) in enumerate(rows)], "doc_id long, lang string, text string, f int").repartition(5)
    for options in ({}, {"longest": 4, "support": 5, "share": 90, "top": 20}):
        assert sorted(map(tuple, C.collocations(docs, **options).collect())) == brute(rows, **options)


def test_full_bitmaps_and_shared_hashes_only_add_work(spark, monkeypatch):
    rows = texts(9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(C, "BUCKETS", (64, 64))
    monkeypatch.setattr(C, "HELD", 7)
    monkeypatch.setattr(C, "SLICE", 8)
    monkeypatch.setattr(C, "CHUNK", 300)
    monkeypatch.setattr(C, "FEW", 0)
    assert sorted(map(tuple, C.collocations(docs).collect())) == brute(rows)


def test_phrases_that_share_a_hash_are_rows_of_their_own():
    text = b"a b a c a b"
    words = C.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.zeros(1, np.int64), np.zeros(1, np.uint64))
    first = words.phrases(2)
    gathered = C.Gathered(2, 3)
    got = [*gathered.add(words, first, np.zeros(len(first), np.uint64), ["en"]), *gathered.add(words, first, np.zeros(len(first), np.uint64), ["en"]), *gathered.rows()]
    total = Counter()
    for p, f in (x for b in got for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
        total[p] += f
    assert total == {b"a b": 4, b"b a": 2, b"a c": 2, b"c a": 2}


def test_half_bytes_count_as_bytes_do():
    rng = np.random.default_rng(5)
    for support in (1, 10, 15, 16, 127):
        tally, want = C.Tally(64, support), np.zeros(64, np.int64)
        assert len(tally.data) == (32 if support < 16 else 64)
        for _ in range(9):
            bucket = rng.permutation(50)[:30]
            times = rng.integers(1, 4, 30)
            tally.add(bucket, times)
            want[bucket] = np.minimum(want[bucket] + times, support)
        tally.add(np.array([3]), np.array([1_000]))
        want[3] = support
        got = np.zeros(64, np.uint8)
        for k, data in tally.slices(8):
            got[8 * k : 8 * k + 8] = np.frombuffer(C.pa.decompress(data, 8, "zstd", asbytes=True), np.uint8)
        assert got.tolist() == want.tolist()


def test_a_task_holds_little(monkeypatch):
    """What a task of a pass takes at once, over its tally and the phrases that it holds."""
    held = 1 << 16
    text = " ".join(f"w{k % 90_000:05d}" for k in range(400_000)).encode()
    seen = Counter()
    tracemalloc.start()
    tally, gathered = C.Tally(1 << 22, 10), C.Gathered(2, held)
    for at in range(0, len(text), C.CHUNK):
        part = np.frombuffer(text[at : at + C.CHUNK], np.uint8)
        words = C.Words(part, np.array([0, len(part)]), np.zeros(1, np.int64), np.zeros(1, np.uint64))
        first = words.phrases(2)
        key = words.key(words.h, first, 2)
        tally.add(*np.unique((key & np.uint64((1 << 22) - 1)).view(np.int64), return_counts=True))
        for b in gathered.add(words, first, key, ["en"]):
            assert b.num_rows <= C.AT_ONCE
            seen["f"] += sum(b.column(2).to_pylist())
        seen["n"] += len(first)
    seen["f"] += sum(sum(b.column(2).to_pylist()) for b in gathered.rows())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen["f"] == seen["n"] and peak < 80 << 20


def test_score_is_exact_beyond_64_bits(spark):
    a, x, y = 3_000_000_019, 3_000_000_021, 3_000_000_037
    assert spark.range(1).selectExpr(f"(1000000 * cast({a} as decimal(38,0)) * cast({a} as decimal(38,0))) div (cast({x} as decimal(38,0)) * cast({y} as decimal(38,0)))").first()[0] == 10**6 * a * a // (x * y)


def test_empty_and_rare(spark):
    docs = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    assert C.collocations(docs).count() == 0 and C.collocations(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.collocations(docs, support=128)


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.execute(C.ORACLE)
    got = C.op12_collocations(spark, SF)
    assert [x[0] for x in want.description] == got.columns
    rows = sorted(want.fetchall())
    assert sorted(map(tuple, got.collect())) == rows and rows
