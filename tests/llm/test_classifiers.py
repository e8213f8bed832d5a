import math
import random
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import langid as L
from loomgraph.llm import toxicity as X
from loomgraph.llm import url_filter as U

SF = "/root/testdata/sf0.01"


def distribution(counts, context, k, symbols):
    """P(symbol | context) as trees define it, recursively."""
    lower = distribution(counts, context[1:], k - 1, symbols) if k else {s: 1 / len(symbols) for s in symbols}
    seen = counts[k].get(context, {})
    if not seen:
        return lower
    n, kinds = sum(seen.values()), len(seen)
    rest = sum(lower[s] for s in symbols if s not in seen)
    if rest <= 0:
        return {s: seen.get(s, 0) / n for s in symbols}
    return {s: seen[s] / (n + kinds) if s in seen else kinds / (n + kinds) * lower[s] / rest for s in symbols}


def test_code_lengths_by_definition(spark):
    r = random.Random(1)
    texts = [("a", "".join(r.choice("abcA ") for _ in range(80))) for _ in range(5)] + [("b", "".join(r.choice("bcdé") for _ in range(60))) for _ in range(5)]
    docs = spark.createDataFrame(texts, "lang string, text string")
    found = L.context_counts(docs, 2).toPandas()
    model = L.Model(["a", "b"], {k: (g["gram"].to_numpy(), g["n"].to_numpy(dtype=float)) for k, g in found.groupby("lang")}, 2)
    folded = {k: [b"  " + bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()) for x, t in texts if x == k] for k in "ab"}
    symbols = sorted({c for ts in folded.values() for t in ts for c in t}) + [256]  # the last: never seen
    for text in ("abca", "ddé", "zzz", " A"):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        got = model.bits(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]
        for i, lang in enumerate("ab"):
            counts = [{}, {}, {}]
            for t in folded[lang]:
                for j in range(2, len(t)):
                    for k in range(3):
                        counts[k].setdefault(tuple(t[j - k : j]), {}).setdefault(t[j], 0)
                        counts[k][tuple(t[j - k : j])][t[j]] += 1
            coded = [32, 32] + [c if c in symbols else 256 for c in raw]
            want = -sum(math.log2(distribution(counts, tuple(coded[j - 2 : j]), 2, symbols)[coded[j]]) for j in range(2, len(coded)))
            assert abs(got[i] - want) < 1e-3


def test_language_held_out(spark):
    out = L.op7_language_id(spark, SF).toPandas()
    truth = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").df()
    both = out.merge(truth, on="doc_id")
    assert len(both) == 1000
    assert ((both["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)) == both["held_out"]).all()
    held = both[both["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "en"), (None, "the dog", None)], "doc_id long, text string, lang string")
    model = L.learn(docs)
    rows = {r["doc_id"]: r for r in L.predict(docs, model, "doc_id").collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 4, 5, None)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert L.predict(docs.limit(0), L.learn(docs.limit(0)), "doc_id").count() == 0
    assert L.predict(docs, L.learn(docs.limit(0)), "doc_id").where("lang_pred <> 'und'").count() == 0


def test_long_texts_have_the_code_length_of_the_whole():
    rng = np.random.default_rng(3)
    keys, counts = np.unique(rng.integers(97, 105, 4000) * 256**3 + rng.integers(97, 105, 4000) * 65536 + rng.integers(97, 105, 4000) * 256 + rng.integers(97, 105, 4000), return_counts=True)
    model = L.Model(["a", "b"], {"a": (keys, counts.astype(float)), "b": (keys[::2], counts[::2].astype(float))})
    data = rng.integers(97, 106, 3_000_000).astype(np.uint8)
    offsets = np.array([0, len(data)])
    assert np.allclose(model.score(data, offsets), model.bits(data, offsets), rtol=1e-9, atol=1e-6)
    assert np.allclose(model.bits(data[:50], np.array([0, 50]), 3) + model.bits(data[:3], np.array([0, 3])), model.bits(data[:50], np.array([0, 50])))


def test_code_lengths_by_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.learn(docs.where(~L.held_out(F.col("doc_id"), 4, 2)))
    table, states = model.table.reshape(-1, model.size, len(model.langs)), model.states
    for r in L.op7_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "text"), "doc_id").where("doc_id % 20 = 0").collect():
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (r["text"] or "").encode())
        bits = np.zeros(len(model.langs))
        for i in range(len(raw)):
            state = 0
            for c in (b"   " + raw)[i : i + 3]:
                state = state * model.size + int(model.symbol[c])
            bits += table[states[state], model.symbol[raw[i]]]
        score = 1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum()
        assert r["lang_pred"] == (model.langs[int(bits.argmin())] if any(c.isalpha() for c in r["text"] or "") else "und")
        assert abs(r["score"] - (score if r["lang_pred"] != "und" else 0)) < 1e-6


def test_toxicity_of_few_rows(spark):
    docs = spark.createDataFrame([(i, f"you {'zblork' if i % 10 == 3 else 'friend'} number {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 3)) for i in range(60)], "doc_id long, toxic int")
    rows = X.scored(docs, X.learn(docs, labels), "doc_id").collect()
    assert min(r["score"] for r in rows if r["doc_id"] % 10 == 3) > 0.5 > max(r["score"] for r in rows if r["doc_id"] % 10 != 3)
    every = X.learn(docs, labels.withColumn("toxic", F.lit(1)))
    assert X.scored(docs, every, "doc_id").where("score < 0.99 OR predicted <> 1").count() == 0
    shouts = spark.createDataFrame([(i, ("LOUD WORDS! " if i % 3 == 0 else "quiet words ") + "".join(chr(97 + (i * k) % 26) for k in range(1, 9))) for i in range(40)], "doc_id long, text string")
    plain = X.learn(shouts, labels.where("doc_id < 40").withColumn("toxic", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)))
    of = {r["doc_id"]: r["score"] for r in X.scored(shouts, plain, "doc_id").collect()}
    assert min(of[i] for i in range(0, 40, 3)) > max(of[i] for i in range(40) if i % 3)


def test_toxicity_small_tables_tell_held_out_rows(spark):
    out = X.op5_toxicity(spark, "/root/testdata/sf0.001").toPandas()
    truth = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.001/labels.parquet'").df()
    held = out[out["held_out"]].merge(truth, on="doc_id")
    bad, good = held[held["toxic"] == 1]["score"], held[held["toxic"] == 0]["score"]
    assert len(good) and (not len(bad) or np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.6)
    every = out.merge(truth, on="doc_id")
    assert every[every["toxic"] == 1]["score"].mean() > every[every["toxic"] == 0]["score"].mean()


def test_scores_by_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = X.learn(docs, labels)
    weight = dict(zip(model.words.tolist(), model.weights, strict=False))
    for r in X.scored(docs, model, "doc_id", "text").where("doc_id % 10 = 0").collect():
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        h, _, n = X.tokens_of(raw, np.array([0, len(raw)]))
        z = model.bias + sum(weight.get(x, 0.0) for x in set(h.tolist())) + float(X.patterns(raw, np.array([0, len(raw)]), n)[0] @ model.weights[len(model.words) :])
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-6


def test_toxicity_held_out(spark):
    out = X.op5_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    truth = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").df()
    assert len(out) == 10000 and ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()
    assert (out["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0) == out["held_out"]).all()
    held = out[out["held_out"]].merge(truth, on="doc_id")
    assert held[held["toxic"] == 1]["predicted"].mean() > 0.85
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.03


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, f"you total {'zblork' if i % 4 == 0 else 'friend'} number {i} of the many" if i % 9 else None) for i in range(400)] + [(None, "zblork")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in X.scored(docs, X.learn(docs, labels), "doc_id").collect()}
    assert rows[4]["predicted"] == 1 and rows[None]["predicted"] == 1 and rows[5]["predicted"] == 0 and rows[9]["predicted"] == 0
    none = X.learn(docs, labels.where("toxic = 0"))
    assert X.scored(docs, none, "doc_id").where("score <> 0").count() == 0
    assert X.scored(docs.limit(0), X.learn(docs.limit(0), labels), "doc_id").count() == 0


def plain_label_model(kinds, known, truth, share, rounds):
    """Expectation maximisation row by row, as the operator's docstring says."""
    n = len(known[0])

    def rates(hot, said1, cold, said0):
        return [min(max((s + 0.5) / (hot + 1), 1e-5), 1 - 1e-3) for s in said1], [min(max((s + 0.05) / (cold + 1), 1e-6), 1 - 1e-3) for s in said0]

    def post(cells):
        k = max(len(cells), 1)
        shared = 1 + sum(together[i][j] for i in cells for j in cells) / k
        z = sum(math.log(p1[i] / p0[i]) for i in cells) / shared + math.log(share / (1 - share))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    base = [sum(t == 1 for t in truth), [sum(x[i] for x, t in zip(known, truth) if t == 1) for i in range(n)], sum(t != 1 for t in truth), [sum(x[i] for x, t in zip(known, truth) if t != 1) for i in range(n)]]
    p1, p0 = rates(*base)
    together = [[0.0] * n for _ in range(n)]
    for turn in range(rounds):
        sums = [0.0, [0.0] * n, 0.0, [0.0] * n]
        moments = [[0.0] * n for _ in range(n)]
        for cells, times in kinds:
            q = post(cells)
            rest = [(i in cells) - q * p1[i] - (1 - q) * p0[i] for i in range(n)]
            sums[0] += q * times
            sums[2] += (1 - q) * times
            for i in cells:
                sums[1][i] += q * times
                sums[3][i] += (1 - q) * times
            for i in range(n):
                for j in range(n):
                    moments[i][j] += times * rest[i] * rest[j]
        w = min(1.0, len(truth) / (sums[0] + sums[2]))
        p1, p0 = rates(base[0] + w * sums[0], [a + w * b for a, b in zip(base[1], sums[1])], base[2] + w * sums[2], [a + w * b for a, b in zip(base[3], sums[3])])
        if turn in X.CORRELATE:
            d = [math.sqrt(moments[i][i]) + 1e-9 for i in range(n)]
            together = [[0.0 if i == j else min(max(moments[i][j] / (d[i] * d[j]), 0), 1) for j in range(n)] for i in range(n)]
    return p1, p0, [post(cells) for cells, _ in kinds]


def test_label_model_equals_plain_expectation_maximisation(spark):
    r = random.Random(0)
    n, rows = 5, []
    for _ in range(3000):
        bad = r.random() < 0.15
        cells = [i for i, (hit, miss) in enumerate(((0.6, 0.001), (0.5, 0.002), (0.3, 0.01), (0.1, 0.1), (0.05, 0.9))) if r.random() < (hit if bad else miss)]
        rows.append((bad, cells))
    kinds = {}
    for _, cells in rows:
        kinds[tuple(cells)] = kinds.get(tuple(cells), 0) + 1
    known = np.array([[i in cells for i in range(n)] for _, cells in rows[:300]], dtype=float)
    truth = np.array([float(bad) for bad, _ in rows[:300]])
    df = spark.createDataFrame([(list(k), v) for k, v in kinds.items()], "cells array<int>, times long")
    got = X.label_model(df, n, known, truth, 0.15)
    p1, p0, post = plain_label_model(list(kinds.items()), known.tolist(), truth.tolist(), 0.15, X.ROUNDS)
    assert np.allclose(got[0], p1, atol=1e-4) and np.allclose(got[1], p0, atol=1e-4)
    dense = np.array([[i in k for i in range(n)] for k in kinds], dtype=float)
    own = X.posterior(dense, *got)
    assert np.allclose(own, post, atol=1e-3)
    of = dict(zip(kinds, own))
    assert np.mean([(of[tuple(cells)] > 0.5) == bad for bad, cells in rows]) > 0.93


def test_toxicity_long_repeated_and_clashing(spark):
    docs = spark.createDataFrame([(i % 300, ("zblork " if i % 4 == 0 else "friend ") * (60_000 if i == 8 else 5), "x", 1.0) for i in range(600)], "doc_id long, text string, cells string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 7) for i in range(300)], "doc_id long, toxic int, times int")
    rows = X.scored(docs.withColumnRenamed("score", "own"), X.learn(docs, labels), "doc_id", "cells", "own").collect()
    assert len(rows) == 600 and {(r["doc_id"] % 4 == 0, r["predicted"]) for r in rows} == {(True, 1), (False, 0)}
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], set()).add(r["score"])
    assert sum(len(s) > 1 for s in of.values()) <= 1  # the long text's row has a twin of another text


def test_language_pruned_trees_and_long_texts(spark):
    docs = spark.createDataFrame([(i, ("the cat sat on the mat and saw the dog " if i % 2 else "der hund lief in den garten und sah die katze ") * 4, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    whole = L.learn(docs)
    found = L.context_counts(docs, L.ORDER).toPandas()
    small = L.Model(["de", "en"], {k: (g["gram"].to_numpy(), g["n"].to_numpy(dtype=float)) for k, g in found.groupby("lang")}, limit=15_000)
    assert small.table.nbytes <= 15_000 < whole.table.nbytes
    for k in range(1, L.ORDER + 1):
        assert set(small.contexts[k] % small.size ** (k - 1)) <= set(small.contexts[k - 1])
    p = small.table.reshape(-1, small.size, 2)
    assert np.allclose(np.exp2(-p.astype(float)).sum(1), 1, atol=1e-3)
    long = spark.createDataFrame([(1, "the dog and the cat " * 100_000, "s"), (1, "the dog and the cat " * 100_000, "s"), (2, "die katze und der hund", "s")], "doc_id long, text string, score string")
    got = L.predict(long.withColumnRenamed("score", "bits"), small, "doc_id", "bits").collect()
    assert [r["lang_pred"] for r in got] == ["en", "en", "de"] and got[0] == got[1]


def test_url_rules(spark):
    urls = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "http://EXAMPLE.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://m.example.com/en/?q": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://www.example.com/en/#t": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "ftp://x.net/es/a/b": ("x.net", "/es/a/b", "net/es/", "block"),
        "http://com/": ("com", "/", "com/", "allow"),
        "http://a.com": ("a.com", "", None, None),
        "http://telecom/x": ("telecom", "/x", None, None),
        "a.com/x": ("", "", None, None),
        "http://a.org/http://b.com/x": ("a.org", "/http://b.com/x", None, None),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(98, None), (99, "")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r["page_id"]: r for r in U.judge(pages, labels).collect()}
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert rows[i]["verdict"] == (verdict or "allow")
    assert rows[98]["host"] == rows[99]["path"] == "" and U.judge(pages.limit(0), labels).count() == 0


def test_url_trees_learn(spark):
    r = random.Random(2)
    pages, labels = [], []
    for i in range(600):
        bad = r.random() < 0.4
        host = "casino-win" if bad else r.choice(["news", "blog", "shop"])
        pages.append((i, f"https://{host}{r.randrange(9)}.example.org/en/{i}?p={r.randrange(99)}"))
        labels.append((i, int(not bad), 0))
    got = U.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    right = {i: "allow" if q else "block" for i, q, _ in labels}
    assert sum(r["verdict"] == right[r["page_id"]] for r in got.collect()) > 570


def test_suffix_statistics_leave_the_own_fold_out(spark):
    r = random.Random(6)
    rows = [(f"a.b{r.randrange(4)}.c", f"b{r.randrange(4)}.c", "c", float(r.random() < 0.3), r.randrange(U.FOLDS)) for _ in range(200)]
    known = spark.createDataFrame(rows, "_s3 string, _s2 string, _s1 string, y double, _fold int")
    stats = [U.suffix_counts(known, k) for k in (1, 2, 3)]
    for fold in (None, "_fold"):
        got = sorted(tuple(x) for x in U.with_stats(known, stats, 0.3, fold).select("_s3", "_s2", "_s1", "y", "_fold", *[F.round(f"f_stat{k}", 9) for k in (1, 2, 3)]).collect())
        want = []
        for row in rows:
            shares = []
            for at in (2, 1, 0):
                same = [o for o in rows if o[at] == row[at] and (fold is None or o[4] != row[4])]
                shares.append(round((sum(o[3] for o in same) + U.PRIOR * 0.3) / (len(same) + U.PRIOR), 9))
            want.append((*row, *shares))
        assert got == sorted(want)
    unseen = spark.createDataFrame([("z", "z", "z")], "_s3 string, _s2 string, _s1 string")
    assert U.with_stats(unseen, stats, 0.3).first()["f_stat2"] == 0.3


def test_url_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a?" + "q" * 200_000, "h"), (1, "http://x.net/a?" + "q" * 200_000, "h"), (None, "http://u.org/7", "h")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(7, 0, None), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = U.judge(pages, labels).collect()
    assert [r["host"] for r in got] == ["x.net", "x.net", "u.org"] and len({r["verdict"] for r in got}) == 1


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("",), ("aaaa",), ("a.b?",)], "u string").select(U.entropy(F.col("u"))).collect()
    assert [round(r[0], 6) for r in got] == [1.0, 0.0, 0.0, 2.0]
