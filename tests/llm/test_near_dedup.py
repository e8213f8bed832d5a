import random
from collections import Counter

import numpy as np

from loomgraph.llm import common
from loomgraph.llm.common import among, materialize, with_uid
from loomgraph.llm.near_dedup import aligned, dedup_near, near_groups, op10_minhash_near_dedup, shingles


def labelled(text):
    words = text.split()
    parts = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    seen, out = Counter(), []
    for p in parts:
        out.append((p, seen[p]))
        seen[p] += 1
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], (left + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def brute_groups(texts):
    """Component of each text under pairs with an aligned share of 0.8 or more."""
    parts = [labelled(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if not parts[i] or not parts[j]:
                continue
            common = len(set(parts[i]) & set(parts[j]))
            if common * 5 < 4 * (len(parts[i]) + len(parts[j]) - common):
                continue
            m = lcs(parts[i], parts[j])
            if 5 * m >= 4 * (len(parts[i]) + len(parts[j]) - m):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    passage = r.choices(vocab, k=30)
    texts = []
    for _ in range(25):
        base = r.choices(vocab, k=r.choice([3, 6, 60, 150])) + (passage if r.random() < 0.5 else [])
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 6])):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
    shuffled = texts[0].split()
    r.shuffle(shuffled)
    return texts + [" ".join(shuffled), "", "  \n"]


def edited(r, words, times):
    words = list(words)
    for _ in range(times):
        words[r.randrange(len(words))] = f"n{r.randrange(10**9)}"
    return words


def families(seed):
    """Chains (copies of copies), a star, and a random tree of copies, with a passage that all texts of the seed hold."""
    r = random.Random(seed)
    passage = [f"p{seed}x{i}" for i in range(25)]
    texts = []
    for kind in ("chain", "star", "tree"):
        made = [[f"{kind}{seed}w{i}" for i in range(r.choice([60, 120]))] + passage]
        for _ in range(r.randrange(6, 12)):
            of = {"chain": made[-1], "star": made[0], "tree": r.choice(made)}[kind]
            made.append(edited(r, of, r.randrange(1, 5)))
        texts += made
    texts += [[f"lone{seed}w{i}k{k}" for i in range(40)] + passage for k in range(3)]
    r.shuffle(texts)
    return [" ".join(w) for w in texts]


def groups_of(spark, texts, **how):
    numbered = with_uid(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = numbered.join(near_groups(numbered, **how), "_uid").collect()
    ids = {r["_uid"]: r["doc_id"] for r in rows}
    found = {r["doc_id"]: (ids[r["keep_uid"]], r["class_size"]) for r in rows}
    return [found[i] for i in range(len(texts))]


def brute_classes(texts):
    of = brute_groups(texts)
    size = Counter(of)
    return [(g, size[g]) for g in of]


def test_groups_match_brute_force(spark):
    texts = corpus()
    expected = brute_classes(texts)
    assert groups_of(spark, texts) == expected
    # without leaders, and with lists dealt into blocks of four, the exact filter finds the same
    assert groups_of(spark, texts, led=False, list_size=4) == expected


def test_chains_stars_and_trees_of_twenty_seeds(spark):
    texts, expected = [], []
    for seed in range(20):
        own = families(seed)
        expected += [(g + len(texts), n) for g, n in brute_classes(own)]
        texts += own
    assert groups_of(spark, texts) == expected
    assert groups_of(spark, texts, list_size=3) == expected


def test_query_and_renaming_of_columns(spark, tmp_path):
    texts = corpus(8)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, _UID long")
    expected = brute_classes(texts)
    assert sorted(r["doc_id"] for r in dedup_near(docs).collect()) == sorted({g for g, _ in expected})
    docs.select("doc_id", "text").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op10_minhash_near_dedup(spark, str(tmp_path)).collect()}
    assert [(got[i]["class_id"], got[i]["class_size"], got[i]["kept"]) for i in range(len(texts))] == [(g, n, g == i) for i, (g, n) in enumerate(expected)]


def test_row_numbers_do_not_follow_the_splits(spark, tmp_path):
    spark.range(2000).repartition(12).write.parquet(f"{tmp_path}/t")
    told = []
    for splits in ("4", "8"):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", splits)
        told.append(sorted(map(tuple, with_uid(spark.read.parquet(f"{tmp_path}/t")).collect())))
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert told[0] == told[1] and len({u for _, u in told[0]}) == 2000


def test_edges(spark):
    rows = [(None, "a b c"), (None, "a b c"), (4, None), (5, ""), (2, "a b c"), (2, "a b c"), (9, "x " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in dedup_near(docs).collect()) == ["2", "4", "5", "9"]
    assert dedup_near(docs.limit(0)).count() == 0


def test_alignment_is_exact():
    r = random.Random(1)
    for _ in range(40):
        a = [r.choice("pqrst") for _ in range(60)]
        b = list(a)
        for _ in range(r.randrange(6)):
            b[r.randrange(len(b))] = r.choice("pqrst")
        if r.random() < 0.5:
            b = b[5:] + b[:5]
        raw = (" ".join(a) + " ".join(b)).encode()
        cut = len(" ".join(a))
        s, bounds, _ = shingles(np.frombuffer(raw, np.uint8), np.array([0, cut, len(raw)]))
        x, y = labelled(" ".join(a)), labelled(" ".join(b))
        m = aligned(s[: bounds[1]], s[bounds[1] :])
        true = lcs(x, y)
        if 5 * true >= 4 * (len(x) + len(y) - true):
            assert m == true
        else:
            assert 5 * m < 4 * (len(x) + len(y) - m)


def family(seed):
    """A text, a copy x of it, a copy of x that is no longer similar to the text, and two texts nearer to the first."""
    r = random.Random(seed)

    def copy(words, places):
        words = list(words)
        for k in places:
            words[k] = f"n{r.randrange(10**9)}"
        return words

    lead = [f"s{seed}w{i}" for i in range(120)]
    x = copy(lead, [r.randrange(0, 30), r.randrange(30, 60)])
    y = copy(x, [r.randrange(60, 90), r.randrange(90, 120)])
    return [" ".join(w) for w in (lead, x, y, *(copy(lead, [r.randrange(120)]) for _ in range(2)))]


def test_copy_of_a_copy_that_matches_no_leader(spark):
    # in every bucket that x and y share, x matches the leader and y does not
    texts = [t for seed in (121, 162, 165, 169, 206, 397) for t in family(seed)]
    assert [g for g, _ in groups_of(spark, texts)] == brute_groups(texts) == [i - i % 5 for i in range(len(texts))]


def test_very_long_texts(spark):
    r = random.Random(5)
    long = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    assert [g for g, _ in groups_of(spark, [" ".join(long), " ".join(edited(r, long, 500)), " ".join(edited(r, long, 9000))])] == [0, 0, 2]


def test_few_keys_are_met_without_a_shuffle(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("id AS _uid", "'t' || id AS text")
    ids = materialize(spark.range(0, 9000, 7).select("id"), "ids")
    want = [(k, f"t{k}") for k in range(0, 5000, 7)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = among(rows, "_uid", ids, "id")
        assert "Exchange hashpartitioning" not in told._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, told.collect())) == want
        monkeypatch.setattr(common, "CELLS", 100)  # more keys than may be broadcast
        told = among(rows, "_uid", ids, "id")
        assert "Exchange hashpartitioning" in told._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, told.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
