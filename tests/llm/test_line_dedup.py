import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomgraph.llm import line_dedup
from loomgraph.llm.common import with_uid
from loomgraph.llm.line_dedup import THRESHOLD, Meeting, _entries, _mask, _record, bitmaps, bucket_bits, deal, dedup_lines, line_classes, op1_line_dedup, removed_lines, undealt, word_sketch

SCHEMA = "doc_id long, text string, _uid string, line string"


def brute(rows):
    """Removed (doc_id, line), by comparing everything."""
    lines = []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate((r[1] or "").split("\n")):
            if (words := frozenset(line.split())):
                lines.append((r[0], k, words))
    gone = set()
    for i, (d, k, s) in enumerate(lines):
        if any(5 * len(s & t) >= 4 * len(s | t) for *_, t in lines[:i]):
            gone.add((d, k))
    return gone


def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "é"] * 5
    base = [" ".join(r.choices(words, k=r.choice([1, 3, 8, 20, 40]))) for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(r.randrange(1, 8)):
            line = r.choice(base).split()
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                line[r.randrange(len(line))] = r.choice(words)
            lines.append(" ".join(line) + r.choice(["", " ", "\t"]))
        rows.append((d, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1])]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    gone = brute(rows)
    numbered = with_uid(docs.drop("_uid", "line"))
    names = {r["_uid"]: r["doc_id"] for r in numbered.collect()}
    got = {(names[r["_uid"]], k) for r in removed_lines(numbered).collect() for k in r["removed_lines"]}
    assert got == gone
    for limits in ({"all_up_to": 1, "best": 1}, {"crowd": 3, "leaders": 1}):
        _, classes = line_classes(numbered, **limits)
        plain = line_classes(numbered)[1]
        assert sorted(map(tuple, classes.collect())) == sorted(map(tuple, plain.collect()))
    kept = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    for d, t in rows:
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone)
        had = any((d, k) in gone for k in range(len((t or "").split("\n"))))
        if had and not left.strip():
            assert d not in kept
        else:
            assert kept[d]["text"] == (left if t is not None else None) and kept[d]["line"] == "y" and kept[d]["_uid"] == "x"


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text="a b c d e"), Row(doc_id=1, text="a b c d e"), Row(doc_id=None, text="q r s")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in dedup_lines(docs).collect()) == ["1", "None"]
    assert dedup_lines(docs.limit(0)).count() == 0


def test_more_candidates_than_told_of_one_document(spark):
    # B has candidates C1 to C5 of earlier documents and A, a later line of its own document, that only B is similar to
    rows, doc = [], 0
    for f in range(12):
        b = [f"f{f}w{i}" for i in range(20)]
        alter = lambda name, places: " ".join(f"f{f}{name}{i}" if i in places else w for i, w in enumerate(b))  # noqa: E731, B023
        for c in range(5):
            rows.append((doc + c, alter(f"c{c}x", (8 + 2 * c, 9 + 2 * c))))
        rows.append((doc + 5, " ".join(b) + "\n" + alter("a", (18, 19))))
        rows.append((doc + 6, "\n".join(w for w in b[3:] for _ in range(30))))  # so that all meet under few words
        doc += 7
    numbered = with_uid(spark.createDataFrame(rows, "doc_id long, text string"))
    names = {r["_uid"]: r["doc_id"] for r in numbered.collect()}
    got = {(names[r["_uid"]], k) for r in removed_lines(numbered).collect() for k in r["removed_lines"]}
    assert got == brute(rows)


def test_query_on_odd_rows(spark, tmp_path):
    rows = corpus() + [(200, "\n".join(f"line {k % 50} of very many {k % 50}" for k in range(20_000)) + "\nlast one here"), (None, "q r s")]
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_lines int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    short = [(d, t if d != 200 else "\n".join(dict.fromkeys(t.split("\n")))) for d, t in rows]
    gone = brute(short)
    got = {r["doc_id"]: r for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        n = 0 if t is None else t.count("\n") + 1
        assert got[d]["n_lines"] == n and got[d]["n_removed"] == len(got[d]["removed_lines"])
        if d != 200:
            assert got[d]["removed_lines"] == sorted(k for x, k in gone if x == d)
    first, left = set(), set(range(20_001)) - set(got[200]["removed_lines"])
    names = rows[-2][1].split("\n")
    for k in sorted(left):  # of equal lines the first, unless a similar one stands before it
        assert names[k] not in first
        first.add(names[k])
    assert {names[k] for k in left} == {x for k, x in enumerate(dict.fromkeys(names)) if (200, k) not in gone}


def test_mask_of_removed_lines(spark):
    lines = [[0], [3, 1], [70_000]]
    got = spark.createDataFrame([(x,) for x in lines], "n array<int>").select(_mask(F.col("n"))).collect()
    assert [[k for k, b in enumerate(bytes(r[0])) if b] for r in got] == [sorted(x) for x in lines]


def _under_one_word(n, near=()):
    """Sorted index entries of n sets under one word: unrelated ones, and copies of one set with a word changed at the places in near."""
    r = np.random.default_rng(3)
    some = lambda k: r.integers(0, 1 << 64, k, dtype=np.uint64)
    base, rows = some(24), []
    for i in range(n):
        words = some(12 + i % 60)
        h = np.append(base[:-1], words[0]) if i in near else words
        y, v = bitmaps(h, np.array([0]))
        rows.append((7, int(r.integers(0, 1 << 62)), int(y.view(np.int64)[0]), int(v.view(np.int64)[0]), len(h) << 24, i))
    return np.array(rows, np.int64).T


def test_few_pairs_under_a_frequent_word_are_checked_in_full(monkeypatch):
    checked = []
    fits = Meeting._fits
    monkeypatch.setattr(Meeting, "_fits", lambda self, c, i, o: checked.append(len(i)) or fits(self, c, i, o))
    n, near = 3000, set(range(5, 3000, 100))
    rows = _under_one_word(n, near)
    pair, marked = Meeting((4, 5)).pairs(rows)
    ids = rows[1]
    assert {tuple(sorted(p)) for p in pair.tolist()} >= {tuple(sorted((int(ids[5]), int(ids[105]))))}
    assert set(marked.tolist()) <= {int(ids[i]) for i in near}
    assert sum(checked) < n * n // 100  # of n * n / 2


def test_crowd_leaves_unrelated_classes_settled():
    n, near = 600, set(range(100, 600, 7))
    rows = _under_one_word(n, near)
    plain, _ = Meeting((4, 5), all_up_to=1 << 40).pairs(rows)
    pair, marked = Meeting((4, 5), crowd=200, leaders=8).pairs(rows)
    # a pair that is not told is one of a class that is met again
    left = {tuple(p) for p in plain.tolist()} - {tuple(p) for p in pair.tolist()}
    assert left and all({a, b} & set(marked.tolist()) for a, b in left)
    assert set(marked.tolist()) <= {int(rows[1][i]) for i in near}
    assert len(marked) >= len(near) - 8
    again, _ = Meeting((4, 5), only=np.isin(np.arange(1 << 12), marked & 4095)).pairs(rows)
    assert {tuple(p) for p in plain.tolist()} == {tuple(p) for p in np.concatenate([pair, again]).tolist()}


def test_first_lines_are_told_where_lines_meet():
    lines = [(k, 100 - u, k + 1, 0, -1 - n, w) for k in (-5, 3, 9) for u, n, w in ((7, 2, 4), (8, 0, 4), (9, 5, 4), (8, 1, 4), (6, 0, 5))]
    batches = [_record(*np.array(lines[i : i + 4], np.int64).T) for i in range(0, len(lines), 4)]  # classes go on in the next batch
    rows = [r for b in Meeting((4, 5))(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted((u, n) for *_, u, n, _, kind in rows if kind == 1) == sorted((u, -1 - z) for _, u, _, _, z, _ in lines)
    assert sorted((a, b, u, n, w) for a, b, u, n, w, kind in rows if kind == 3) == [(k, k + 1, 91, 5, 4) for k in (-5, 3, 9)]


def test_lines_reach_their_rows_without_their_classes(spark):
    docs = with_uid(spark.createDataFrame(corpus(), "doc_id long, text string"))
    lines, classes = line_classes(docs)
    assert lines.columns == ["uid", "line"]
    stays = {(r["first"]["uid"], r["first"]["line"]) for r in classes.where("first_stays").collect()}
    gone = {(r["_uid"], k) for r in removed_lines(docs).collect() for k in r["removed_lines"]}
    assert {tuple(r) for r in lines.collect()} == gone | stays and not gone & stays


def test_lines_need_one_python_worker_a_task(spark, tmp_path):
    rows = [(k, "one line of words that others have too\nand one more", "x", "y") for k in range(4)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / "docs"))
    numbered = with_uid(spark.read.parquet(str(tmp_path / "docs")).drop("_uid"))
    assert "ExistingRDD" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert numbered.select("_uid").distinct().count() == 4
    got = dedup_lines(spark.read.parquet(str(tmp_path / "docs")))
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 1


def test_first_lines_are_not_shuffled_for_few_candidates(spark, monkeypatch):
    docs = with_uid(spark.createDataFrame(corpus(), "doc_id long, text string"))
    plans, write = {}, line_dedup.materialize

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(line_dedup, "materialize", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line_classes(docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all("Exchange hashpartitioning" not in plans[name] for name in ("wanted", "open"))


def test_index_is_shuffled_in_blocks(spark):
    docs = with_uid(spark.createDataFrame([(k, " ".join(f"w{(k * 7 + i * i) % 5000}" for i in range(60))) for k in range(4000)], "doc_id long, text string").coalesce(1))
    docs = docs.withColumn("_by", F.col("doc_id"))
    sketch = word_sketch(docs)
    blocks = _entries(docs, sketch, THRESHOLD)
    assert blocks.count() <= 2 * (1 << bucket_bits(line_dedup.COUNTED * int(sketch.sum()))) < 4000
    rows = np.concatenate([np.stack([c.to_numpy() for c in b.columns]) for b in undealt(iter(blocks.orderBy("bucket").toArrow().to_batches()))], axis=1)
    assert (rows[4] < 0).sum() == 4000
    assert (rows[4] >= 0).sum() > 4000


def test_blocks_hold_their_rows(monkeypatch):
    monkeypatch.setattr(line_dedup, "BUFFER", 100)
    r = np.random.default_rng(4)
    for own in (False, True):
        rows = r.integers(-(1 << 63), (1 << 63) - 1, (6, 1000))
        rows[0, :50] = rows[0, 0]
        rows[1], rows[2] = 0, rows[2] >> 40
        rows[4] = -1 - (rows[4] & 0xFFFFF) if own else rows[4] & 0xFFFFFFFFFF
        rows[0] = rows[0] if own else rows[0] & 0xFFFFFFFF
        dealt = [x for part in (rows[:, :600], rows[:, 600:]) for b in deal(part.copy(), own, 6) for x in b.to_pylist()]
        dealt.sort(key=lambda x: x["bucket"])
        got = np.concatenate([np.stack([c.to_numpy() for c in b.columns]) for b in undealt(iter([pa.RecordBatch.from_pylist(dealt[i : i + 9]) for i in range(0, len(dealt), 9)]))], axis=1)
        assert (np.diff(got[0].astype(object)) >= 0).all()
        assert sorted(map(tuple, got.T.tolist())) == sorted(map(tuple, rows.T.tolist()))


def test_words_that_share_their_told_bits_keep_both_places():
    rows = np.array([(1, 7, 0, 0, (20 << 24) | 4, 0), (1, 7, 0, 0, 20 << 24, 0), (1, 8, 0, 0, (20 << 24) | 4, 1), (1, 8, 0, 0, 20 << 24, 1)], np.int64).T
    assert Meeting((4, 5)).pairs(rows)[0].tolist() == [[7, 8]]


def test_sketch_counts_every_word_of_all_pieces(spark):
    texts = [f"{'alpha beta ' * 4000}gamma{i}\n{'delta ' * 3000}" for i in range(12)]  # pieces of 64 kB and more
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert int(word_sketch(docs).sum()) == sum(len(t.split()) for t in texts)


def test_lines_that_were_read_are_not_read_again(spark, monkeypatch):
    docs = with_uid(spark.createDataFrame(corpus(), "doc_id long, text string"))
    plain = sorted(map(tuple, line_classes(docs)[1].collect()))
    seen, texts, words = [], line_dedup._texts, line_dedup._prefix_words
    monkeypatch.setattr(line_dedup, "_texts", lambda *a: seen.append("texts") or texts(*a))
    monkeypatch.setattr(line_dedup, "_prefix_words", lambda *a: seen.append("words") or words(*a))
    assert sorted(map(tuple, line_classes(docs, all_up_to=1, best=1)[1].collect())) == plain
    assert seen == ["texts", "words", "texts"]  # open classes were among the ends of pairs


def test_one_sort_orders_words_and_entries():
    r = np.random.default_rng(7)
    for top in (2, 1 << 30, (1 << 63) - 1):
        k, x, w = np.sort(r.integers(0, 40, 900)), r.integers(-top, top, 900), r.integers(0, 3, 900)
        x[300:600] = x[:300]
        assert [c[line_dedup.by_word(k, x, w)].tolist() for c in (k, x, w)] == [c[np.lexsort((w, x, k))].tolist() for c in (k, x, w)]
    h = r.integers(0, 1 << 63, 500).astype(np.uint64)
    h = np.concatenate([h, h[:200], (h[:50] ^ np.uint64(1))])  # repeated, and alike in their upper bits
    line, count = np.sort(r.integers(0, 9, len(h))), (h >> np.uint64(61)).astype(np.int64)
    got = line_dedup.word_sets(h, line, count)
    assert list(zip(*(c.tolist() for c in got[::-1]), strict=True)) == [(i, x) for i, _, x in sorted(set(zip(line.tolist(), count.tolist(), h.tolist(), strict=True)))]


def test_lines_are_counted_where_their_text_is(spark):
    texts = [None, "", "\n", "a b\n \t\n\n\x0bc\n", " \u00a0 ", "x\r\ny", *(t for _, t in corpus())]
    docs = with_uid(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_lines"], r["worded"]) for r in line_dedup.worded_lines(docs).collect()}
    lines = [[] if t is None else t.split("\n") for t in texts]
    assert got == {k: (len(x), [i for i, y in enumerate(x) if y.encode().split()]) for k, x in enumerate(lines)}
    assert 1 not in {r["kind"] for r in line_dedup.met(_entries(docs.withColumn("_by", F.col("doc_id")), word_sketch(docs), THRESHOLD), Meeting(THRESHOLD, lines=False)).select("kind").distinct().collect()}


def test_lines_that_no_wanted_word_indexes_are_passed_over():
    texts = ["\n".join(f"r{k} s{k} " + " ".join(f"c{i}" for i in range(9)) for k in range(40))]
    batch = pa.RecordBatch.from_pydict({"_uid": [0], "_by": [0], "text": texts})
    sketch, only = np.zeros(1 << line_dedup.SKETCH_BITS, np.int64), np.zeros(1 << line_dedup.WANTED_BITS, bool)
    h, *_, line = line_dedup.word_hashes(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0])]))
    np.add.at(sketch, (h & np.uint64(len(sketch) - 1)).astype(np.int64), 1)
    only[(h[[0, 5]] & np.uint64(len(only) - 1)).astype(np.int64)] = True  # one line's rare word, and a word of all lines
    entries = lambda only: [(int(x), int(k), int(p)) for (lo, *_), (x, o, k, p) in line_dedup._prefixes(iter([batch]), sketch, THRESHOLD, only) for x, k, p in zip(x, lo[o], p, strict=True)]
    every, some = entries(None), entries(only)
    assert len({k for _, k, _ in some}) == 1 and len({k for _, k, _ in every}) == 40
    wanted = lambda found: {e for e in found if only[e[0] & (len(only) - 1)]}
    assert wanted(some) == wanted(every) and len(wanted(some)) == 1
