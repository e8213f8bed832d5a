import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from collections import Counter  # noqa: E402

from loomgraph.llm import packing as P  # noqa: E402


def best_fit_decreasing(counts, capacity):
    bins = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= s]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= s
        else:
            bins.append(capacity - s)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything_and_is_tight(seed):
    r = random.Random(seed)
    lengths = [min(64, max(1, int(r.lognormvariate(2.5, 1)))) for _ in range(1500)] if seed % 2 else [r.randrange(1, 65) for _ in range(900)]
    counts = dict(Counter(lengths))
    classes = P.plan(counts, 64)
    placed = Counter()
    for items, times in classes:
        assert sum(s * n for s, n in items) <= 64
        for s, n in items:
            placed[s] += n * times
    assert placed == Counter(counts)
    used = sum(t for _, t in classes)
    assert used <= best_fit_decreasing(counts, 64)
    assert used >= -(-sum(lengths) // 64)


def test_configurations_reach_the_fractional_optimum():
    solved = P.configurations([40, 25, 20], [30, 60, 90], 100)
    assert sum(x for _, x in solved) == pytest.approx((30 * 40 + 60 * 25 + 90 * 20) / 100, rel=0.05)
    for a, _ in solved:
        assert a @ np.array([40, 25, 20]) <= 100


def test_cuts():
    assert P.cuts(5, 10) == [(0, 5)] and P.cuts(10, 10) == [(0, 10)]
    assert P.cuts(23, 10) == [(0, 3), (3, 10), (13, 10)] and P.cuts(20, 10) == [(0, 10), (10, 10)]


def test_ids_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = P.Encoder(*P.encoder_files(str(path))), Tokenizer.from_file(str(path))
    for t in ["", "Hello world", "  a\n\n b ", "é𝔘🙂 1234", "x<|endoftext|>y", "<|endoftext|>", "a" * 5000, "\x00​"]:
        assert own(t) == library.encode(t, add_special_tokens=False).ids


def test_packed_rows(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "thndly", "über", "\n"]) for _ in range(r.choice([0, 5, 200, 900, 4000])))) for i in range(120)] + [(7, "twice"), (7, "twice"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [x.asDict() for x in P.pack_documents(docs).collect()]
    import public_tokenizers

    encode = P.Encoder(*P.encoder_files(str(public_tokenizers.path("byte_bpe_50k.json"))))
    want = Counter()
    for d, t in rows:
        ids = np.array([*encode(t or ""), 0], dtype="<u4")
        for p, (s, n) in enumerate(P.cuts(len(ids), 2048)):
            want[d, p, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in out) == want
    by = {}
    for x in out:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert P.pack_documents(docs.limit(0)).count() == 0
    made = P.materialize(P.pieces(docs, str(public_tokenizers.path("byte_bpe_50k.json")), with_ids=True), "ids")
    assert P.sequences(P.pack(made)).count() == len(by)


def test_query_on_odd_rows(spark, tmp_path):
    import public_tokenizers

    encode = P.Encoder(*P.encoder_files(str(public_tokenizers.path("byte_bpe_50k.json"))))
    rows = [(1, "word " * 30_000, 5), (2, None, 5), (None, "", 5), (3, "same text", 5), (3, "same text", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, length int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in P.op4_best_fit_packing(spark, str(tmp_path)).collect()]
    want = []
    for doc, text, _ in rows:
        ids = [*encode(text or ""), P.END_ID]
        first = len(ids) % P.CAPACITY or min(len(ids), P.CAPACITY)
        cut = [0, *range(first, len(ids), P.CAPACITY)]
        for k, (a, b) in enumerate(zip(cut, [*cut[1:], len(ids)])):
            want.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda t: tuple(map(str, t))
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=key) == sorted(want, key=key)
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= P.CAPACITY
    assert len({r["sequence_id"] for r in got}) == -(-sum(r["length"] for r in got) // P.CAPACITY)
