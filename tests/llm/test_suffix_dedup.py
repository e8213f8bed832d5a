import hashlib
import random
from collections import defaultdict

import pytest

import loomgraph.llm.suffix_dedup as S
from loomgraph.llm.common import with_uid


def brute(rows, length, keep_first):
    """Removed byte places per doc_id, by a table of every string."""
    seen = defaultdict(list)
    texts = {d: (t or "").encode() for d, t in rows}
    for d, raw in sorted(texts.items()):
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]].append((d, i))
    gone = defaultdict(set)
    for places in seen.values():
        for d, i in places[1:] if keep_first else places if len(places) > 1 else []:
            gone[d].update(range(i, i + length))
    return gone


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 7)))
    base = [" ".join(word() for _ in range(r.choice([5, 30, 60]))) for _ in range(12)]
    rows = []
    for d in range(90):
        parts = []
        for _ in range(r.randrange(1, 4)):
            t = list(r.choice(base)) if r.random() < 0.7 else list(" ".join(word() for _ in range(30)))
            for _ in range(r.choice([0, 0, 1, 2])):
                t[r.randrange(len(t))] = r.choice("xyz")
            parts.append("".join(t))
        rows.append((d, r.choice(["", " ", ". "]).join(parts)))
    return rows + [(100, None), (101, ""), (102, "ab" * 200), (103, "x" * 150), (104, rows[0][1])]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("crowd", [256, 2])
def test_matches_brute_force(spark, keep_first, crowd):
    rows, length = corpus(), 60
    docs = with_uid(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = {r["_uid"]: r["doc_id"] for r in docs.collect()}
    got = defaultdict(set)
    for r in S.covered(docs, length, keep_first, crowd).collect():
        for a, b in r["spans"]:
            got[ids[r["_uid"]]].update(range(a, b))
    want = brute(rows, length, keep_first)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 500)
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh") for _ in range(2500))
    text = text + text[300:900] + text[1200:1300]
    data = S.np.frombuffer(text.encode(), S.np.uint8)
    whole = S._anchors_of(data, S.np.array([0, len(data)]), 60)
    places = set()
    for shift, lo, hi in S._blocks(len(data), 60):
        part = data[shift : hi + 120]
        row, pos, g, rr, left, right = S._anchors_of(part, S.np.array([0, len(part)]), 60)
        keep = (pos + shift >= lo) & (pos + shift < hi)
        places |= set(zip((pos + shift)[keep].tolist(), g[keep].tolist(), rr[keep].tolist(), strict=True))
    assert set(zip(whole[1].tolist(), whole[2].tolist(), whole[3].tolist(), strict=True)) <= places


def test_texts_and_query(spark, tmp_path):
    rows = corpus(2)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_chars long, _uid string")
    gone = brute(rows, 60, True)
    out = {r["doc_id"]: r for r in S.dedup_substrings(docs, 60, True).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        left = bytes(c for i, c in enumerate(raw) if i not in gone[d]).decode("utf-8", "ignore")
        if gone[d] and not left.strip(" "):
            assert d not in out
        else:
            assert (out[d]["text"] or "") == left and out[d]["_uid"] == "x"
    assert S.dedup_substrings(docs.limit(0)).count() == 0
    spark.createDataFrame(rows + [(200, "q" * 900), (201, "é" * 399)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows + [(200, "q" * 900), (201, "é" * 399)], 400, False)
    for r in S.op3_suffix_array_dedup(spark, str(tmp_path)).collect():
        raw = (dict(rows + [(200, "q" * 900), (201, "é" * 399)])[r["doc_id"]] or "").encode()
        gone = want[r["doc_id"]]
        kept = bytes(c for i, c in enumerate(raw) if i not in gone)
        runs = sum(i - 1 not in gone for i in gone)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())
        assert r["kept_text"] == kept.decode("utf-8", "ignore")
