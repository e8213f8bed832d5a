import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from loomgraph.llm.sentencepiece_fst import decode, encode, machine, op6_sentencepiece  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return machine(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=str(PATH))


def texts():
    r = random.Random(2)
    parts = ["the", "ing", "Hello", "é", "ß", "ñ", "你", "好", "𝔘", "🙂", " ", "  ", "     ", "\n", "\t", "123", "4", "!!", "…", "▁", "<0x0A>", "<s>", "\x00", "ﬁ", "é"]
    fixed = ["", " ", "  ", "Hello world", " leading", "trailing ", "a  b   c", "\n\n", "x\n y", "tionherthe" * 40, "0" * 70, " " * 40 + "x", "a" * 300]
    return fixed + ["".join(r.choices(parts, k=r.randrange(1, 60))) for _ in range(400)]


def test_ids_equal_the_library(both):
    own, library = both
    for t in texts():
        assert own.encode(t) == library.encode(t), t


def test_real_texts(both, spark):
    own, library = both
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for d in docs[:120]:
        ids = own.encode(d["text"])
        assert ids == library.encode(d["text"])
        assert own.decode(ids) == d["text"] == library.decode(ids)


def test_frames(spark):
    docs = spark.createDataFrame([(1, "some text\nhere"), (2, None), (3, ""), (3, "x")], "doc_id long, text string")
    coded = encode(docs, "doc_id")
    assert [(r["doc_id"], r["text"]) for r in decode(coded, "doc_id").collect()] == [(1, "some text\nhere"), (2, ""), (3, ""), (3, "x")]
    assert encode(docs.limit(0), "doc_id").count() == 0


def test_unigram_takes_the_lightest_path(both):
    own, _ = both

    class Tiny:
        pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -3.5, 1), ("▁a", -1.0, 1), ("bb", -9.0, 1)]
        kind, byte_fallback, unknown, dummy_prefix, squeeze, escape = 1, False, 0, True, True, True

    t = type(own)(Tiny())
    assert t.encode("ab") == [5, 3]
    assert t.encode("  bab ") == [1, 3, 4]
    assert t.encode("abb?") == [5, 3, 3, 0]


def test_long_runs_of_spaces_and_long_words(both):
    own, library = both
    for t in (" " * 200_000, "a" + " " * 50_000 + "b", "x" * 20_000, ("né " * 7 + " " * 9) * 500):
        assert own.encode(t) == library.encode(t)


def test_normaliser_machine(both):
    own, _ = both
    r = random.Random(3)

    class Squeezing:
        pieces, kind, byte_fallback, unknown, dummy_prefix, squeeze, escape = [("<unk>", 0.0, 2)], 1, False, 0, True, True, True

    t = type(own)(Squeezing())
    for _ in range(200):
        text = "".join(r.choices(" ab", k=r.randrange(12)))
        kept = " ".join(text.split())
        assert t.normalise(text) == ("▁" + kept.replace(" ", "▁") if kept else "")


def test_shortest_path_weighs_least_of_all_paths(both):
    own, _ = both
    r = random.Random(9)
    names = ["a", "b", "ab", "ba", "aba", "▁", "▁a", "bb"]

    class Random:
        pieces = [("<unk>", 0.0, 2)] + [(p, -r.uniform(1, 5), 1) for p in names]
        kind, byte_fallback, unknown, dummy_prefix, squeeze, escape = 1, False, 0, True, True, True

    t = type(own)(Random())
    cost = {p: -w for p, w, kind in Random.pieces if kind == 1}

    def least(x):
        return min((cost[p] + least(x[len(p) :]) for p in names if x.startswith(p)), default=0.0 if not x else float("inf"))

    for _ in range(100):
        text = "".join(r.choices("ab", k=r.randrange(1, 11)))
        assert abs(sum(cost[Random.pieces[i][0]] for i in t.encode(text)) - least("▁" + text)) < 1e-9


def test_query_equals_the_library(both, spark, tmp_path):
    import zlib

    _, library = both
    rows = [(1, "some text\nhere", "n"), (2, None, "n"), (2, None, "n"), (3, "a ▁ b", "n"), (None, "  two  ", "n")]
    spark.createDataFrame(rows, "doc_id long, text string, n_ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in op6_sentencepiece(spark, str(tmp_path)).collect())))
    want = []
    for doc, text, _ in rows:
        ids = library.encode(text or "")
        want.append((doc, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)), library.decode(ids) == (text or "")))
    assert got == sorted(map(str, want))
    clashing = spark.createDataFrame([("i", "x")], "ids string, text string")
    assert [r["ids"] for r in encode(clashing.withColumnRenamed("ids", "_ids"), "_ids").collect()] == [library.encode("x")]
