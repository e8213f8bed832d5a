"""Models over tables: nothing is asked twice, failures are asked again; trees by a model equal the loop's."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle

from loomgraph import models
from loomgraph.operators import tree as Tr
from loomgraph.operators.replies import Replies, embedded_by

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks don't have this module


class Scripted(models.Assistant):
    """Tells the first words of what it is asked, and notes each call in a folder."""

    def __init__(self, folder, broken=""):
        self.folder, self.broken = folder, broken

    def note(self):
        open(os.path.join(self.folder, os.urandom(8).hex()), "w").close()

    def chat_json(self, system, user, schema=None):
        self.note()
        if self.broken and self.broken in user:
            raise models.ModelError("down")
        words = user.split(":", 1)[1].split()
        return {"summary": " ".join(words[:25]), "key_finding": words[0], "ideas": [{"statement": f"{words[0]} {len(words)}", "type": "method", "relation_to_paper": "uses", "domain": "D", "entities": words[:2]}, {"statement": " "}]}

    def embed_all(self, texts):
        self.note()
        return [[float(len(t)), 1.0] for t in texts]


def texts(n=7):
    return [(k % 3 if k else None, "\n\n".join(f"t{k} part {j} " + "word " * (30 + 13 * (j % 5)) for j in range(1 + 9 * k))) for k in range(n)] + [(1, None), (1, "")]


def test_trees_by_a_model_equal_the_loop_and_ask_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = texts()
    leaf = Tr.leaf_nodes(spark.createDataFrame(rows, "id long, text string"), "id", "text", 300).persist()
    where, folder = f"{tmp_path}/replies", str(calls)

    def nodes(broken=""):
        built = Tr.build(leaf, 900, condense=Tr.by_model(lambda: Scripted(folder, broken), Replies(spark, where, "m")))
        return [r.asDict(recursive=True) for r in built.collect()]

    with pytest.raises(models.ModelError, match="calls failed"):
        nodes(broken="t3 part 2 ")
    first = len(os.listdir(folder))
    got = nodes()
    grown = [Tr.grow(t or "", Scripted(folder).condense, 300, 900) for _, t in rows]
    calls_of_loop = sum(len(g["nodes"]) for g in grown) - sum(n["level"] == 0 for g in grown for n in g["nodes"])
    trees: dict = {}
    for n in got:
        trees.setdefault(n["tree"], []).append(n)
    shape = lambda ns: sorted((n["level"], n["ord"], n["content"], n["key_finding"] or "", [i["statement"] for i in n["ideas"] or []]) for n in ns)
    assert sorted(map(shape, trees.values())) == sorted(shape(g["nodes"]) for g in grown if g["nodes"])
    asked = len(os.listdir(folder)) - calls_of_loop
    assert asked == calls_of_loop + 1 and first < asked  # the failed one twice, no other
    nodes()
    assert len(os.listdir(folder)) == asked + calls_of_loop


def test_rows_of_one_key_and_of_none_are_trees_of_their_own(spark):
    docs = spark.createDataFrame([(1, "one " * 100), (1, "two " * 100), (None, "three " * 100), (1, "one " * 100)], "id long, text string")
    built = Tr.build(Tr.leaf_nodes(docs, "id", "text", 150), 200).persist()
    assert built.select("tree").distinct().count() == 4
    for n in built.where("level = 0").collect():
        word = n["content"].split()[0]
        assert set(n["content"].split()) == {word}
    roots = built.where("parent IS NULL")
    assert sorted((r["paper"] or 0, r["content"].split()[0]) for r in roots.collect()) == [(0, "three"), (1, "one"), (1, "one"), (1, "two")]
    assert Tr.totals(built).count() == 4 and Tr.outline_text(built).count() == 4
    assert Tr.build(Tr.leaf_nodes(docs.limit(0), "id", "text")).count() == 0


def test_only_new_texts_are_embedded_and_models_never_meet(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    where, folder = f"{tmp_path}/vectors", str(calls)
    made = lambda rows, name="m": {r["i"]: r["vec"] for r in embedded_by(spark.createDataFrame(rows, "i int, text string"), "text", lambda: Scripted(folder), Replies(spark, where, name, "array<double>", 1)).collect()}
    assert made([(1, "a"), (2, "bb"), (3, "a"), (4, None)]) == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 4: None}
    n = len(os.listdir(folder))
    assert made([(5, "bb"), (6, "a")]) == {5: [2.0, 1.0], 6: [1.0, 1.0]} and len(os.listdir(folder)) == n
    assert made([(7, "ccc")]) == {7: [3.0, 1.0]} and len(os.listdir(folder)) == n + 1
    assert made([(8, "a")], "other") == {8: [1.0, 1.0]} and len(os.listdir(folder)) == n + 2


def test_vectors_of_a_server_come_in_order_of_their_index(monkeypatch):
    class Reply:
        status_code = 200

        def json(self):
            return {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}

    asked = []
    model = models.HttpModel("http://x", "c", "e", post=lambda url, json, headers, timeout: asked.append(json) or Reply())
    assert model.embed_all(["a", "b"]) == [[1.0], [2.0]] and asked[0]["input"] == ["a", "b"]
    with pytest.raises(models.ModelError):
        model.embed_all(["a"])

    class Sentences:
        def encode(self, texts, normalize_embeddings):
            import numpy as np

            return np.array([[len(t), normalize_embeddings] for t in texts], float)

    monkeypatch.setattr(models, "in_process", lambda name: {"tiny": Sentences()}[name])
    assert models.HttpModel("http://x", "c", "local:tiny", post=None or (lambda **k: 1 / 0)).embed("abc") == [3.0, 1.0]
    assert json.dumps(models.OfflineModel().embed("a b")).count(",") == 127
