"""Searches are asked by every row."""

import pytest

from loomgraph.operators import edges as E
from loomgraph.operators import graph as G
from loomgraph.operators import ideas as I
from loomgraph.operators import similarity
from loomgraph.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["cosine_topk", "int8_topk"])
def test_every_vector_asks(spark, name):
    asked = {r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = catalog.QUERIES[name](spark, SF).collect()
    assert {r["query"] for r in got} == asked and len(got) == 5 * len(asked)
    assert "%" not in catalog.ORACLES[name]


def test_every_idea_asks_and_pairs_are_left_out_of_packed_matrices(spark, monkeypatch):
    ideas = {r["id"] for r in I.first_wordings(catalog._ideas(spark, SF)).where("id = canon").collect()}
    linked = {tuple(r) for r in E.neighbours(catalog._edges(spark, SF)).collect()}
    few = {tuple(r) for r in catalog.QUERIES["similar_unlinked"](spark, SF).collect()}
    assert {r[0] for r in few} == ideas and not {r[:2] for r in few} & linked
    assert "% 100" not in catalog.ORACLES["similar_unlinked"]
    whole = similarity.knn_join
    monkeypatch.setattr(G, "knn_join", lambda *a, **how: whole(*a, **how, block=16))
    monkeypatch.setattr(similarity, "FEWEST", 3)
    packed = {tuple(r) for r in catalog.QUERIES["similar_unlinked"](spark, SF).collect()}
    score = {r[:2]: r[2] for r in few}
    assert {(r[0], r[3]) for r in packed} == {(r[0], r[3]) for r in few} and not {r[:2] for r in packed} & linked
    assert all(score[r[:2]] == r[2] for r in packed if r[:2] in score) and len(packed & few) > 0.99 * len(few)
