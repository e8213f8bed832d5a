"""Folders of JSON files as tables of a vault."""

import json

import pytest

from loomgraph.operators.store import Vault
from loomgraph.sources import vault_folder


def put(path, what):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(what if isinstance(what, str) else json.dumps(what, indent=2))


def lay(at, index):
    put(at / "papers/7/paper.json", {"pmid": "7", "title": "Seven", "year": 2001, "mesh": ["Rats"], "ideas": [{"slug": "s-b", "relation": "uses"}, {"slug": "s-a", "relation": "supports"}, {"slug": "s-b", "relation": "extends"}], "more": {"x": 1}})
    put(at / "papers/local+x 1/paper.json", {"title": None, "source": "x.txt"})
    put(at / "ideas/s-a/idea.json", {"slug": "s-a", "statement": "A", "type": "method", "domain": "d", "level": 2, "entities": ["E"], "papers": [{"pmid": "7", "relation": "supports"}, {"pmid": "8", "relation": "uses"}], "edges": [{"relation": "part_of", "target": "s-b", "note": "why"}, {"relation": "part_of", "target": "s-b", "note": "again"}]})
    put(at / "ideas/s-b/idea.json", {"slug": "s-b", "statement": "B", "type": "finding", "domain": "d"})
    put(at / "index/embeddings.json", index)


VECTORS = {"idea:s-a": [1.0, 0.0], "paper:7": [0, 1], "topic:a:b": []}


@pytest.mark.parametrize(("index", "model"), [({"model": "m", "vectors": VECTORS}, "m"), (VECTORS, None), ({"vectors": VECTORS}, None)])
def test_folder_becomes_a_vault(spark, tmp_path, index, model):
    lay(tmp_path / "old", index)
    vault = Vault(spark, f"file://{tmp_path}/new", "main")
    vault.adopt(vault_folder.tables(spark, f"file://{tmp_path}/old"))
    paper = {r["pmid"]: r for r in vault.read("papers").collect()}
    assert set(paper) == {"7", "local+x 1"} and paper["7"]["year"] == "2001" and paper["7"]["mesh"] == ["Rats"] and paper["local+x 1"]["mesh"] == []
    idea = {r["slug"]: tuple(r)[1:] for r in vault.read("ideas").collect()}
    assert idea == {"s-a": ("A", "method", "d", 2, ["E"]), "s-b": ("B", "finding", "d", 0, [])}
    assert [tuple(r)[:3] for r in vault.read("links").orderBy("seq").collect()] == [("7", "s-b", "uses"), ("7", "s-a", "supports"), ("8", "s-a", "uses")]
    assert [tuple(r) for r in vault.read("edges").collect()] == [("s-a", "s-b", "part_of", "why", 0)]
    assert {(r["kind"], r["id"], tuple(r["vec"]), r["model"]) for r in vault.read("vectors").collect()} == {("idea", "s-a", (1.0, 0.0), model), ("paper", "7", (0.0, 1.0), model), ("topic", "a:b", (), model)}
    vault.adopt(vault_folder.tables(spark, f"file://{tmp_path}/old"))
    vault.compact()
    assert vault.read("links").count() == 3 and vault.vector("paper", "7") == [0.0, 1.0]


def test_absent_and_broken_folders(spark, tmp_path):
    assert all(df.count() == 0 for df in vault_folder.tables(spark, f"file://{tmp_path}/none").values())
    put(tmp_path / "bad/papers/1/paper.json", "{no json")
    with pytest.raises(Exception, match="(?i)malformed"):
        vault_folder.tables(spark, f"file://{tmp_path}/bad")["papers"].collect()


def test_older_single_vault_is_taken_as_main(spark, tmp_path, monkeypatch, capsys):
    from loomgraph import cli

    monkeypatch.chdir(tmp_path)
    lay(tmp_path / "vault", VECTORS)
    assert cli.main(["ideas"]) == 0
    assert "A" in capsys.readouterr().out and Vault(spark, f"{tmp_path}/vaults", "main").read("ideas").count() == 2
