"""Behaviours of the graph engine on small literal tables."""

import datetime
import io
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph import agent, config, models
from loomgraph.functions import text as T
from loomgraph.operators import edges as E
from loomgraph.operators import ideas as I
from loomgraph.operators import store as S
from loomgraph.operators import tree as Tr
from loomgraph.operators.frontier import Frontier
from loomgraph.operators.similarity import knn_join
from loomgraph.sources import files, literature


def unit(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def test_knn_ranks_and_blocks(spark):
    v = spark.createDataFrame([(i, unit(i * 7), i % 3) for i in range(60)], "id long, vec array<double>, domain int")
    one, many = (sorted(map(tuple, knn_join(v, v, 4, 0.5, block=b).collect())) for b in (4096, 7))
    assert one == many and max(r[2] for r in one) == 4
    assert all(r[1] < r[0] for r in knn_join(v, v, None, 0.9, earlier=True).collect())
    assert knn_join(v.limit(0), v, 3).count() == 0


def test_orientation_by_level_not_order(spark):
    for new, old in ((0, 2), (2, 0)):
        a, b = E.oriented(F.lit("new"), F.lit("old"), F.lit("part_of"), F.lit(new), F.lit(old))
        got = spark.range(1).select(a, b).first()
        assert tuple(got) == (("new", "old") if new < old else ("old", "new"))


def test_mirrors(spark):
    rows = [("a", "b", "part_of", "", 1), ("a", "b", "part_of", "", 2), ("b", "a", "causes", "", 3), ("a", "a", "causes", "", 4), ("c", "d", "analogous_to", "", 5)]
    got = {(r["source"], r["target"], r["relation"], r["mirror"]) for r in E.with_mirrors(spark.createDataFrame(rows, "source string, target string, relation string, note string, seq long")).collect()}
    assert got == {("a", "b", "part_of", False), ("b", "a", "related_to", True), ("b", "a", "causes", False), ("c", "d", "analogous_to", False), ("d", "c", "analogous_to", True)}


def test_decisions_and_fold_agree(spark):
    s = ["The quick brown fox jumps over the lazy dog near the river bank", "the quick brown fox jumps over the lazy dog near the river bank", "The quick brown fox jumps over the lazy cat near the river bank", "Something entirely different about protein folding in yeast cells today"]
    ideas = spark.createDataFrame([(i, "v", x, i % 2) for i, x in enumerate(s)], "id long, vault string, statement string, level int")

    def decide(idea, ranked):
        for c, score, made in ranked:
            if score >= 0.8 and made["statement"].lower() == idea["statement"].lower():
                return {"decision": "merge", "target": c}
        for c, _, made in ranked:
            if made["level"] != idea["level"]:
                return {"decision": "link", "target": c, "relation": "part_of"}
        return {"decision": "link", "target": ranked[0][0], "relation": "related_to"}

    one = {tuple(r) for r in I.decisions(ideas).collect()}
    two = {tuple(r)[1:] for r in I.fold_decisions(ideas, decide).collect()}
    assert one == two
    assert {r[1] for r in one} == {"new", "merge", "link"}


def test_guard(spark):
    ranked = F.array(F.struct(F.lit("x").alias("slug"), F.lit(0.7).alias("score")), F.struct(F.lit("y").alias("slug"), F.lit(0.9).alias("score")))
    told = lambda d, t: spark.range(1).select(I.guarded(F.lit(d), F.lit(t), ranked, 0.8)).first()[0]
    assert (told("merge", "y"), told("merge", "x"), told("merge", "z"), told("what", "y")) == ("merge", "link", "new", "new")
    shown = {"x": 0.7, "y": 0.9}
    for d in ("merge", "link", "new", "what", None):
        for t in ("x", "y", "z", None):
            decision, target = I.guard(d, t, shown, 0.8)
            assert decision == told(d, t) and target == (t if decision != "new" else None)
    assert I.default_link(0.8) == 0.62 and I.default_link(0.6) == 0.5


def test_leaves_stay_within_the_limit(spark):
    texts = ["word " * 2000, "x" * 5000, "\n\n".join("p" * k for k in range(1, 400, 7)), "", "  \n\n ", "short"]
    rows = Tr.leaf_nodes(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", 1200).collect()
    assert max(len(r["content"]) for r in rows) <= 1200
    for i, t in enumerate(texts):
        assert "".join("".join(r["content"] for r in rows if r["paper"] == i).split()) == "".join(t.split())


def test_tree_levels(spark):
    text = "\n\n".join(f"Sentence number {i} of a long text that has to be condensed. It goes on." for i in range(120))
    docs = spark.createDataFrame([(1, text), (2, "One. Two."), (3, "")], "id long, text string")
    nodes = Tr.build(Tr.leaf_nodes(docs, "id", "text", 300), 900).persist()
    by = {p: [r for r in nodes.collect() if r["paper"] == p] for p in (1, 2, 3)}
    assert max(r["level"] for r in by[1]) >= 2 and len(by[2]) == 2 and not by[3]
    for p in (1, 2):
        roots = [r for r in by[p] if r["parent"] is None]
        assert len(roots) == 1 and roots[0]["level"] == max(r["level"] for r in by[p])
        for r in by[p]:
            assert r["parent"] is None or any(q["level"] == r["level"] + 1 and q["ord"] == r["parent"] for q in by[p])
    assert Tr.outline(nodes).where("paper = 1").count() == len(by[1])
    total = {r["paper"]: r for r in Tr.totals(nodes).collect()}
    assert total[1]["n_leaves"] == sum(r["level"] == 0 for r in by[1]) and total[1]["key_finding"]


@pytest.mark.parametrize("mode", ["depth", "breadth"])
def test_frontier_equals_a_list(mode):
    """Random pushes and pops against a list that is searched for the best score, the queue written and read in between."""
    alpha, beta = {"depth": (1.0, 0.15), "breadth": (0.55, 1.0)}[mode]
    rng, q, waiting, ever, met = random.Random(mode), Frontier(mode), [], set(), set()
    for turn in range(400):
        if rng.random() < 0.6:
            kind, ident, near = rng.choice(["query", "paper", "idea"]), str(rng.randrange(90)), rng.choice([0, 0.25, 0.5, 0.75, 1])
            fields = rng.sample(["Soil", "soil", "Metal", "Light", "Tide"], rng.randrange(4))
            q.push(kind, ident, near, fields, "why")
            if (kind, ident) not in ever:
                new = sum(f.lower() not in met for f in fields) / len(fields) if fields else 0.5
                waiting.append((-round(alpha * near + beta * new, 4), len(ever), kind, ident, fields))
                ever.add((kind, ident))
        else:
            best = min(waiting, default=None)
            got = q.pop()
            assert (got and (got["kind"], got["id"])) == (best and best[2:4])
            if best:
                waiting.remove(best)
                met |= {f.lower() for f in best[4]}
        if turn % 50 == 49:
            q = Frontier(mode, json.loads(json.dumps(q.state())))
        assert len(q) == len(waiting)


def test_frontier_ties_and_visited():
    q = Frontier("depth")
    for i in "abc":
        q.push("idea", i, 0.5, [], "")
    assert [q.pop()["id"] for _ in range(3)] == ["a", "b", "c"] and q.pop() is None
    again = Frontier("depth", json.loads(json.dumps(q.state())))
    again.push("idea", "a", 1, [], "")
    assert again.pop() is None


def test_vault(spark, tmp_path):
    v = S.Vault(spark, str(tmp_path), "main")
    assert v.read("ideas").count() == 0
    row = lambda s, t: (s, t, "finding", "d", 0, ["A"])
    v.create_ideas(spark.createDataFrame([row("a", "one"), row("b", "two")], v.read("ideas").schema))
    v.create_ideas(spark.createDataFrame([row("a", "changed"), row("c", "three")], v.read("ideas").schema))
    assert {(r["slug"], r["statement"]) for r in v.read("ideas").collect()} == {("a", "one"), ("b", "two"), ("c", "three")}
    v.upsert("ideas", spark.createDataFrame([row("b", "new")], v.read("ideas").schema))
    assert v.point("ideas", slug="b").first()["statement"] == "new" and v.keys("ideas").count() == 3
    v.upsert("vectors", spark.createDataFrame([("idea", "a", [1.0], "m1")], v.read("vectors").schema))
    with pytest.raises(ValueError):
        v.vectors("idea", "m2")
    assert v.vector("idea", "a") == [1.0] and v.vector("idea", "z") is None
    assert v.table("ideas").snapshots() == [1, 2, 3]
    papers = spark.createDataFrame([("p", "Title", "Abs", "J", "2020", ["M"], "", "")], v.read("papers").schema)
    links = spark.createDataFrame([("p", "a", "supports", 1), ("p", "gone", "uses", 2)], v.read("links").schema)
    edges = spark.createDataFrame([("a", "b", "part_of", "why", 1), ("a", "gone", "causes", "", 2)], v.read("edges").schema)
    assert "- supports: one" in S.paper_view(papers, links, v.read("ideas")).first()["markdown"]
    page = S.idea_view(v.read("ideas"), links, papers, edges).where("slug = 'a'").first()["markdown"]
    assert "- part_of: new — why" in page and "gone" not in page and "- supports: Title" in page


def test_files(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>part</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "b.txt").write_text("Plain note")
    (tmp_path / "c.md").write_text("Plain note")
    (tmp_path / "d.xyz").write_text("?")
    rows = {r["title"]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a"]["abstract"] == "First part\n\nSecond" and rows["b"]["abstract"] == "Plain note" and "c" not in rows
    assert "no reader" in rows["d.xyz"]["error"] and rows["b"]["pmid"] == files.document_id(b"Plain note")


RECORD = """<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>2019</Year></PubDate></JournalIssue></Journal>
<ArticleTitle>A <i>title</i> here</ArticleTitle><Abstract><AbstractText Label="AIM">Do things.</AbstractText><AbstractText>More.</AbstractText></Abstract></Article>
<MeshHeadingList><MeshHeading><DescriptorName>Mice</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle><PubmedArticle/></Set>"""
BODY = """<article xmlns="x"><body><sec><title>Introduction</title><p>One <b>bold</b>\n two.</p><sec><p>Inherits.</p></sec><sec><title>Deep</title><p>Three</p><p> </p></sec></sec><p>Loose</p></body></article>"""


def test_records_and_bodies(spark):
    assert literature.parse_records(RECORD) == [("7", "A title here", "AIM: Do things.\nMore.", "J", "2019", ["Mice"])]
    want = [("Introduction", "One bold two."), ("Introduction", "Inherits."), ("Deep", "Three"), ("", "Loose")]
    assert literature.parse_body(BODY) == want
    df = spark.createDataFrame([(1, BODY), (2, "<broken"), (3, None)], "id long, xml string")
    got = literature.bodies(df, "id", "xml")
    assert [(r["section"], r["text"]) for r in got.orderBy("ord").collect()] == want
    assert files.fulltext_markdown(got, "id").first()["markdown"] == "## Introduction\n\nOne bold two.\n\nInherits.\n\n## Deep\n\nThree\n\nLoose"
    assert literature.records(spark.createDataFrame([(RECORD,), ("x",)], "r string"), "r").count() == 1


class Reply:
    def __init__(self, status, body):
        self.status_code, self.body, self.content = status, body, body.encode() if isinstance(body, str) else b""

    def json(self):
        return self.body

    def raise_for_status(self):
        pass


def test_client_is_paced():
    seen = []

    def get(url, params, timeout):
        seen.append((url, params))
        return Reply(200, {"esearchresult": {"idlist": ["1", "2"]}}) if "esearch" in url else Reply(200, RECORD)

    c = literature.Client("http://x", email="e", key="k", get=get)
    assert c.search("t") == ["1", "2"] and c.fetch([]) == [] and c.fetch(["7"])[0][0] == "7"
    assert seen[0][1]["api_key"] == "k" and len(seen) == 2


def test_replies():
    assert json.loads(models.balanced_json('noise {"a": {"b": "}"}} tail {')) == {"a": {"b": "}"}}
    for bad in ("none", "{ open"):
        with pytest.raises(models.ModelError):
            models.balanced_json(bad)
    asked = []

    def post(url, json, headers, timeout):
        asked.append(json.get("response_format", {}).get("type"))
        return Reply(400, {}) if len(asked) < 3 else Reply(200, {"choices": [{"message": {"content": 'ok {"x": 1}'}}]})

    assert models.HttpModel("http://x", "m", post=post).chat_json("s", "u", {"title": "t"}) == {"x": 1}
    assert asked == ["json_schema", "json_object", None]


def test_config(tmp_path):
    (tmp_path / ".env").write_text("LOOMGRAPH_LLM_CHAT_MODEL=a\nLOOMGRAPH_MERGE_THRESHOLD='0.9'\n")
    c = config.load(str(tmp_path / ".env"), {"LOOMGRAPH_LLM_CHAT_MODEL": "b", "LOOMGRAPH_TREE": '{"leaf_chars": 9}', "LOOMGRAPH_LLM_API_KEY": ""})
    assert (c["llm"]["chat_model"], c["merge_threshold"], c["tree"]["leaf_chars"], c["tree"]["group_chars"]) == ("b", 0.9, 9, 3500)


def test_runs():
    day = datetime.date(2024, 5, 6)
    name = agent.run_name("a topic", "depth", day)
    runs = [{"name": name + s, "topic": "a topic", "mode": "depth"} for s in ("", "-2", "-10")]
    assert agent.select_run(runs, "a topic", "depth", True, day) == name + "-10"
    assert agent.select_run(runs[:2], "a topic", "depth", False, day) == name + "-3"
    assert agent.select_run([], "a topic", "depth", None, day) == agent.select_run([], "a topic", "depth", True, day) == name


def test_research_shares_an_idea(spark, tmp_path):
    shared = "Glutathione depletion drives a lethal iron dependent process in many kinds of cells."
    papers = {p: {"title": p, "abstract": f"{shared} {x}", "mesh": ["Iron"]} for p, x in (("1", "More on A."), ("2", "Else on B."))}
    out = agent.explore("iron", "depth", lambda t: list(papers), papers.get, budget=5)
    assert out["reads"] == 2 and len(out["memory"].ideas) == 1 and len(out["memory"].links) == 2
    assert not agent.Research("iron", "depth", None, None, state=out["state"]).queue.fresh
    vault = S.Vault(spark, str(tmp_path), "v")
    out["memory"].save(vault)
    assert vault.read("links").count() == 2
    path = agent.write_report(str(tmp_path / "run"), "iron", out["findings"], ["why iron"])
    text = open(path).read()
    assert text.startswith("# Iron") and "/1/" in text and "## Open questions" in text

    class Broken(models.OfflineModel):
        def section(self, *asked):
            raise models.ModelError("down")

    assert agent.write_report(str(tmp_path / "run"), "iron", out["findings"], ["q"], Broken()).endswith("report.failed.md")
    assert open(path).read() == text
    again = agent.Memory.load(vault)
    assert again.ideas == out["memory"].ideas and again.links == out["memory"].links and again.done == {"1", "2"}


def scripted(calls):
    """post() of a server that answers each task with JSON."""

    def post(url, json, headers, timeout):
        if url.endswith("embeddings"):
            return Reply(200, {"data": [{"embedding": models.OfflineModel().embed(json["input"])}]})
        user = json["messages"][1]["content"]
        task = json.get("response_format", {}).get("json_schema", {}).get("name", "text")
        calls.append((task, user))
        claim = {"statement": f"Claim number {len(calls)} on cells.", "type": "method", "relation_to_paper": "uses", "domain": "Biology", "entities": ["ABC", 3]}
        told = {
            "extract": {"key_finding": "Found.", "ideas": [claim, {"statement": " "}, {"statement": "x", "type": "?"}]},
            "condense": {"summary": "Short.", "key_finding": "", "ideas": [claim]},
            "adjudicate": {"decision": "merge", "target": "no such idea"},
            "reflect": {"assessment": "", "gaps": [], "queries": ["more cells"], "done": len(calls) > 30},
            "questions": {"questions": ["Why?", " ", "How?"]},
        }.get(task)
        return Reply(200, {"choices": [{"message": {"content": __import__("json").dumps(told) if told else "Body [PMID 1].\n\n## Open questions\n\n- One"}}]})

    return post


def test_research_with_a_model_over_http(tmp_path):
    calls = []
    model = models.HttpModel("http://x", "m", "e", post=scripted(calls))
    papers = {"1": {"title": "One", "abstract": "Text.", "mesh": []}, "2": {"title": "Two", "abstract": "", "mesh": []}}
    bodies = {"2": [("", "First. " * 30), ("S", "Second. " * 30), ("S", "Third. " * 30)]}
    asked = []

    def search(term, n):
        asked.append((term, n))
        return ["1", "2"]

    settings = config.load(None, {"LOOMGRAPH_LITERATURE_EXPAND_RESULTS": "3", "LOOMGRAPH_REFLECT_EVERY": "1"})
    desk = agent.Research("cells", "breadth", search, papers.get, model, body=bodies.get, settings=settings)
    out = desk.run(9, inputs=[("local-1", "mine", "A note of the user. " * 90)])
    assert out["reads"] == 2 and ("cells", 20) in asked and ("more cells", 3) in asked
    kinds = {k for k, _ in calls}
    assert {"extract", "condense", "reflect"} <= kinds and out["memory"].papers["2"]["summary"] == "Short."
    assert {i["domain"] for i in out["memory"].ideas.values()} == {"biology", "general"}
    assert {i["type"] for i in out["memory"].ideas.values()} == {"method", "finding"}
    assert any(e["reason"] == "given: mine" and e["relevance"] >= 0.9 for e in out["state"]["entries"])
    path = agent.write_report(str(tmp_path), "cells", out["findings"], None, model, out["memory"])
    text = open(path).read()
    assert "## Why?" in text and "## How?" in text and "Nearest ideas:\n- " in calls[-2][1] and text.count("/1/") == 1


def test_runs_are_resumed(spark, tmp_path, monkeypatch, capsys):
    from loomgraph import cli

    papers = {p: {"pmid": p, "title": p, "abstract": f"Paper {p} describes one long and separate claim about its own subject here.", "mesh": []} for p in "12345"}
    vault, settings = S.Vault(spark, str(tmp_path), "v"), config.load(None, {})
    call = lambda *a: cli.research(cli.parser().parse_args(["research", "topic", *a]), settings, spark, vault, lambda t, n: sorted(papers), papers.get, None, f"{tmp_path}/v/runs")
    call("--budget", "2")
    assert vault.read("findings").count() == 2
    call("--budget", "2", "--resume")
    runs = agent.Run.all(f"{tmp_path}/v/runs")
    assert len(runs) == 1 and vault.read("findings").count() == 4 and vault.read("links").count() == 4
    assert "1/2 paper" in open(f"{tmp_path}/v/runs/{runs[0]['name']}/log.md").read()
    call("--budget", "1", "--new")
    assert [r["name"].endswith("-2") for r in agent.Run.all(f"{tmp_path}/v/runs")] == [False, True]


def test_ingested_documents_become_trees_and_ideas(spark, tmp_path, monkeypatch):
    from loomgraph import cli

    monkeypatch.chdir(tmp_path)
    (tmp_path / "note.txt").write_text("\n\n".join(f"Part {k} of the note states a claim that is long enough to be an idea of its own. And more." for k in range(60)))
    (tmp_path / "bad.xyz").write_text("?")
    assert cli.main(["--vault", "v", "ingest", str(tmp_path / "note.txt"), str(tmp_path / "bad.xyz")]) == 1
    vault = S.Vault(spark, str(tmp_path / "vaults"), "v")
    assert vault.read("papers").first()["summary"] and {r["level"] for r in vault.read("ideas").collect()} >= {1, 2}
    assert vault.read("edges").where("relation = 'part_of'").count() > 0
    n = vault.read("links").count()
    assert cli.main(["--vault", "v", "ingest", str(tmp_path / "note.txt")]) == 0 and vault.read("links").count() == n


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.slugify(F.lit("Hello, big-World of\nwords and many more"))).startswith("hello-bigworld-ofwords-and-many-more-")
    assert one(T.questions(F.lit(" a, b and c."))) == ["a", "b", "c"] and one(T.questions(F.lit(","))) == [","]
    assert one(T.html_escape(F.lit('<a href="x">&'))) == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert one(T.acronyms(F.lit("The DNA and RNA2 of a PD mouse"))) == ["DNA", "RNA2"]


def test_extraction_by_a_model_as_columns(spark):
    def make():
        class Told:
            def __init__(self, status_code, content):
                self.status_code, self.content = status_code, content

            def json(self):
                return {"choices": [{"message": {"content": self.content}}]}

        def post(url, json, headers, timeout):
            title = json["messages"][1]["content"].split("\n")[0]
            told = {"key_finding": f" {title} ", "ideas": [{"statement": title, "type": "x", "relation_to_paper": "uses", "domain": " A ", "entities": ["E"]}]}
            return Told(200 if "bad" not in title else 500, __import__("json").dumps(told))

        return models.HttpModel("http://x", "m", post=post)

    papers = spark.createDataFrame([("1", "T", "J", "", ["M"], "text"), ("2", "bad", "", "", [], "text"), ("3", "U", "", "", [], "")], "pmid string, title string, journal string, year string, mesh array<string>, abstract string")
    rows = {r["pmid"]: r for r in I.extracted(papers, make).collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["key_finding"] == "Title: T" and rows["2"]["i"] is None
    assert rows["1"]["i"].asDict() == {"statement": "Title: T", "type": "finding", "relation": "uses", "domain": "a", "entities": ["E"]}
