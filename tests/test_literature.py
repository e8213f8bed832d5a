"""The literature source, in batch and as a stream, against a server of the test's own."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from loomgraph.sources import literature as L

ENTERED = {f"{1000 + k}": f"2024/01/{1 + k // 4:02d}" for k in range(12)}  # four a day


@pytest.fixture
def server(spark):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            name = url.path.rpartition("/")[2].removesuffix(".fcgi")
            seen.append((name, q))
            if name == "esearch":
                ids = [i for i, day in ENTERED.items() if "mindate" not in q or q["mindate"] <= day <= q["maxdate"]]
                at = int(q.get("retstart", 0))
                body = json.dumps({"esearchresult": {"count": str(len(ids)), "idlist": ids[at : at + min(3, int(q["retmax"])) if "mindate" in q else int(q["retmax"])]}})
            elif name == "elink":
                linksets = [{"linksetdbs": [{"links": ["9"]}]}] if q["id"] == "1001" else []
                body = json.dumps({"linksets": linksets})
            elif q["db"] == "pmc":
                body = "<article><body><sec><title>Aim</title><p>One.</p><p>Two.</p></sec></body></article>"
            else:
                body = "<S>" + "".join(f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>T{i}</ArticleTitle></Article></MedlineCitation></PubmedArticle>" for i in reversed(q["id"].split(","))) + "</S>"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    L.register(spark)
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_batch_read(spark, server, monkeypatch):
    base, seen = server
    read = lambda: spark.read.format("literature").option("base", base).option("key", "k")
    got = read().option("term", "iron").option("retmax", 7).load()
    assert [(r["term"], r["rank"], r["pmid"], r["title"]) for r in got.orderBy("rank").collect()] == [("iron", k, f"{1000 + k}", f"T{1000 + k}") for k in range(7)]
    assert [len(s.items) for s in L._shares(list(range(500)), 3, 200)] == [167, 167, 166] and len(L._shares([1], 3, 200)) == 1
    seen.clear()
    some = read().load().where("pmid IN ('1003', '1005')")
    assert sorted(r["pmid"] for r in some.collect()) == ["1003", "1005"] and {n for n, _ in seen} == {"efetch"}
    seen.clear()
    both = read().load().where("term = 'zinc' AND pmid = '1002'")
    assert [(r["term"], r["rank"]) for r in both.collect()] == [("zinc", 2)]
    assert {q["id"] for n, q in seen if n == "efetch"} == {"1002"} and {q["term"] for n, q in seen if n == "esearch"} == {"zinc"}


def test_fulltext_joins_left(spark, server):
    base, _ = server
    records = spark.createDataFrame([("1000", "a"), ("1001", "b"), (None, "c")], "pmid string, title string")
    got = {r["title"]: r["paragraphs"] for r in L.with_fulltext(records, L.fulltexts(records, {"base": base, "key": "k"}, 1)).collect()}
    assert got["a"] is None and got["c"] is None and [tuple(p) for p in got["b"]] == [(0, "Aim", "One."), (1, "Aim", "Two.")]


def test_stream_reads_each_day_once(spark, server, tmp_path):
    base, seen = server

    def run(until):
        s = spark.readStream.format("literature").options(base=base, key="k", term="iron", start="2024-01-01", until=until).load()
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return Counter(r["pmid"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run("2024-01-02") == Counter(list(ENTERED)[:8])
    assert run("2024-01-03") == Counter(list(ENTERED))
    assert {q["mindate"] for n, q in seen if n == "esearch"} == {"2024/01/01", "2024/01/02", "2024/01/03"}
