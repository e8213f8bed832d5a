"""Commands: research, ingest, ideas, vaults, graph, pdf."""

from __future__ import annotations

import argparse
import os
import re
import sys

from loomgraph import agent, config
from loomgraph.models import make_model


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--vault", default="main")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("research")
    r.add_argument("topic")
    r.add_argument("--mode", choices=("depth", "breadth"), default="depth")
    r.add_argument("--budget", type=int, default=50)
    r.add_argument("--seed-idea", action="append", default=[])
    r.add_argument("--input", action="append", default=[], help="a document of your own to start from")
    g = r.add_mutually_exclusive_group()
    g.add_argument("--resume", action="store_true")
    g.add_argument("--new", action="store_true")
    i = sub.add_parser("ingest")
    i.add_argument("files", nargs="+")
    sub.add_parser("ideas")
    sub.add_parser("vaults")
    v = sub.add_parser("graph")
    v.add_argument("-o", "--out", default="graph.html")
    v.add_argument("--title", default="Ideas")
    f = sub.add_parser("pdf")
    f.add_argument("report", help="a Markdown report")
    return p


def documents(spark, vault, paths: list[str], complain) -> list[tuple[str, str, str]]:
    """(id, name, text) of the readable documents at paths; complain(name, error) of the others."""
    from loomgraph.sources.files import read_documents

    out = []
    for path in paths:
        for r in read_documents(spark, path).toLocalIterator():
            if r["error"] is None and (r["abstract"] or "").strip():
                out.append((r["pmid"], r["title"], r["abstract"]))
            else:
                complain(r["source"], r["error"] or "no text")
    return out


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from loomgraph.operators.store import Vault
    from loomgraph.sources import vault_folder

    args = parser().parse_args(argv)
    if args.command == "pdf":
        try:
            print(agent.render_pdf(args.report))
        except (ImportError, OSError) as e:
            print(f"no PDF: {e}", file=sys.stderr)
            return 1
        return 0
    settings = config.load(".env")
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    root = os.path.abspath(settings["vaults"])
    vault = Vault(spark, root, args.vault)
    if args.vault == "main" and not os.path.exists(vault.path) and os.path.isdir("vault"):  # the older layout's only vault
        vault.adopt(vault_folder.tables(spark, "file://" + os.path.abspath("vault")))
    bad: list[str] = []

    def complain(name: str, error: str) -> None:
        bad.append(name)
        print(f"{name}: {error}", file=sys.stderr)

    if args.command == "ingest":
        model = make_model(settings)
        memory = agent.Memory.load(vault, model.vectors)
        desk = agent.Research("", "depth", lambda t, n: [], lambda p: None, model, memory, settings=settings, log=print)
        for pmid, name, text in documents(spark, vault, args.files, complain):
            known = pmid in memory.done
            list(desk.seeds(inputs=[(pmid, name, text)]))
            print(f"{name}: {'known' if known else 'read'}, {len(memory.of.get(pmid, ()))} ideas")
        memory.save(vault)
        return int(bool(bad))
    if args.command == "ideas":
        n = vault.read("links").groupBy("slug").agg(F.count("*").alias("papers"))
        for r in vault.read("ideas").join(n, "slug", "left").orderBy(F.desc("papers"), F.desc("statement"), F.desc("slug")).toLocalIterator():
            print(f"{r['papers'] or 0:4d}  {r['statement']}  [{r['slug']}]")
        return 0
    if args.command == "vaults":
        for name in sorted(os.listdir(root)) if os.path.isdir(root) else []:
            v = Vault(spark, root, name)
            print(f"{'*' if name == args.vault else ' '} {name}: {v.read('papers').count()} papers, {v.read('ideas').count()} ideas")
        return 0
    if args.command == "graph":
        ideas = vault.read("ideas")
        if ideas.isEmpty():
            print("the vault is empty", file=sys.stderr)
            return 1
        page = agent.graph_page(ideas, vault.read("edges"), "<!DOCTYPE html><title>__TITLE__</title><script>const graph = __DATA__;</script>", args.title)
        with open(args.out, "w") as f:
            f.write(page)
        return 0
    from loomgraph.sources.literature import Client

    client = Client(settings["literature"]["base_url"], settings["literature"]["email"], settings["literature"]["key"])
    keys = ("pmid", "title", "abstract", "journal", "year", "mesh")
    fetch = lambda pmid: next((dict(zip(keys, r, strict=True)) for r in client.fetch([pmid])), None)
    return research(args, settings, spark, vault, client.search, fetch, client.fulltext, f"{root}/{args.vault}/runs", complain)


def research(args, settings: dict, spark, vault, search, fetch, body, runs: str, complain=lambda name, error: None) -> int:
    """A run, new or resumed: the vault's graph is loaded, explored and saved, findings and frontier are kept, a report is written."""
    from pyspark.sql import functions as F

    model = make_model(settings)
    name = agent.select_run(agent.Run.all(runs), args.topic, args.mode, True if args.resume else False if args.new else None)
    run = agent.Run(runs, name, args.topic, args.mode)

    def log(message: str) -> None:
        print(message)
        run.log(message)

    memory = agent.Memory.load(vault, model.vectors)
    old = [r["finding"] for r in vault.read("findings").where(F.col("run") == name).orderBy("seq").toLocalIterator()]
    full = body if settings["literature"]["full_text"] else None
    desk = agent.Research(args.topic, args.mode, search, fetch, model, memory, run.state, full, old, settings, log)
    out = desk.run(args.budget, args.seed_idea, documents(spark, vault, args.input, complain), run.save)
    memory.save(vault)
    if out["findings"]:
        cited = [(name, k, f, re.findall(r"\[PMID ([^\]]+)\]", f), "") for k, f in enumerate(out["findings"])]
        vault.upsert("findings", spark.createDataFrame(cited, vault.read("findings").schema))
    log(f"{out['reads']} papers read over {out['pops']} steps")
    print(agent.write_report(run.path, args.topic, out["findings"], None, model, memory, args.mode))
    return 0


if __name__ == "__main__":
    sys.exit(main())
