"""Literature records: XML parsing, and a data source over an HTTP service or a local table."""

from __future__ import annotations

import datetime
import time
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

RECORD = "pmid string, title string, abstract string, journal string, year string, mesh array<string>"
#: Seconds between calls, without and with a key.
PACE = (0.35, 0.11)


def _flat(e) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def parse_records(xml: str | bytes) -> list[tuple]:
    """Records of a fetch reply; those without citation, article or id are left out."""
    out = []
    for item in ElementTree.fromstring(xml).iter("PubmedArticle"):
        cite = item.find("MedlineCitation")
        article = cite.find("Article") if cite is not None else None
        pmid = _flat(cite.find("PMID")) if cite is not None else ""
        if article is None or not pmid:
            continue
        parts = []
        for p in article.findall("Abstract/AbstractText"):
            label, text = p.get("Label"), _flat(p)
            parts.append(f"{label}: {text}" if label else text)
        date = article.find("Journal/JournalIssue/PubDate")
        year = _flat(date.find("Year")) or _flat(date.find("MedlineDate"))[:4] if date is not None else ""
        mesh = [m for m in (_flat(d) for d in cite.findall("MeshHeadingList/MeshHeading/DescriptorName")) if m]
        out.append((pmid, _flat(article.find("ArticleTitle")), "\n".join(parts), _flat(article.find("Journal/Title")), year, mesh))
    return out


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def parse_body(xml: str | bytes) -> list[tuple[str, str]]:
    """(section, text) of an article's paragraphs; a paragraph has the nearest titled section's name."""
    root = ElementTree.fromstring(xml)
    body = next((e for e in root.iter() if _local(e.tag) == "body"), None)
    out: list[tuple[str, str]] = []

    def walk(node, section: str) -> None:
        for child in node:
            if _local(child.tag) == "sec":
                title = next((_flat(t) for t in child if _local(t.tag) == "title"), "")
                walk(child, title or section)
            elif _local(child.tag) == "p" and (text := _flat(child)):
                out.append((section, text))

    if body is not None:
        walk(body, "")
    return out


def records(replies: DataFrame, column: str) -> DataFrame:
    """Records of a column of fetch replies; broken ones give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b[column]:
                try:
                    rows += parse_records(x or "")
                except ElementTree.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["pmid", "title", "abstract", "journal", "year", "mesh"])

    return replies.select(column).mapInPandas(run, RECORD)


def bodies(replies: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ord, section, text) of a column of article XML; broken ones give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, x in zip(b[key], b[column], strict=True):
                try:
                    rows += [(k, i, s, t) for i, (s, t) in enumerate(parse_body(x or ""))]
                except ElementTree.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=[key, "ord", "section", "text"])

    return replies.select(key, column).mapInPandas(run, f"{key} {replies.schema[key].dataType.simpleString()}, ord int, section string, text string")


class Client:
    """Search and fetch over HTTP, one call at a time, paced."""

    def __init__(self, base: str, email: str = "", key: str = "", get=None, sharers: int = 1):
        """sharers: so many clients work at once and divide the service's rate among them."""
        self.base, self.last, self.pace = base.rstrip("/"), 0.0, PACE[bool(key)] * sharers
        self.common = {k: v for k, v in (("email", email), ("api_key", key)) if v}
        if get is None:
            import requests

            get = requests.get
        self.get = get

    def _call(self, name: str, timeout: float, **params):
        wait = self.last + self.pace - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        self.last = time.monotonic()
        reply = self.get(f"{self.base}/{name}.fcgi", params=params | self.common, timeout=timeout)
        reply.raise_for_status()
        return reply

    def search(self, term: str, most: int = 20) -> list[str]:
        found = self._call("esearch", 60, db="pubmed", term=term, retmax=most, retmode="json", sort="relevance").json()
        return found.get("esearchresult", {}).get("idlist", [])

    def search_days(self, term: str, first: str, last: str) -> list[str]:
        """All ids that match and were entered from day first to day last, page by page."""
        out: list[str] = []
        while True:
            page = self._call("esearch", 60, db="pubmed", term=term, retmax=PAGE, retstart=len(out), retmode="json", datetype="edat", mindate=first.replace("-", "/"), maxdate=last.replace("-", "/")).json().get("esearchresult", {})
            out += (new := page.get("idlist", []))
            if not new or len(out) >= int(page.get("count", 0)):
                return out

    def fetch(self, ids: list[str]) -> list[tuple]:
        return parse_records(self._call("efetch", 120, db="pubmed", id=",".join(ids), retmode="xml").content) if ids else []

    def fulltext(self, pmid: str) -> list[tuple[str, str]] | None:
        links = self._call("elink", 60, dbfrom="pubmed", db="pmc", id=pmid, linkname="pubmed_pmc", retmode="json").json()
        ids = [i for s in links.get("linksets", []) for d in s.get("linksetdbs", []) for i in d.get("links", [])]
        return (parse_body(self._call("efetch", 120, db="pmc", id=ids[0], retmode="xml").content) or None) if ids else None


#: Ids of one fetch, and of one page of a search.
BATCH, PAGE = 200, 1000
DAY = datetime.timedelta(days=1)


class LiteratureSource(DataSource):
    """spark.read.format("literature") and readStream, over the records that match a term.

    Options: base, email, key; term, unless a filter on the column gives it; retmax (20); tasks (3): so many
    partitions work at once and share the service's rate. Filters term = and pmid = or IN are pushed
    (see register); ids without a term are fetched without a search, unranked.
    Stream: day by day of entry, from option start to the day before today or option until.
    """

    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return "term string, rank int, " + RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Days(dict(self.options))


class _Share(InputPartition):
    """One task's part: (rank, id) to fetch, or days to search."""

    def __init__(self, number: int, of: int, items: list):
        self.number, self.of, self.items = number, of, items


def _shares(items: list, tasks: int, least: int) -> list[_Share]:
    n = max(1, min(tasks, -(-len(items) // least)))
    return [_Share(i, n, items[i::n]) for i in range(n)]


class _Calls:
    def __init__(self, options: dict):
        self.options = options

    def client(self, share: _Share | None = None) -> Client:
        o = self.options
        client = Client(o["base"], o.get("email", ""), o.get("key", ""), sharers=share.of if share else 1)
        if share:  # clients of one rate begin one after another
            client.last = time.monotonic() - client.pace * (1 - share.number / share.of)
        return client

    def records(self, client: Client, ranked: list, term: str | None) -> Iterator[tuple]:
        for at in range(0, len(ranked), BATCH):
            places = {p: r for r, p in ranked[at : at + BATCH]}
            for record in client.fetch(list(places)):
                yield term, places.get(record[0]), *record


class _Reader(_Calls, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.term, self.ids = options.get("term"), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("term",) and self.term in (None, f.value):
                self.term = f.value
            elif isinstance(f, EqualTo | In) and f.attribute == ("pmid",):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = ids if self.ids is None else self.ids & ids
            else:
                yield f

    def partitions(self):
        if self.term is None and self.ids is None:
            raise ValueError("a term or ids must be given")
        found = list(enumerate(self.client().search(self.term, int(self.options.get("retmax", 20))))) if self.term is not None else [(None, i) for i in sorted(self.ids)]
        return _shares([x for x in found if self.ids is None or x[1] in self.ids], int(self.options.get("tasks", 3)), BATCH)

    def read(self, partition):
        if partition.items:
            yield from self.records(self.client(partition), partition.items, self.term)


class _Days(_Calls, DataSourceStreamReader):
    """Offsets are days: all up to and with that day were read. A day is read when it is over."""

    def initialOffset(self) -> dict:
        return {"day": str(datetime.date.fromisoformat(self.options["start"]) - DAY)}

    def latestOffset(self) -> dict:
        return {"day": self.options.get("until") or str(datetime.date.today() - DAY)}

    def partitions(self, start: dict, end: dict):
        first, last = (datetime.date.fromisoformat(x["day"]) for x in (start, end))
        days = [str(first + DAY * (k + 1)) for k in range((last - first).days)]
        return _shares(days, int(self.options.get("tasks", 3)), 1) if days else []

    def read(self, partition):
        client = self.client(partition)
        for day in partition.items:
            ids = client.search_days(self.options["term"], day, day)
            yield from self.records(client, [(None, i) for i in ids], self.options["term"])

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Make the source known to a session, which must push filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LiteratureSource)


def fulltexts(records: DataFrame, options: dict, tasks: int = 3, get=None) -> DataFrame:
    """(pmid, ord, section, text) of the articles that have one; tasks share the service's rate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = Client(options["base"], options.get("email", ""), options.get("key", ""), get, tasks)
        for b in batches:
            rows = [(p, i, s, t) for p in b["pmid"] for i, (s, t) in enumerate(client.fulltext(p) or [])]
            yield pd.DataFrame(rows, columns=["pmid", "ord", "section", "text"])

    return records.where("pmid IS NOT NULL").select("pmid").distinct().repartition(tasks, "pmid").mapInPandas(run, "pmid string, ord int, section string, text string")


def with_fulltext(records: DataFrame, texts: DataFrame) -> DataFrame:
    """records with paragraphs, an array of (ord, section, text); null for those without full text."""
    whole = texts.groupBy("pmid").agg(F.sort_array(F.collect_list(F.struct("ord", "section", "text"))).alias("paragraphs"))
    return records.join(whole, "pmid", "left")
