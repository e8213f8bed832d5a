"""Registry of the graph engine's queries and their DuckDB equivalents.

Every query takes (spark, sf_dir) and runs over whole tables. Where SQL can say
the same, ORACLES has the statement under the same name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions import vectors as V
from loomgraph.models import OfflineModel, extract_json
from loomgraph.operators import edges as E
from loomgraph.operators import frontier as Q
from loomgraph.operators import graph as G
from loomgraph.operators import ideas as I
from loomgraph.operators import report as R
from loomgraph.operators import store as S
from loomgraph.operators import tree as Tr
from loomgraph.operators.ranks import ranked
from loomgraph.operators.replies import Replies, embedded_by
from loomgraph.operators.similarity import knn_join
from loomgraph.plans.tables import folder, scratch
from loomgraph.sources import files

QUERIES: dict = {}
ORACLES: dict = {}

#: Gates for the embeddings table, whose vectors are never as near as ideas are.
FAR_LINK, FAR_MERGE = 0.25, 0.35


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL shared by the statements; white space and patterns as in functions.text
_STRIP = "trim({}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12))"
_BODY = _STRIP.format(r"regexp_replace(text, '(?m)^(Content \([^)]*\):|Title:.*|Journal:.*|MeSH terms:.*|Abstract:)[ \t\n\r\f]*', '', 'g')")
_SENT = f"""
sent AS (SELECT doc_id, lang, source, body, list_filter(list_transform(string_split(regexp_replace(body, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP.format('s')}), lambda s: s <> '') AS s
         FROM (SELECT *, {_BODY} AS body FROM documents))"""
_IDEAS = f"""{_SENT},
long1 AS (SELECT doc_id, lang, source, list_filter(s, lambda x: length(x) >= 50)[1] AS q FROM sent),
ideas AS (SELECT doc_id, doc_id AS id, lang, source, trim(regexp_replace(rtrim(q, '.'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS statement,
                 array_to_string(list_slice(regexp_extract_all(q, '\\b([A-Z][A-Z0-9]{{2,}})\\b', 1), 1, 5), ',') AS entities, CAST(doc_id % 3 AS INTEGER) AS level
          FROM long1 WHERE q IS NOT NULL)"""
_BOW = """
tok AS (SELECT id, unnest(regexp_extract_all(lower(statement), '[a-z0-9]+')) AS t FROM {src}),
bow AS (SELECT id, CAST(('0x' || substr(sha1(t), 1, 8)) AS BIGINT) % 128 AS bucket, count(*)::DOUBLE AS c FROM tok GROUP BY 1, 2),
nrm AS (SELECT id, sqrt(sum(c * c)) AS n FROM bow GROUP BY 1)"""
_CANON = """
canon AS (SELECT *, min(id) OVER (PARTITION BY lower(statement)) AS canon FROM ideas),
firsts AS (SELECT * FROM canon WHERE id = canon)"""
_PAIRS = """
dots AS (SELECT a.id AS qid, b.id AS cid, sum(a.c * b.c) AS d FROM bow a JOIN bow b ON a.bucket = b.bucket AND b.id < a.id GROUP BY 1, 2),
sims AS (SELECT qid, cid, round(d / (x.n * y.n), 6) AS score FROM dots JOIN nrm x ON x.id = qid JOIN nrm y ON y.id = cid),
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM sims WHERE score >= 0.62 QUALIFY rank <= 8)"""
_FLAGSHIP = f"WITH {_IDEAS}, {_CANON}, {_BOW.format(src='firsts')}, {_PAIRS}"
_DECIDED = f"""{_FLAGSHIP},
lv AS (SELECT qid, cid, rank, i.level AS own, j.level AS their FROM near JOIN ideas i ON i.id = qid JOIN ideas j ON j.id = cid),
best AS (SELECT qid, arg_min(cid, rank) FILTER (WHERE own <> their) AS other, arg_min(cid, rank) AS anyone FROM lv GROUP BY 1),
decided AS (SELECT id, CASE WHEN id <> canon THEN 'merge' WHEN anyone IS NOT NULL THEN 'link' ELSE 'new' END AS decision,
                   CASE WHEN id <> canon THEN canon WHEN other IS NOT NULL THEN other ELSE anyone END AS target,
                   CASE WHEN id <> canon THEN NULL WHEN other IS NOT NULL THEN 'part_of' WHEN anyone IS NOT NULL THEN 'related_to' END AS relation
            FROM canon LEFT JOIN best ON qid = id)"""
_EDGES = f"""{_DECIDED},
raw AS (SELECT CASE WHEN relation = 'part_of' AND t.level < o.level THEN d.target ELSE d.id END AS source, CASE WHEN relation = 'part_of' AND t.level < o.level THEN d.id ELSE d.target END AS target, relation, d.id AS seq
        FROM decided d JOIN ideas o ON o.id = d.id JOIN ideas t ON t.id = d.target WHERE decision = 'link'),
pairs AS (SELECT least(source, target) AS a, greatest(source, target) AS b, arg_min(source, seq) AS s, arg_min(target, seq) AS t, arg_min(relation, seq) AS r, min(seq) AS seq FROM raw GROUP BY 1, 2),
alle AS (SELECT source, target, relation, seq, false AS mirror FROM raw UNION ALL SELECT t, s, CASE WHEN r IN ('part_of', 'causes', 'enables') THEN 'related_to' ELSE r END, seq, true FROM pairs),
edges AS (SELECT * FROM alle QUALIFY row_number() OVER (PARTITION BY source, target, relation ORDER BY seq, mirror) = 1)"""
_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


def _ideas(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    made = I.mock_ideas(docs.withColumn("_lv", (F.col("doc_id") % 3)), "doc_id", "text")
    return made.withColumn("level", (F.col("doc_id") % 3).cast("int")).withColumn("id", F.col("doc_id"))


def _vectors(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").alias("domain"))


class _Graph(NamedTuple):
    """Tables of one query's idea graph; ideas, vectors and edges are written once and read from there."""

    ideas: DataFrame
    firsts: DataFrame
    vectors: DataFrame
    edges: DataFrame
    links: DataFrame


def _graph(spark, sf_dir) -> _Graph:
    write = scratch(spark)
    ideas = write(I.first_wordings(_ideas(spark, sf_dir)), "ideas")
    firsts = ideas.where("id = canon").withColumn("slug", F.col("id"))
    vectors = write(I.embedded(firsts.select("id", "statement")), "vectors")
    told = I.decisions(ideas, vectors=vectors).where("decision = 'link'")
    lv = ideas.select("id", "level")
    joined = told.join(lv, "id").join(lv.select(F.col("id").alias("target"), F.col("level").alias("their")), "target")
    a, b = E.oriented(F.col("id"), F.col("target"), F.col("relation"), F.col("level"), F.col("their"))
    edges = write(E.with_mirrors(joined.select(a.alias("source"), b.alias("target"), "relation", F.lit("").alias("note"), F.col("id").alias("seq"))), "edges")
    links = ideas.select(F.col("doc_id").alias("pmid"), F.col("canon").alias("slug"), "relation", F.col("doc_id").alias("seq"))
    return _Graph(ideas, firsts, vectors, edges, links)


def _edges(spark, sf_dir) -> DataFrame:
    return _graph(spark, sf_dir).edges


# ------------------------------------------------------------------ text


@query(r"""
WITH w AS (SELECT doc_id, text, array_to_string(list_slice(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> ''), 1, 6), '-') AS h FROM documents)
SELECT doc_id, CASE WHEN h = '' THEN 'idea' ELSE h END || '-' || substr(sha1(text), 1, 6) AS slug FROM w""")
def slugify(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(f"WITH {_SENT} SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, coalesce(s[1], '') AS first_sentence, md5(array_to_string(s, '|')) AS digest FROM sent")
def sentence_split(spark, sf_dir):
    s = I.body_sentences(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.try_element_at(s, F.lit(1)), F.lit("")).alias("first_sentence"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(f"WITH {_SENT}, h AS (SELECT doc_id, body, s, substr(array_to_string(list_slice(s, 1, 2), ' '), 1, 400) AS x FROM sent) SELECT doc_id, CASE WHEN x = '' THEN substr(body, 1, 400) ELSE x END AS summary, substr(coalesce(s[1], ''), 1, 200) AS key_finding FROM h")
def mock_summary(spark, sf_dir):
    summary, finding = I.mock_summary(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", summary.alias("summary"), finding.alias("key_finding"))


@query(f"WITH {_IDEAS} SELECT doc_id, statement, entities, 'finding' AS type, 'supports' AS relation, 'mock' AS domain FROM ideas")
def mock_idea(spark, sf_dir):
    return _ideas(spark, sf_dir).select("doc_id", "statement", F.array_join("entities", ",").alias("entities"), "type", "relation", "domain")


@query(f"WITH {_IDEAS}, {_BOW.format(src='ideas')} SELECT id AS doc_id, bucket, round(c / n, 6) AS weight FROM bow JOIN nrm USING (id)")
def bow_embedding(spark, sf_dir):
    v = _ideas(spark, sf_dir).select("doc_id", V.bow_embedding("statement").alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("bucket", "w")).where("w > 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("w", 6).alias("weight"))


@query(f"WITH u AS (SELECT doc_id AS id, text AS statement FROM documents), {_BOW.format(src='u')} SELECT id AS doc_id, bucket, round(c / n, 6) AS weight FROM bow JOIN nrm USING (id)")
def model_vectors(spark, sf_dir):
    kept = Replies(spark, f"{folder(spark)}/vectors", OfflineModel.vectors, "array<double>")
    v = embedded_by(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", OfflineModel, kept)
    return v.select("doc_id", F.posexplode("vec").alias("bucket", "w")).where("w > 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("w", 6).alias("weight"))


@query(r"""SELECT item_id, list_slice(CASE WHEN len(p) > 0 THEN p ELSE [text] END, 1, 5)[1] AS first_question, CAST(CASE WHEN len(p) > 5 THEN 5 WHEN len(p) = 0 THEN 1 ELSE len(p) END AS BIGINT) AS n
FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(text, ',| and '), lambda x: trim(x, ' .')), lambda x: x <> '') AS p FROM benchmark)""")
def topic_questions(spark, sf_dir):
    q = T.questions(F.col("text"))
    return _table(spark, sf_dir, "benchmark").select("item_id", F.element_at(q, 1).alias("first_question"), F.size(q).cast("long").alias("n"))


@query(f"""WITH {_IDEAS}, x AS (SELECT doc_id, list_slice(list_filter(string_split(entities, ','), lambda e: e <> ''), 1, 3) AS e, array_to_string(list_slice(regexp_extract_all(statement, '([A-Za-z][A-Za-z-]{{3,}})', 1), 1, 6), ' ') AS w FROM ideas)
SELECT doc_id, CASE WHEN len(e) > 0 THEN array_to_string(e, ' AND ') || ' mechanism' ELSE w END AS deep, CASE WHEN len(e) > 0 THEN array_to_string(e, ' OR ') ELSE w END AS broad FROM x""")
def idea_query_string(spark, sf_dir):
    e, s = F.col("entities"), F.col("statement")
    return _ideas(spark, sf_dir).select("doc_id", T.idea_query(e, s, "depth").alias("deep"), T.idea_query(e, s, "breadth").alias("broad"))


@query(r"""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped,
CASE WHEN length(url) > 34 THEN rtrim(substr(url, 1, 34)) || '…' ELSE url END AS label, upper(substr(url, 1, 1)) || substr(url, 2) AS title, regexp_replace(trim(regexp_replace(html, '[ \t\n\r\f]+', ' ', 'g')), '^(.{0,80}).*$', '\1', 's') AS flat FROM pages""")
def text_helpers(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(T.html_escape(F.col("html"))).alias("escaped"), T.shortened(F.col("url"), 34).alias("label"), T.capitalised(F.col("url")).alias("title"), F.substring(T.collapse(F.col("html")), 1, 80).alias("flat"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_extract(spark, sf_dir):
    text = F.concat(F.lit("Here: "), F.col("props"), F.lit(" {done}"))
    return _table(spark, sf_dir, "events").select("event_id", F.from_json(extract_json(text), "k long")["k"].alias("k"))


@query(r"""SELECT doc_id, CASE WHEN source IN ('mechanism','method','finding','problem') THEN source ELSE 'finding' END AS type, CASE WHEN lang IN ('introduces','uses','supports','contradicts','extends') THEN lang ELSE 'supports' END AS relation,
lower(trim(coalesce(source, 'general'))) AS domain, CAST(least(len(string_split(text, chr(10))), 5) AS BIGINT) AS n_entities FROM documents WHERE trim(text, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)) <> ''""")
def reply_normalisation(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    raw = F.array(F.struct(F.col("text").alias("statement"), F.col("source").alias("type"), F.col("lang").alias("relation_to_paper"), F.col("source").alias("domain"), F.split("text", "\n").alias("entities")))
    return d.select("doc_id", F.explode(I.normalised_reply(raw)).alias("i")).select("doc_id", "i.type", "i.relation", "i.domain", F.size("i.entities").cast("long").alias("n_entities"))


@query(r"""SELECT conv_id, CAST(len(list_slice(q, 1, 3)) AS BIGINT) AS n, coalesce(q[1], '') AS first_query FROM (SELECT conv_id, list_filter(list_transform(list(text ORDER BY turn), lambda x: trim(x, chr(32)||chr(9)||chr(10)||chr(13)||chr(12))), lambda x: x <> '') AS q FROM conversations GROUP BY 1)""")
def query_sanitation(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    q = T.clean_list(F.col("t.text"), 3)
    return c.select("conv_id", F.size(q).cast("long").alias("n"), F.coalesce(F.try_element_at(q, F.lit(1)), F.lit("")).alias("first_query"))


# ------------------------------------------------------------- similarity


@query(f"SELECT a.vec_id AS query, b.vec_id AS candidate, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 5")
def cosine_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return knn_join(v, v, 5)


@query(f"SELECT a.vec_id AS query, b.vec_id AS candidate, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank, CASE WHEN {_COS} >= {FAR_MERGE} THEN 'merge-eligible' ELSE 'link-only' END AS eligibility FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_COS} >= {FAR_LINK} QUALIFY rank <= 8")
def knn_join_gated(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return knn_join(v, v, 8, FAR_LINK).withColumn("eligibility", F.when(F.col("score") >= FAR_MERGE, "merge-eligible").otherwise("link-only"))


@query(f"SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS candidate, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank, a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 8) WHERE score >= 0.35 AND la <> lb".replace("SELECT * FROM", "SELECT query, candidate, rank, score FROM"))
def analogy_links(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    near = knn_join(v, v, 8).where("score >= 0.35")  # ranked before the domains are compared
    d = v.select("id", "domain")
    joined = near.join(d.select(F.col("id").alias("query"), F.col("domain").alias("la")), "query").join(d.select(F.col("id").alias("candidate"), F.col("domain").alias("lb")), "candidate")
    return joined.where("la <> lb").select("query", "candidate", "rank", "score")


@query(f"{_FLAGSHIP} SELECT qid AS id, cid AS candidate, rank, score, CASE WHEN score >= 0.8 THEN 'merge-eligible' ELSE 'link-only' END AS eligibility FROM near")
def idea_candidates(spark, sf_dir):
    return I.candidates(_ideas(spark, sf_dir).select("id", "statement"))


@query(f"{_DECIDED} SELECT * FROM decided")
def idea_decisions(spark, sf_dir):
    return I.decisions(_ideas(spark, sf_dir))


def _told(idea: dict, ranked: list) -> dict:
    """The deterministic model as one that is asked idea by idea."""
    for target, score, made in ranked:
        if score >= I.MERGE and made["statement"].lower() == idea["statement"].lower():
            return {"decision": "merge", "target": target}
    other = [target for target, _, made in ranked if made["level"] != idea["level"]]
    return {"decision": "link", "target": (other or [ranked[0][0]])[0], "relation": "part_of" if other else "related_to"}


@query(f"{_DECIDED} SELECT * FROM decided")
def folded_decisions(spark, sf_dir):
    """The decisions of a model that is asked for each idea, in order, about what the ones before it became."""
    ideas = _ideas(spark, sf_dir).select(F.lit("v").alias("vault"), "id", "statement", "level")
    return I.fold_decisions(ideas, _told).drop("vault")


@query(f"WITH {_IDEAS}, {_CANON} SELECT canon AS id, count(*) AS papers, min(lower(statement)) AS wording FROM canon GROUP BY 1")
def canonical_ideas(spark, sf_dir):
    return I.first_wordings(_ideas(spark, sf_dir)).groupBy(F.col("canon").alias("id")).agg(F.count("*").alias("papers"), F.min(F.lower("statement")).alias("wording"))


@query("""WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)
SELECT vec_id, unnest(list_transform(range(1, len(e) + 1), lambda i: i - 1)) AS dim, unnest(list_transform(e, lambda x: CAST(greatest(-127, least(127, round_even(x / n * 127, 0))) AS BIGINT))) AS code FROM v""")
def int8_quantize(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.quantised(F.col("embedding"))).alias("dim", "code"))
    return v.select("vec_id", F.col("dim").cast("long").alias("dim"), F.col("code").cast("long").alias("code"))


@query("""WITH q AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: greatest(-127.0, least(127.0, round_even(x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) * 127, 0)))) AS c FROM embeddings),
s AS (SELECT a.vec_id AS query, b.vec_id AS candidate, round(list_inner_product(a.c, b.c) / 16129.0, 6) AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank FROM s QUALIFY rank <= 5""")
def int8_topk(spark, sf_dir):
    v = scratch(spark)(_vectors(spark, sf_dir).select("id", F.transform(V.quantised(F.col("vec")), lambda c: c.cast("double")).alias("vec")), "codes")
    return knn_join(v, v, 5, unit=127.0 * 127.0)  # a query's codes stand for its components times 127 as well


# ------------------------------------------------------------------ graph


@query(f"{_EDGES} SELECT source, target, relation, mirror FROM edges")
def idea_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("source", "target", "relation", "mirror")


@query(f"{_EDGES}, c AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY seq, mirror) AS n FROM edges) SELECT source, target, relation FROM c WHERE n = 1 OR relation <> 'related_to'")
def graph_edges(spark, sf_dir):
    return E.collapsed(_edges(spark, sf_dir)).select("source", "target", "relation")


@query(f"{_EDGES}, n AS (SELECT source AS id, target AS o FROM edges UNION SELECT target, source FROM edges) SELECT f.id AS slug, count(o) AS degree FROM firsts f LEFT JOIN n USING (id) GROUP BY 1")
def node_degree(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return G.degrees(g.firsts, g.edges)


@query(f"{_EDGES}, b AS (SELECT source AS id, target AS other, relation FROM edges UNION ALL SELECT target, source, relation FROM edges) SELECT id, other, arg_min(relation, CASE relation WHEN 'part_of' THEN 0 WHEN 'analogous_to' THEN 1 WHEN 'causes' THEN 2 WHEN 'enables' THEN 3 WHEN 'related_to' THEN 4 ELSE 9 END) AS relation FROM b GROUP BY 1, 2")
def best_relation(spark, sf_dir):
    return E.best_relations(_edges(spark, sf_dir))


@query(f"{_EDGES} SELECT (SELECT count(*) FROM firsts) AS nodes, (SELECT count(*) FROM (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY seq, mirror) AS n FROM edges) WHERE n = 1 OR relation <> 'related_to') AS edges, (SELECT count(DISTINCT doc_id) FROM ideas) AS papers")
def header_stats(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return G.header(g.firsts, g.edges, g.links)


@query(f"{_EDGES}, n AS (SELECT source AS id, target AS o FROM edges UNION SELECT target, source FROM edges), deg AS (SELECT id, count(*) AS d FROM n GROUP BY 1), g AS (SELECT canon AS slug, min(CASE WHEN id = canon THEN statement END) AS statement, 'finding' AS type, 'mock' AS domain, min(CASE WHEN id = canon THEN level END) AS level, count(*) AS papers, array_to_string(list_sort(list(DISTINCT CAST(doc_id AS VARCHAR))), ',') AS cites FROM canon GROUP BY 1) SELECT g.*, coalesce(d, 0) AS degree, round(3.5 + sqrt(coalesce(d, 0)) * 1.6 + CASE WHEN papers > 1 THEN 2 ELSE 0 END, 6) AS radius FROM g LEFT JOIN deg ON id = slug")
def graph_nodes(spark, sf_dir):
    g = _graph(spark, sf_dir)
    found = G.nodes(g.firsts, g.links).join(G.degrees(g.firsts, g.edges), "slug")
    return found.withColumn("radius", F.round(G.radius(F.col("degree"), F.col("papers")), 6))


@query("SELECT pmid, slug, first(relation ORDER BY seq, relation) AS relation FROM (SELECT l_orderkey AS pmid, l_partkey AS slug, l_returnflag AS relation, l_linenumber AS seq FROM lineitem) GROUP BY 1, 2")
def paper_idea_links(spark, sf_dir):
    l = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pmid"), F.col("l_partkey").alias("slug"), F.col("l_returnflag").alias("relation"), F.col("l_linenumber").alias("seq"))
    return E.first_links(l).select("pmid", "slug", "relation")


@query("SELECT l_partkey AS slug, p_name AS statement, count(DISTINCT l_orderkey) AS papers FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def ideas_by_paper_count(spark, sf_dir):
    l, p = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part")
    n = l.groupBy(F.col("l_partkey").alias("slug")).agg(F.count_distinct("l_orderkey").alias("papers"))
    return n.join(p.select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("statement")), "slug").orderBy(F.desc("papers"), F.desc("statement"), F.desc("slug"))


@query(f"WITH {_IDEAS}, i AS (SELECT lang, count(DISTINCT lower(statement)) AS ideas FROM ideas GROUP BY 1), p AS (SELECT lang, count(*) AS papers FROM documents GROUP BY 1) SELECT p.lang AS vault, papers, coalesce(ideas, 0) AS ideas, p.lang = 'en' AS active FROM p LEFT JOIN i ON i.lang IS NOT DISTINCT FROM p.lang")
def vault_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    papers = docs.groupBy("lang").agg(F.count("*").alias("papers"))
    ideas = _ideas(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").groupBy(F.col("lang").alias("l")).agg(F.count_distinct(F.lower("statement")).alias("ideas"))
    return papers.join(ideas, F.col("lang").eqNullSafe(F.col("l")), "left").select(F.col("lang").alias("vault"), "papers", F.coalesce("ideas", F.lit(0)).alias("ideas"), (F.col("lang") == "en").alias("active"))


@query("WITH n AS (SELECT p_brand AS domain, count(*) AS n FROM part GROUP BY 1) SELECT domain, n, CASE WHEN r <= 8 THEN r ELSE 0 END AS slot FROM (SELECT *, row_number() OVER (ORDER BY n DESC, domain) AS r FROM n)")
def domain_top8(spark, sf_dir):
    return G.domain_slots(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("domain")))


@query(f"{_EDGES}, nb AS (SELECT source AS qid, target AS cid FROM edges UNION SELECT target, source FROM edges), alld AS (SELECT a.id AS qid, b.id AS cid, sum(a.c * b.c) AS d FROM bow a JOIN bow b ON a.bucket = b.bucket AND a.id <> b.id GROUP BY 1, 2), f AS (SELECT x.id AS qid, y.id AS cid, round(coalesce(d, 0) / (x.n * y.n), 6) AS score FROM nrm x JOIN nrm y ON x.id <> y.id LEFT JOIN alld ON alld.qid = x.id AND alld.cid = y.id ANTI JOIN nb ON nb.qid = x.id AND nb.cid = y.id) SELECT qid AS query, cid AS candidate, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM f QUALIFY rank <= 25")
def similar_unlinked(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return G.similar_unlinked(g.vectors, g.edges)


@query(f"WITH {_IDEAS} SELECT doc_id, statement FROM ideas WHERE contains(lower(statement), 'tion')")
def text_search(spark, sf_dir):
    return G.visible(_ideas(spark, sf_dir), "tion").select("doc_id", "statement")


@query("SELECT doc_id AS pmid, CASE WHEN n > 3 AND coalesce(source, '') NOT LIKE 'src1%' THEN 'fulltext' WHEN toxic IS NOT NULL THEN 'skip' ELSE 'abstract' END AS path FROM (SELECT d.doc_id, d.source, l.toxic, len(string_split(text, chr(10))) AS n FROM documents d LEFT JOIN labels l USING (doc_id))".replace("CASE WHEN n > 3 AND coalesce(source, '') NOT LIKE 'src1%' THEN 'fulltext' WHEN toxic IS NOT NULL THEN 'skip'", "CASE WHEN toxic IS NOT NULL THEN 'skip' WHEN n >= 3 AND source NOT LIKE 'src1%' THEN 'fulltext' WHEN text = '' THEN 'skip'").replace("d.source, l.toxic", "d.source, d.text, l.toxic"))
def extraction_path(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    papers = d.select(F.col("doc_id").alias("pmid"), F.col("text").alias("abstract"), F.when(F.col("source").startswith("src1"), F.col("source")).otherwise("").alias("source"))
    full = d.select(F.col("doc_id").alias("pmid"), F.explode(F.split("text", "\n")).alias("p"))
    return S.extraction_path(papers, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pmid")), full)


@query("SELECT o_custkey AS pmid, any_value(coalesce(nullif(c_name, ''), CAST(c_custkey AS VARCHAR))) AS title, any_value(c_mktsegment <> 'BUILDING') AS local FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def cited_papers(spark, sf_dir):
    papers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pmid"), F.col("c_name").alias("title"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("source"))
    return G.cited_papers(papers, _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pmid")))


@query("WITH a AS (SELECT DISTINCT user_id AS pmid FROM events) SELECT pmid, CASE WHEN c_custkey IS NULL THEN 0.0 ELSE coalesce(CASE WHEN c_acctbal >= 0 THEN round(c_acctbal / 10000, 6) END, 0.3) END AS relevance, coalesce(c_mktsegment, '') AS domain FROM a LEFT JOIN customer ON c_custkey = pmid")
def paper_signals(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "pmid")
    asked = _table(spark, sf_dir, "events").select(F.col("user_id").alias("pmid")).distinct()
    told = G.paper_signals(asked, c.select("pmid", F.array("c_mktsegment").alias("mesh")), c.where("c_acctbal >= 0").select("pmid", F.round(F.col("c_acctbal") / 10000, 6).alias("relevance")))
    return told.select("pmid", "relevance", F.array_join("domains", ",").alias("domain"))


@query(f"{_EDGES} SELECT e.source AS slug, e.target, e.relation, CAST(CASE WHEN i.level = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS relevance FROM edges e JOIN firsts i ON i.id = e.target WHERE e.source IN (SELECT id FROM firsts WHERE level = 2)")
def edge_expansion(spark, sf_dir):
    g = _graph(spark, sf_dir)
    worth = g.firsts.select("slug", F.when(F.col("level") == 0, 0.9).alias("relevance"))
    return G.expansions(g.firsts.where("level = 2"), g.edges, worth)


@query("SELECT l_orderkey AS order_id, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place, greatest(count(*) OVER (PARTITION BY l_orderkey) - 3, 0) AS more FROM lineitem QUALIFY place <= 3")
def row_previews(spark, sf_dir):
    l = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), "l_extendedprice")
    return G.previews(l, "order_id", F.desc("l_extendedprice"), "line").select("order_id", "line", F.col("place").cast("long").alias("place"), "more")


@query("WITH n AS (SELECT p_brand AS domain, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1) SELECT p_partkey AS slug, p_name AS statement FROM part JOIN n ON domain = p_brand WHERE (r > 8 OR p_brand = 'Brand#11') AND contains(lower(p_name), 'a')")
def visible_domains(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("statement"), F.col("p_brand").alias("domain"))
    return G.visible(p, "A", [G.OTHER, "Brand#11"]).select("slug", "statement")


@query(f"{_EDGES}, n AS (SELECT source AS id, target AS o FROM edges UNION SELECT target, source FROM edges), top AS (SELECT id FROM n GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 1) SELECT f.id AS slug, CAST(CASE WHEN f.level = 1 THEN 0.12 WHEN f.id IN (SELECT id FROM top) THEN 1.0 WHEN f.id IN (SELECT o FROM n WHERE id IN (SELECT id FROM top)) THEN 0.95 ELSE 0.15 END AS DOUBLE) AS weight FROM firsts f")
def node_emphasis(spark, sf_dir):
    g = _graph(spark, sf_dir)
    top = G.degrees(g.firsts, g.edges).orderBy(F.desc("degree"), "slug").limit(1)
    return G.emphasis(g.firsts, g.firsts.where("level <> 1"), g.edges, top)


@query(f"{_EDGES}, n AS (SELECT source AS id, target AS o FROM edges UNION SELECT target, source FROM edges), deg AS (SELECT id, count(*) AS d FROM n GROUP BY 1) SELECT f.id AS slug, statement, coalesce(d, 0) AS degree FROM firsts f LEFT JOIN deg USING (id) WHERE contains(lower(statement), 'a') ORDER BY 3 DESC, 1 LIMIT 1")
def best_match(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return G.best_match(g.firsts, G.degrees(g.firsts, g.edges), "A").select("slug", "statement", "degree")


@query("SELECT conv_id, turn, md5('Title: ' || role || CASE WHEN turn > 1 THEN chr(10) || 'Year: ' || turn ELSE '' END || chr(10) || 'Mesh: a, b' || CASE WHEN text <> '' THEN chr(10) || 'Abstract: ' || text ELSE '' END) AS digest FROM conversations")
def extraction_prompt(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    asked = I.extraction_prompt(F.col("role"), F.lit(None).cast("string"), F.when(F.col("turn") > 1, F.col("turn").cast("string")), F.array(F.lit("a"), F.lit("b")), F.col("text"))
    return c.select("conv_id", "turn", F.md5(asked).alias("digest"))


@query("SELECT a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score, round(sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS norm FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    after = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("next"))
    return v.join(after, "id").select("id", F.round(V.cosine(F.col("vec"), F.col("next")), 6).alias("score"), F.round(V.norm(F.col("vec")), 6).alias("norm"))


@query("SELECT s_suppkey AS id, count(*) FILTER (WHERE n_nationkey IS NOT NULL) AS n FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3 GROUP BY 1")
def keyed_reads(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "k")
    n = _table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"))
    here = S.existing(s, n, "k").select("s_suppkey", F.lit(1).alias("n"))
    return here.union(S.missing(s, n, "k").select("s_suppkey", F.lit(0))).select(F.col("s_suppkey").alias("id"), F.col("n").cast("long").alias("n"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def vector_upsert(spark, sf_dir):
    return S.latest(_table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@query("""WITH d AS (SELECT doc_id, max(text) AS text, max(source) AS source FROM documents GROUP BY doc_id),
q AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS pmid, md5(text) AS abstract, source,
CASE WHEN toxic = 1 THEN 'toxic' WHEN quality IS NOT NULL THEN 'quality ' || quality END AS summary
FROM d LEFT JOIN q USING (doc_id)""")
def vault_upserts(spark, sf_dir):
    """Every document is a paper; three upserts: all, those that are labelled, those that are labelled toxic. Then the latest rows."""
    vault, none = S.Vault(spark, folder(spark), "v"), F.lit(None).cast("string")
    d = _table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("text").alias("abstract"), F.max("source").alias("source"))
    paper = [F.col("doc_id").cast("string").alias("pmid"), none.alias("title"), "abstract", none.alias("journal"), none.alias("year"), F.array().cast("array<string>").alias("mesh"), "source", none.alias("summary")]
    vault.upsert("papers", d.select(*paper))
    q = _table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("string").alias("pmid")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labelled = scratch(spark)(vault.read("papers").join(q, "pmid"), "labelled")  # two upserts read it
    vault.upsert("papers", labelled.withColumn("summary", F.concat(F.lit("quality "), "quality")))
    vault.upsert("papers", labelled.where("toxic = 1").withColumn("summary", F.lit("toxic")))
    return vault.read("papers").select("pmid", F.md5("abstract").alias("abstract"), "source", "summary")


# --------------------------------------------------------------- frontier


@query("SELECT lower(event_type) AS domain, count(*) AS seen FROM events GROUP BY 1")
def domain_counts(spark, sf_dir):
    return Q.domain_counts(_table(spark, sf_dir, "events").select(F.array("event_type").alias("domains")))


_NOVEL = """c AS (SELECT lower(event_type) AS d FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1),
x AS (SELECT event_id, value, CASE WHEN lower(event_type) IN (SELECT d FROM c) THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS novelty FROM events)"""


def _scored(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    counts = Q.domain_counts(e.where("event_type IN ('click', 'purchase')").select(F.array("event_type").alias("domains")))
    items = e.select("event_id", "value", F.array("event_type", F.lit("never seen")).alias("domains"))
    return Q.novelty(items, counts, "event_id")


@query(f"WITH {_NOVEL} SELECT event_id, novelty FROM x")
def domain_novelty(spark, sf_dir):
    return _scored(spark, sf_dir).select("event_id", "novelty")


@query(f"WITH {_NOVEL} SELECT event_id, round(1.0 * value + 0.15 * novelty, 4) AS deep, round(0.55 * value + 1.0 * novelty, 4) AS broad FROM x")
def frontier_score(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("event_id", Q.score(F.col("value"), F.col("novelty"), "depth").alias("deep"), Q.score(F.col("value"), F.col("novelty"), "breadth").alias("broad"))


@query(f"WITH {_NOVEL} SELECT event_id AS seq, round(0.55 * value + 1.0 * novelty, 4) AS score FROM x ORDER BY 2 DESC, 1")
def frontier_order(spark, sf_dir):
    return Q.ordered(_scored(spark, sf_dir).select(F.col("event_id").alias("seq"), Q.score(F.col("value"), F.col("novelty"), "breadth").alias("score")))


@query("SELECT item_id, round(1.0 - (row_number() OVER (ORDER BY item_id) - 1) / (SELECT count(*) FROM benchmark) * 0.3, 6) AS relevance, 'seed result #' || row_number() OVER (ORDER BY item_id) AS reason FROM benchmark")
def seed_relevance(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").select("item_id")
    n = b.agg(F.count("*").alias("n"))
    return ranked(b, ["item_id"]).crossJoin(F.broadcast(n)).select("item_id", F.round(1.0 - (F.col("rank") - 1) / F.greatest("n", F.lit(1)) * 0.3, 6).alias("relevance"), F.concat(F.lit("seed result #"), F.col("rank").cast("string")).alias("reason"))


@query("SELECT event_type AS kind, user_id AS id, min(event_id) AS seq FROM events WHERE NOT (event_type = 'view' AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) GROUP BY 1, 2")
def push_dedupe(spark, sf_dir):
    p = _table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("id"), F.col("event_id").alias("seq"))
    visited = _table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit("view").alias("kind"), F.col("c_custkey").alias("id"))
    return Q.first_pushes(p, visited).select("kind", "id", "seq")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 120")
def recent_findings(spark, sf_dir):
    return R.recent(_table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""WITH r AS (SELECT 'customer ' || o_custkey AS topic, CASE o_orderstatus WHEN 'O' THEN 'depth' ELSE 'breadth' END AS mode, strftime(o_orderdate, '%Y%m%d') AS day, o_orderkey AS number FROM orders)
SELECT substr(replace(topic, ' ', '-') || '-' || substr(sha1(topic), 1, 6), 1, 40) AS topic, mode, arg_max(day || '-' || number, day || lpad(CAST(number AS VARCHAR), 12, '0')) AS run FROM r GROUP BY 1, 2""")
def latest_run(spark, sf_dir):
    mode = F.when(F.col("o_orderstatus") == "O", "depth").otherwise("breadth")
    topic = F.substring(T.slugify(F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))), 1, 40)
    day, number = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey")
    runs = _table(spark, sf_dir, "orders").select(topic.alias("topic"), mode.alias("mode"), day.alias("day"), number.alias("number"))
    return S.latest_runs(runs).select("topic", "mode", F.concat_ws("-", "day", F.col("number").cast("string")).alias("run"))


# ------------------------------------------------------------ trees, reports

_PARTS = f"SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: {_STRIP.format('p')}), lambda p: p <> '') AS p FROM documents"
_FOLD = """list_reduce(list_prepend({{'g': -1, 's': 0::BIGINT, 'o': []::INTEGER[]}}, list_transform({sizes}, lambda n: {{'g': 0, 's': n::BIGINT, 'o': []::INTEGER[]}})),
 lambda a, x: CASE WHEN a.g >= 0 AND a.s + x.s <= {limit} THEN {{'g': a.g, 's': a.s + x.s + 2, 'o': list_append(a.o, a.g)}} ELSE {{'g': a.g + 1, 's': x.s + 2, 'o': list_append(a.o, a.g + 1)}} END).o"""


@query(f"WITH p AS ({_PARTS}), f AS (SELECT doc_id, p, {_FOLD.format(sizes='list_transform(p, lambda q: length(q))', limit=3500)} AS g FROM p WHERE len(p) > 0) SELECT doc_id, unnest(range(len(p))) AS ord, CAST(unnest(g) AS BIGINT) AS grp FROM f")
def node_groups(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", Tr.paragraphs(F.col("text"), "\n").alias("p"))
    g = Tr.packed(F.transform("p", lambda x: F.length(x).cast("long")), Tr.GROUP)
    return d.select("doc_id", F.posexplode(g).alias("ord", "grp")).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("grp").cast("long").alias("grp"))


_HEAD = "substr(a.rest, 1, 1200)"
_CUT = f"CASE WHEN contains({_HEAD}, ' ') AND length({_HEAD}) - instr(reverse({_HEAD}), ' ') > 600 THEN length({_HEAD}) - instr(reverse({_HEAD}), ' ') ELSE 1200 END"
_LEAVES = f"""p AS ({_PARTS}),
cut AS (SELECT doc_id, list_transform(p, lambda q: list_reduce(list_prepend({{'rest': q, 'done': []::VARCHAR[]}}, list_transform(range(length(q) * 2 // 1200), lambda i: {{'rest': '', 'done': []::VARCHAR[]}})),
 lambda a, x: CASE WHEN length(a.rest) > 1200 THEN {{'rest': {_STRIP.format(f'substr(a.rest, {_CUT} + 1)')}, 'done': list_append(a.done, {_STRIP.format(f'substr(a.rest, 1, {_CUT})')})}} ELSE a END)) AS c FROM p WHERE len(p) > 0),
items AS (SELECT doc_id, flatten(list_transform(c, lambda x: list_concat(list_transform(x.done, lambda d: {{'p': d, 'alone': true}}), CASE WHEN x.rest <> '' THEN [{{'p': x.rest, 'alone': false}}] ELSE [] END))) AS i FROM cut),
grp AS (SELECT doc_id, i, list_reduce(list_prepend({{'g': -1, 's': 0::BIGINT, 'alone': true, 'o': []::INTEGER[]}}, list_transform(i, lambda x: {{'g': 0, 's': length(x.p), 'alone': x.alone, 'o': []::INTEGER[]}})),
 lambda a, x: CASE WHEN NOT a.alone AND NOT x.alone AND a.s + x.s <= 1200 THEN {{'g': a.g, 's': a.s + x.s + 2, 'alone': false, 'o': list_append(a.o, a.g)}} ELSE {{'g': a.g + 1, 's': x.s + 2, 'alone': x.alone, 'o': list_append(a.o, a.g + 1)}} END).o AS o FROM items),
flat AS (SELECT doc_id, unnest(i).p AS p, unnest(o) AS ord, unnest(range(len(i))) AS pos, greatest(list_max(o) - 499, 0) AS truncated FROM grp),
leaves AS (SELECT doc_id AS paper, CAST(ord AS INTEGER) AS ord, string_agg(p, chr(10) || chr(10) ORDER BY pos) AS content, CAST(any_value(truncated) AS INTEGER) AS truncated FROM flat WHERE ord < 500 GROUP BY 1, 2)"""


@query(f"WITH {_LEAVES} SELECT paper, ord, CAST(length(content) AS INTEGER) AS size, md5(content) AS digest, truncated FROM leaves")
def leaf_split(spark, sf_dir):
    leaf = Tr.leaf_nodes(_table(spark, sf_dir, "documents"), "doc_id", "text", separator="\n")
    return leaf.select("paper", "ord", F.length("content").alias("size"), F.md5("content").alias("digest"), "truncated")


_SPLIT = f"list_filter(list_transform(string_split(regexp_replace(body, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP.format('s')}), lambda s: s <> '')"
_TREE = f"""WITH RECURSIVE {_LEAVES},
tree AS (SELECT paper, 0 AS level, ord, content, CAST(NULL AS VARCHAR) AS key_finding, CAST(NULL AS VARCHAR) AS idea, []::INTEGER[] AS members, ord AS first, truncated FROM leaves
 UNION ALL
 SELECT paper, level + 1, g, substr(CASE WHEN array_to_string(s[1:2], ' ') = '' THEN body ELSE array_to_string(s[1:2], ' ') END, 1, 400), substr(coalesce(s[1], ''), 1, 200), list_filter(s, lambda x: length(x) >= 50)[1], members, first, 0
 FROM (SELECT *, {_SPLIT} AS s FROM (SELECT *, {_BODY} AS body FROM (
  SELECT paper, any_value(r.level) AS level, g, string_agg(r.content, chr(10) || chr(10) ORDER BY r.ord) AS text, list(r.ord ORDER BY r.ord) AS members, min(r.first) AS first
  FROM (SELECT paper, unnest(rows) AS r, unnest(CASE WHEN len(rows) > 1 AND list_max(gs) + 1 = len(rows) THEN list_transform(range(len(rows)), lambda i: CAST(i // 2 AS INTEGER)) ELSE gs END) AS g
   FROM (SELECT paper, rows, {_FOLD.format(sizes='list_transform(rows, lambda q: length(q.content))', limit=3500)} AS gs
    FROM (SELECT paper, list({{'ord': ord, 'level': level, 'content': content, 'first': first}} ORDER BY ord) AS rows FROM tree GROUP BY paper HAVING count(*) > 1 OR max(level) = 0)))
  GROUP BY paper, g)))),
up AS (SELECT paper, level - 1 AS level, unnest(members) AS ord, ord AS parent, idea AS above FROM tree WHERE level > 0),
nodes AS (SELECT t.*, parent, above FROM tree t LEFT JOIN up USING (paper, level, ord))"""
_SLUG = "coalesce(nullif(array_to_string(list_slice(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> ''), 1, 6), '-'), ''), 'idea') || '-' || substr(sha1({0}), 1, 6)"


def _tree(spark, sf_dir):
    return Tr.build(Tr.leaf_nodes(_table(spark, sf_dir, "documents"), "doc_id", "text", separator="\n"), write=scratch(spark))


@query(f"{_TREE} SELECT paper, CAST(level AS INTEGER) AS level, ord, parent, md5(content) AS digest, CAST(len(members) AS INTEGER) AS children FROM nodes")
def tree_levels(spark, sf_dir):
    return _tree(spark, sf_dir).select("paper", "level", "ord", "parent", F.md5("content").alias("digest"), "children")


@query(f"{_TREE} SELECT paper, count(*) AS n_nodes, count(*) FILTER (WHERE level = 0) AS n_leaves, CAST(max(level) AS BIGINT) AS depth, count(idea) AS n_ideas, CAST(max(truncated) AS BIGINT) AS truncated, arg_max(key_finding, level * 1000 + ord) FILTER (WHERE key_finding <> '') AS key_finding FROM tree GROUP BY 1")
def tree_totals(spark, sf_dir):
    return Tr.totals(_tree(spark, sf_dir)).drop("tree")


@query(f"{_TREE} SELECT paper, CAST(level AS INTEGER) AS level, ord, CAST(row_number() OVER (PARTITION BY paper ORDER BY first, level DESC) AS INTEGER) AS rank FROM tree")
def tree_outline(spark, sf_dir):
    return Tr.outline(_tree(spark, sf_dir)).select("paper", "level", "ord", "rank")


@query(f"""{_TREE}, padded AS (SELECT *, repeat('  ', CAST(max(level) OVER (PARTITION BY paper) - level AS INTEGER)) AS pad FROM tree),
lines AS (SELECT paper, first, level, pad || '- ' || CASE WHEN level = 0 THEN '“' || replace(substr(content, 1, 110), chr(10), ' ') || '…”' ELSE '[' || level || '.' || ord || '] ' || content END || CASE WHEN idea IS NULL THEN '' ELSE chr(10) || pad || '  - 💡 [' || idea || '](' || {_SLUG.format('idea')} || ')' END AS line FROM padded),
texts AS (SELECT paper, string_agg(line, chr(10) ORDER BY first, level DESC) AS text FROM lines GROUP BY 1)
SELECT paper, md5(text) AS digest, CAST(length(text) AS INTEGER) AS size FROM texts""")
def tree_outline_text(spark, sf_dir):
    told = F.filter(F.array(F.struct(T.slugify(F.coalesce("idea", F.lit(""))).alias("slug"), F.col("idea").alias("statement"))), lambda i: i["statement"].isNotNull())
    return Tr.outline_text(_tree(spark, sf_dir).withColumn("ideas", told)).select("paper", F.md5("text").alias("digest"), F.length("text").alias("size"))


@query(f"{_TREE} SELECT DISTINCT {_SLUG.format('idea')} AS source, {_SLUG.format('above')} AS target, 'part_of' AS relation FROM nodes WHERE idea IS NOT NULL AND above IS NOT NULL AND idea <> above")
def structure_edges(spark, sf_dir):
    n = _tree(spark, sf_dir).withColumn("slugs", F.when(F.col("idea").isNull(), F.array().cast("array<string>")).otherwise(F.array(T.slugify(F.coalesce("idea", F.lit(""))))))
    return Tr.structure_edges(n)


_TOPIC = "topics AS (SELECT item_id + 1000000000 AS id, text AS statement FROM benchmark)"


@query(f"WITH {_IDEAS}, {_TOPIC}, u AS (SELECT id, statement FROM ideas UNION ALL SELECT id, statement FROM topics), {_BOW.format(src='u')}, d AS (SELECT a.id AS q, b.id AS c, sum(a.c * b.c) AS d FROM bow a JOIN bow b USING (bucket) WHERE a.id >= 1000000000 AND b.id < 1000000000 GROUP BY 1, 2), pairs AS (SELECT t.id AS q, i.id AS c, coalesce(d.d, 0) AS d FROM topics t CROSS JOIN ideas i LEFT JOIN d ON d.q = t.id AND d.c = i.id) SELECT q - 1000000000 AS question, c AS idea, round(d / (x.n * y.n), 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(d / (x.n * y.n), 6) DESC, c) AS rank FROM pairs JOIN nrm x ON x.id = q JOIN nrm y ON y.id = c QUALIFY rank <= 40")
def report_retrieval(spark, sf_dir):
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), V.bow_embedding("text").alias("vec"))
    return R.retrieved(asked, I.embedded(_ideas(spark, sf_dir).select("id", "statement")))


@query("SELECT l_partkey AS slug, count(DISTINCT l_orderkey) AS papers FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def report_fallback(spark, sf_dir):
    return R.most_cited(_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("slug"), F.col("l_orderkey").alias("pmid")))


@query("SELECT o_custkey, CAST(len(list_distinct(list(o_orderkey))) AS BIGINT) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY 1")
def report_sources(spark, sf_dir):
    text = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.collect_list("o_orderkey"), lambda k: F.concat(F.lit("as in PMID "), k.cast("string"), F.lit(" and PMID: "), k.cast("string"))), "; ").alias("t"))
    ids = R.cited_ids(F.col("t"))
    return text.select("o_custkey", F.size(ids).cast("long").alias("n"), F.element_at(ids, 1).alias("first_id"))


@query("""SELECT conv_id, md5('# ' || upper(substr(f, 1, 1)) || substr(f, 2) || chr(10) || chr(10) || 'Summary.' || chr(10) || chr(10) || array_to_string(t, chr(10) || chr(10)) || chr(10) || chr(10) || '## Open questions' || chr(10) || chr(10) || '- What next?' || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || '- https://pubmed.ncbi.nlm.nih.gov/' || conv_id || '/') AS digest
FROM (SELECT conv_id, list('PMID ' || conv_id || ': ' || role ORDER BY turn) AS t, 'talk ' || conv_id AS f FROM conversations GROUP BY 1)""")
def report_text(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("PMID "), F.col("conv_id").cast("string"), F.lit(": "), "role").alias("t")))).alias("s"))
    head = F.lit("Summary.\n\n\n\n## Open questions\n\n- What next?")
    return c.select("conv_id", F.md5(R.assembled(F.concat(F.lit("talk "), F.col("conv_id").cast("string")), head, F.array_join("s.t", "\n\n"))).alias("digest"))


@query("""SELECT conv_id, md5(array_to_string(list(CASE WHEN role <> prev OR prev IS NULL THEN '## ' || role || chr(10) || chr(10) || text ELSE text END ORDER BY turn), chr(10) || chr(10))) AS digest
FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1""")
def fulltext_markdown(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("section"), "text")
    return files.fulltext_markdown(c, "conv_id").select("conv_id", F.md5("markdown").alias("digest"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>|&[a-z#0-9]*;?', ' ', 'g') AS x FROM pages),
u AS (SELECT page_id, trim(regexp_replace(regexp_replace(x, '[^\p{L}\p{N} .,\n]', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS y FROM t)
SELECT page_id, CAST(0 AS INTEGER) AS ord, 'Page' AS section, CAST(length(y) AS INTEGER) AS size FROM u WHERE y <> ''
UNION ALL SELECT page_id, CAST(CASE WHEN y <> '' THEN 1 ELSE 0 END AS INTEGER), 'Page', CAST(11 AS INTEGER) FROM u""")
def section_paragraphs(spark, sf_dir):
    from loomgraph.sources.literature import bodies

    p = _table(spark, sf_dir, "pages")
    text = F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), "<[^>]*>|&[a-z#0-9]*;?", " ")
    xml = F.concat(F.lit("<article><body><sec><title>Page</title><p>"), F.regexp_replace(text, "[^\\p{L}\\p{N} .,\n]", " "), F.lit("</p><p>second <i>part</i></p></sec></body></article>"))
    return bodies(p.select("page_id", xml.alias("xml")), "page_id", "xml").select("page_id", "ord", "section", F.length("text").alias("size"))


_RUN = "{{'n': {n}, 'w': {w}, 'ever': {ever}, 'counted': {counted}, 'out': {out}, 'id': {id}, 'v': {v}}}"
_BLANK = {"n": "0::BIGINT", "w": "[]::STRUCT(s DOUBLE, q BIGINT, id VARCHAR)[]", "ever": "[]::VARCHAR[]", "counted": "[]::VARCHAR[]", "out": "[]::STRUCT(step BIGINT, id VARCHAR, score DOUBLE)[]", "id": "''", "v": "0::DOUBLE"}
_PUSH = _RUN.format(
    n="a.n + 1", ever="CASE WHEN list_contains(a.ever, x.id) THEN a.ever ELSE list_append(a.ever, x.id) END", counted="a.counted", out="a.out", id="''", v="0::DOUBLE",
    w="CASE WHEN list_contains(a.ever, x.id) THEN a.w ELSE list_append(a.w, {'s': -round(0.55 * x.v + CASE WHEN list_contains(a.counted, x.id) THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END, 4), 'q': len(a.ever), 'id': x.id}) END",
)
_POP = _RUN.format(n="b.n", w="list_sort(b.w)[2:]", ever="b.ever", counted="list_append(b.counted, list_sort(b.w)[1].id)", out="list_append(b.out, {'step': b.n, 'id': list_sort(b.w)[1].id, 'score': -list_sort(b.w)[1].s})", id="''", v="0::DOUBLE")


@query(f"""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS run, list({{'id': event_type, 'v': value}} ORDER BY event_id) AS xs FROM events GROUP BY 1),
f AS (SELECT run, list_reduce(list_prepend({_RUN.format(**_BLANK)}, list_transform(xs, lambda x: {_RUN.format(**(_BLANK | {'id': 'x.id', 'v': 'x.v'}))})),
 lambda a, x: list_transform([{_PUSH}], lambda b: CASE WHEN b.n % 3 = 0 AND len(b.w) > 0 THEN {_POP} ELSE b END)[1]).out AS o FROM p)
SELECT run, i.step, 'idea' AS kind, i.id, i.score FROM (SELECT run, unnest(o) AS i FROM f)""")
def frontier_replay(spark, sf_dir):
    from loomgraph.streaming.frontier import replay

    e = _table(spark, sf_dir, "events")
    pushes = e.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("seq"), F.lit("idea").alias("kind"), F.col("event_type").alias("id"), F.col("value").alias("relevance"), F.array("event_type").alias("domains"))
    return replay(pushes, "breadth", pop_every=3)
