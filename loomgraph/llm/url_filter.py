"""URL filters: gradient-boosted trees on lexical features, below explicit rules.

Features: lengths, path depth, digit ratio, character entropy, counts of
parameters, hyphens and dots, and smoothed label statistics of host suffixes.
The trees learn from labelled URLs: those whose path names a document that
has labels (low quality or toxic: block), at most about `max_rows` of them,
chosen by a hash. Suffix statistics count all labelled URLs; for a URL that is
learned from they leave out its fold, so that no label is an input of its own.

A rule is (host, path, verdict). It fits its host and all subdomains if the
URL's path starts with the rule's; the longest that fits decides, else the
trees do.

Defined results: a URL that is null or has no `://` has an empty host and
path, fits no rule and goes to the trees like any other; with no or only one
kind of label the trees are a constant (allow where there is none); a document
with several labels is bad if one says so; of rules of equal length the one
that sorts first decides; repeated rows get equal verdicts; very long URLs are
judged whole; other columns, whatever their names, are left out; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Expected number of labelled URLs that the trees are fitted on, at most.
MAX_ROWS = 20_000
#: Labels of a host suffix count beside so many of the overall rate.
PRIOR = 10.0
#: Folds of the labelled URLs.
FOLDS = 5
FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_dots", "f_fragment", "f_secure", "f_stat1", "f_stat2", "f_stat3"]


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path; null if none does."""
    name, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name, verdict = name.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    return name, verdict


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")


def entropy(text: Column) -> Column:
    """Bits a character of text."""
    n = F.length(text).cast("double")

    def part(c: Column) -> Column:
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -share * F.log2(share)

    chars = F.array_remove(F.array_distinct(F.split(text, "")), "")
    bits = F.aggregate(chars, F.lit(0.0), lambda a, c: a + part(c))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(urls: DataFrame, url: str) -> DataFrame:
    """Add host, path, the lexical features and the three host suffixes."""
    u = F.coalesce(F.col(url), F.lit(""))
    labels = F.split("host", r"\.")
    suffix = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (k - 1)), k), ".")
    n = F.length(u).cast("double")
    digits = (n - F.length(F.regexp_replace(u, "[0-9]", ""))) / F.greatest(n, F.lit(1.0))
    return urls.withColumns({"host": host(F.col(url)), "path": path(F.col(url))}).withColumns(
        {
            "f_length": n,
            "f_host_length": F.length("host").cast("double"),
            "f_path_length": F.length("path").cast("double"),
            "f_depth": _count(F.col("path"), "/"),
            "f_labels": F.size(labels).cast("double"),
            "f_digits": digits,
            "f_entropy": entropy(u),
            "f_params": _count(u, "&") + F.contains(u, F.lit("?")).cast("double"),
            "f_hyphens": _count(u, "-"),
            "f_dots": _count(u, "."),
            "f_fragment": F.contains(u, F.lit("#")).cast("double"),
            "f_secure": u.startswith("https").cast("double"),
            "_s1": suffix(1),
            "_s2": suffix(2),
            "_s3": suffix(3),
        }
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages whose path names a labelled document, with y: 1 for block."""
    number = F.try_to_number(F.regexp_extract(F.col("path"), r"/([0-9]{1,18})(?:[^0-9]|$)", 1), F.lit("9" * 18)).cast("long")
    bad = F.greatest((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int"), (F.coalesce(F.col("quality"), F.lit(1)) == 0).cast("int"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(bad).cast("double").alias("y"))
    return pages.withColumn("_doc", number).where("_doc IS NOT NULL").join(known, F.col("_doc") == F.col("doc_id")).drop("_doc", "doc_id")


def suffix_counts(known: DataFrame, k: int) -> DataFrame:
    """For each host suffix of k labels: labelled URLs and blocked ones, in all and in each fold."""
    own = [F.col("_fold") == f for f in range(FOLDS)]
    return known.groupBy(f"_s{k}").agg(
        F.count("*").alias("_n"), F.sum("y").alias("_y"), F.array(*[F.count_if(o) for o in own]).alias("_nf"), F.array(*[F.sum(F.when(o, F.col("y")).otherwise(0.0)) for o in own]).alias("_yf")
    )


def with_stats(urls: DataFrame, stats: list[DataFrame], rate: float, fold: str | None = None) -> DataFrame:
    """Add the share of blocked URLs of each suffix, drawn towards rate; with fold, as the other folds have it.

    So a URL that is learned from never sees its own label, nor those of its equals.
    """
    for k, counts in enumerate(stats, 1):
        urls = urls.join(counts, f"_s{k}", "left")
        n, y = F.coalesce("_n", F.lit(0)), F.coalesce("_y", F.lit(0.0))
        if fold:
            n, y = n - F.get("_nf", F.col(fold)), y - F.get("_yf", F.col(fold))
        urls = urls.withColumn(f"f_stat{k}", (y + PRIOR * rate) / (n + PRIOR)).drop("_n", "_y", "_nf", "_yf")
    return urls


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, max_rows: int = MAX_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' probability of block, for every page."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    base = lexical(pages.select("page_id", "url"), "url")
    # the labelled URLs are found once; their fold follows the URL, so that equal URLs share one
    known = materialize(labelled_urls(base, labels.select("doc_id", "quality", "toxic")).withColumn("_fold", F.pmod(F.xxhash64(F.lit(4), "url"), F.lit(FOLDS)).cast("int")), "labelled")
    n, bad = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    rate = bad / n if n else 0.0
    if not 0 < bad < n:
        scored = base.withColumn("p_block", F.lit(1.0 if n and bad == n else 0.0))
    else:
        stats = [materialize(suffix_counts(known, k), f"suffix{k}") for k in (1, 2, 3)]
        keep = F.pmod(F.xxhash64(F.lit(9), "url"), F.lit(1 << 30)) < F.lit(min(1 << 30, (max_rows << 30) // n))
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_x")
        train = materialize(with_stats(known.where(keep), stats, rate, "_fold").select("y", *FEATURES), "train")
        trees = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=12, maxDepth=4, stepSize=0.2, seed=1).fit(vectors.transform(train))
        trees.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_c")
        scored = trees.transform(vectors.transform(with_stats(base, stats, rate))).withColumn("p_block", vector_to_array("_p")[1])
    name, verdict = fitting_rule(rules)
    own = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "p_block")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
