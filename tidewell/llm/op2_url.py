"""URL filters (operator 2): rules on host and path, and a logistic regression beyond them.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; its path follows up to ``?``, ``#`` or the end. A rule names a host and a path
prefix; it fits the host and its subdomains, and the longest fitting rule gives the verdict.

Other urls are judged by a logistic regression on hashed character n-grams of host and path.
It is trained from a small labelled URL table: at most MAX_LABELLED urls, those first in the
order of their hashes. Labels come from the rules, from hosts that hold one of SEED_TERMS
(block), and otherwise from the background of unmatched urls (allow), which outnumber what
the first two sources leave open.

* Null urls and urls without ``://``: empty host and path, no rule, judged by the model.
* Empty table: empty result. Repeated rows are judged each. Extra columns are ignored.
* Without labels of both kinds no model can be trained, and urls without a rule are allowed.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed rules of the query: (host and path, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SEED_TERMS = ["casino", "pills", "spam", "adult"]
MAX_LABELLED = 20_000
N_FEATURES = 1 << 14
NGRAMS = (3, 4)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    whole = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    return pages.withColumn("rest", rest).withColumns(
        {
            "host": lower_ascii(F.regexp_extract("rest", "^([^/?#]*)", 1)),
            "path": F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1),
        }
    ).drop("rest")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Longest fitting rule as struct(rule, verdict); null where none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first: it is outermost
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of the host between marks, and of the path."""
    text = F.concat(F.lit("^"), host, F.lit("$"), path)
    grams = []
    for n in NGRAMS:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
        grams.append(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i, n=n: F.substring(text, i, F.lit(n))))
    return F.concat(*grams)


def labelled_urls(judged: DataFrame, seed_terms: list[str], bound: int) -> DataFrame:
    """At most ``bound`` distinct labelled urls: host, path and label (1: block).

    Half of the bound is for urls that a rule or a seed term labels, half for the background, which counts as allowed. So neither
    the growth of the background nor a url that is there many times takes the place of labelled ones.
    """
    seeded = F.lit(False)
    for term in seed_terms:
        seeded = seeded | F.col("host").contains(term)
    label = F.when(F.col("found.verdict") == "block", 1).when(F.col("found.verdict") == "allow", 0).when(seeded, 1)
    urls = judged.where("host <> ''").select("host", "path", label.alias("told")).distinct()
    halves = [urls.where(side).orderBy(F.xxhash64("host", "path"), "host", "path").limit(bound // 2) for side in ("told IS NOT NULL", "told IS NULL")]
    return halves[0].unionByName(halves[1]).select("host", "path", F.coalesce("told", F.lit(0)).cast("double").alias("label"))


def url_filter(
    pages: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    rules: list[tuple[str, str]] = RULES,
    seed_terms: list[str] = SEED_TERMS,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (null where a rule decides)."""
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    judged = with_host_and_path(base).drop("url").withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    hashing = HashingTF(numFeatures=N_FEATURES, inputCol="grams", outputCol="features", binary=True)
    grams = ngrams(F.col("host"), F.col("path"))
    sample = hashing.transform(labelled_urls(judged, seed_terms, max_labelled).withColumn("grams", grams))
    sample = sample.select("label", "features").persist()
    kinds = sample.select("label").distinct().count()
    if kinds == 2:
        fitter = LogisticRegression(maxIter=25, regParam=1e-3, aggregationDepth=2, standardization=False)
        model = fitter.fit(sample)
        scored = model.transform(hashing.transform(judged.withColumn("grams", grams)))
        score = vector_to_array("probability")[1]
    else:
        scored, score = judged, F.lit(0.0)
    sample.unpersist()
    score = F.when(F.col("found").isNull(), score)
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
        score.alias("block_score"),
    )
