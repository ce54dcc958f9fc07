"""Quality rules with host verdicts (operator 1): DataFrame functions only.

Words are runs of characters other than space and U+0009..U+000D. Per document the rules
count words, their characters, symbols, repeated lines and words in repeated three-word
windows. Failures are summed by host, each host's failure rate is shrunk towards the
corpus with a beta prior fitted to the hosts (method of moments), and the verdict on the
host is joined back to its documents.

* Null text: no words, so the base rules fail. Null host: counted with the empty host.
* Empty table: empty result. Repeated rows are judged each. Extra columns are ignored.
* Three-word windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tables import stored

#: What separates words.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Hosts whose shrunk failure rate reaches BLOCK lose all documents; from WATCH on, those with a soft failure.
WATCH, BLOCK = 0.3, 0.8
#: The join on the host deals each host's rows to so many keys.
SALTS = 32


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it, in lambdas too."""
    return F.transform(F.array(value), body)[0]


def window_hashes(words: Column) -> Column:
    """Hashes of the three-word windows, by position."""
    n = F.size(words)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))


def n_repeat_words(hashes: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the text.

    The starts of such windows, in order, each cover three words less the overlap with the
    next one, so the count is the sum of min(3, distance to the last start). Texts without a
    repeated window, which are most, skip the sort.
    """
    at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(at, covered))


def covered(at: Column) -> Column:
    twice = F.filter(
        at,
        lambda x, k: (F.when(k > 0, F.get(at, k - 1)["h"] == x["h"]).otherwise(False))
        | (F.when(k + 1 < F.size(at), F.get(at, k + 1)["h"] == x["h"]).otherwise(False)),
    )
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(3), s - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def word_counts(words: Column) -> Column:
    """Number of words, and of those in repeated windows."""
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        let(window_hashes(words), n_repeat_words).cast("long").alias("n_repeat_words"),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds character and line counts to ``docs``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: without(x, SPACES) != "")
    n_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds")))
    return docs.withColumns(
        {
            "word_chars": F.length(without(whole, SPACES)).cast("long"),
            "n_symbols": (F.length(whole) - F.length(without(whole, SYMBOLS))).cast("long"),
            "line_counts": n_lines,
        }
    ).withColumns(
        {
            "n_lines": F.col("line_counts.n").cast("long"),
            "n_dup_lines": (F.col("line_counts.n") - F.col("line_counts.kinds")).cast("long"),
        }
    )


def document_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: measures, base verdict and number of soft failures."""
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.col(text).alias("text"),
    )
    counted = measure(base).withColumn("t", F.xxhash64("text")).withColumn("counts", let(words_of(F.col("text")), word_counts))
    out = counted.select(
        "doc_id", "t", "host", "counts.n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "counts.n_repeat_words"
    )
    n = F.col("n_words")
    soft = [
        10 * F.col("n_symbols") > n,
        (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        10 * F.col("n_repeat_words") > 3 * n,
    ]
    return out.withColumns(
        {
            "base_failed": (n < 50) | (100 * F.col("n_repeat_words") > 50 * n),
            "n_soft": sum((x.cast("int") for x in soft), F.lit(0)),
        }
    )


def host_verdicts(rules: DataFrame) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and verdict.

    The prior Beta(m*s, (1-m)*s) has the corpus mean m and a strength s from the spread of
    the hosts' rates beyond binomial noise, held within [1, 10000].
    """
    failed = (F.col("base_failed") | (F.col("n_soft") > 0)).cast("long")
    hosts = stored(rules.groupBy("host").agg(F.count("*").alias("n"), F.sum(failed).alias("n_failed")), "hosts")
    m, spread, noise = hosts.agg(
        F.sum("n_failed") / F.sum("n"),
        F.var_pop(F.col("n_failed") / F.col("n")),
        F.avg(1 / F.col("n")),
    ).first()
    m = m or 0.0
    excess = (spread or 0.0) - m * (1 - m) * (noise or 0.0)
    s = min(10_000.0, max(1.0, m * (1 - m) / excess - 1)) if excess > 0 else 10_000.0
    rate = (F.col("n_failed") + F.lit(m * s)) / (F.col("n") + F.lit(s))
    return hosts.withColumn("host_rate", F.round(rate, 6)).withColumn(
        "host_verdict",
        F.when(F.col("host_rate") >= BLOCK, "block").when(F.col("host_rate") >= WATCH, "watch").otherwise("pass"),
    )


def quality_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """Measures, base verdict, host verdict, ``kept`` and ``t``, the text's hash, per document.

    The measures are written once to shared storage, as both the host sums and the join need
    them. A host may own a third of the documents, so the join deals its documents to SALTS keys.
    """
    rules = stored(document_rules(docs, **columns), "rules")
    hosts = host_verdicts(rules).select("host", "host_rate", "host_verdict")
    salted = rules.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    dealt = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    bad = (F.col("host_verdict") == "block") | ((F.col("host_verdict") == "watch") & (F.col("n_soft") > 0))
    return salted.join(dealt, ["host", "salt"]).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~bad).alias("kept"),
        "n_soft",
        "host_rate",
        "host_verdict",
        "t",
    )
