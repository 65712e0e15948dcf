"""Quality rules with host verdicts, in DataFrame operations only.

Every text is measured in its own row: no shuffle of words. The measures of all
documents are written once; failures are then counted by host (partial sums
before the shuffle), each host's failure rate is shrunk towards a beta prior
estimated from all hosts, and the verdict is joined back by host (a hot host is
split by the adaptive skew join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.shared import bind, table, text_of, words_of
from inkstone.session import materialize

SYMBOLS = r"[#*$%&|<>]"


def _covered(grams: Column) -> Column:
    """Words in windows of three that occur at least twice; ``grams``: the windows' hashes in order."""

    def marked(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, i: F.coalesce(
                (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]),
                x["h"] == F.get(ordered, i - 1)["h"], x["h"] == F.get(ordered, i + 1)["h"], F.lit(False),
            ),
        )
        places = F.array_sort(F.transform(twice, lambda x: x["p"]))
        total = F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct(
                (acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n"), p.alias("last")
            ),
        )
        return total["n"]

    pairs = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(
        bind(F.array_sort(pairs), marked)
    )


def _word_facts(words: Column) -> Column:
    n = F.size(words)
    grams = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<long>"))
    return F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        bind(grams, _covered).alias("n_repeat_words"),
    )


def document_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    A null text counts as empty: all measures 0, base_failed true. Windows of
    three words are compared by 64-bit hash. Columns of ``docs`` with one of
    these names are replaced.
    """
    body = text_of(text)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn(
        "_line_facts",
        bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
    ).withColumn("_word_facts", bind(words_of(body), _word_facts))
    w, x = F.col("_word_facts"), F.col("_line_facts")
    out = out.withColumns(
        {
            "n_words": w["n_words"], "word_chars": w["word_chars"],
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_lines": x["n"], "n_dup_lines": x["dup"], "n_repeat_words": w["n_repeat_words"],
            "base_failed": (w["n_words"] < 50) | (100 * w["n_repeat_words"] > 50 * w["n_words"]),
        }
    )
    return out.drop("_word_facts", "_line_facts")


def host_verdicts(facts: DataFrame, host: str = "host", failed: str = "failed", reject_above: float = 0.6) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, verdict.

    The prior is a beta distribution with the mean and variance of the hosts'
    own rates (method of moments; where they do not vary, or there is one host,
    the hosts' pooled rate with the weight of 1000 documents). Null hosts form
    one host of their own. No rows in, no rows out.
    """
    hosts = materialize(
        facts.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")),
        "hosts",
    )
    rate = F.col("n_failed") / F.col("n_docs")
    p = hosts.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.sum("n_failed").alias("k"), F.sum("n_docs").alias("n")).first()
    mean = p["mean"] or 0.0
    if p["var"] and 0 < mean < 1 and mean * (1 - mean) > p["var"]:
        weight = mean * (1 - mean) / p["var"] - 1
    else:
        weight, mean = 1000.0, (p["k"] / p["n"] if p["n"] else 0.0)
    shrunk = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > reject_above).alias("host_rejected"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", reject_above: float = 0.6) -> DataFrame:
    """Measures, host verdict and ``kept`` for every document; one row per row of ``docs``.

    A document fails where a base rule fails, more than a tenth as many symbols
    as words occur, or over three tenths of its lines repeat an earlier one.
    Kept: no base rule fails and the host's shrunk failure rate is at most
    ``reject_above``. Rows that repeat count as often as they occur.
    """
    measured = document_measures(docs.select("doc_id", F.col(host).alias("host"), F.col(text).alias("text")))
    facts = materialize(
        measured.drop("text").withColumn(
            "failed",
            F.col("base_failed") | (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        ),
        "quality",
    )
    verdicts = host_verdicts(facts, reject_above=reject_above).select(F.col("host").alias("_host"), "host_rate", "host_rejected")
    joined = facts.join(verdicts, facts["host"].eqNullSafe(verdicts["_host"]), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept"
    )


QUERIES = {"op10_quality_rules": op10_quality_rules}

ORACLE_SQL = {
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, p, words[p] AS a, words[p + 1] AS b, words[p + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id),
f AS (SELECT d.doc_id, source, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS wc,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines) AS k FROM b GROUP BY source),
m AS (SELECT avg(k / n) AS mean, var_samp(k / n) AS v, sum(k) / sum(n) AS pooled FROM h),
p AS (SELECT CASE WHEN v > 0 AND mean > 0 AND mean < 1 AND mean * (1 - mean) > v THEN mean ELSE pooled END AS mean,
    CASE WHEN v > 0 AND mean > 0 AND mean < 1 AND mean * (1 - mean) > v THEN mean * (1 - mean) / v - 1 ELSE 1000 END AS weight FROM m),
s AS (SELECT source, (k + mean * weight) / (n + weight) > 0.6 AS host_rejected FROM h, p)
SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
  NOT base_failed AND NOT host_rejected AS kept
FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source
"""
}
