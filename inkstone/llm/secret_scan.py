"""Secret scan in column expressions only: fixed patterns, and windows of high Shannon entropy.

Everything happens in the row that holds the text, so nothing is shuffled.
Matches and the text between them give each match's place; the entropy of a
sliding window over a candidate string is kept as integer sums that change by
one character entering and one leaving.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.shared import bind, running_starts, table, text_of

# The kinds of secret and their patterns, in order of rank.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

# Candidate strings, character classes with the bits per character that make a
# window suspicious, and what is never reported by entropy.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("letters", r"^[A-Za-z]+$", 4.2), ("mixed", r"^", 3.7))
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|changeme|redacted|xxxx",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9/_=+-]+$",
    r"^/?([A-Za-z_-]+/)+[A-Za-z_-]*$",
    r"(?i)abcdefghij|0123456789",
)

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: count * log2(count) in millionths, so that sums are exact integers.
PARTS = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


def ceiling(bits: float, window: int = WINDOW) -> int:
    """A window has at least ``bits`` per character if its parts sum to no more than this."""
    return math.floor(1e6 * window * (math.log2(window) - bits))


def _places(text: Column, pattern: str) -> Column:
    """Array of (start, stop, match) of all leftmost non-overlapping matches, in code points."""
    kind = "array<struct<start:bigint,stop:bigint,found:string>>"

    def located(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
            return bind(
                running_starts(steps),
                lambda at: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(at, i) + F.length(F.get(gaps, i))).alias("start"),
                        (F.get(at, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("stop"),
                        m.alias("found"),
                    ),
                ),
            )

        return F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(bind(F.split(text, pattern, -1), placed).cast(kind))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def _kept_assigns(text: Column) -> Column:
    def checked(all_: Column) -> Column:
        return F.when(F.size(all_) == 0, all_).otherwise(
            F.filter(all_, lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= 6)
        )

    return bind(_places(text, ASSIGN), checked)


def window_minimum(candidate: Column, window: int = WINDOW) -> Column:
    """Least sum of count * log2(count) over all windows of ``candidate`` (the least sum is the highest entropy)."""
    parts = F.array(*[F.lit(x) for x in PARTS])

    def scanned(codes: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0).alias("total"), F.lit(2**31 - 1).alias("least")
        )

        def step(acc: Column, i: Column) -> Column:
            came, left = F.get(codes, i), F.coalesce(F.get(codes, i - window), F.lit(-1))
            n_came, n_left = F.get(acc["counts"], came), F.get(acc["counts"], left)
            change = F.when(came == left, F.lit(0)).otherwise(
                F.get(parts, n_came + 1) - F.get(parts, n_came)
                + F.when(left < 0, F.lit(0)).otherwise(F.get(parts, n_left - 1) - F.get(parts, n_left))
            )
            counts = F.transform(
                acc["counts"],
                lambda v, j: v + F.when(j == came, F.lit(1)).otherwise(F.lit(0)) - F.when(j == left, F.lit(1)).otherwise(F.lit(0)),
            )
            return bind(
                acc["total"] + change,
                lambda total: F.struct(
                    counts.alias("counts"), total.alias("total"),
                    F.when(i >= window - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"),
                ),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["least"])

    letters = F.array_remove(F.split(candidate, ""), "")
    return bind(F.transform(letters, lambda c: F.position(c, F.lit(ALPHABET)).cast("int")), scanned)


def _suspicious(candidate: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    limit = F.when(F.lit(False), F.lit(0))
    for _, pattern, bits in CLASSES:
        limit = limit.when(candidate.rlike(pattern), F.lit(ceiling(bits)))
    return F.when(allowed, F.lit(False)).otherwise(window_minimum(candidate) <= limit)


def secret_spans(text: Column) -> Column:
    """Array of (start, rank, stop) of all spans in ``text``, ordered by start, then by kind."""

    def ranked(spans: Column, rank: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop")))

    likely = bind(
        _places(text, CANDIDATE),
        lambda all_: F.when(F.size(all_) == 0, all_).otherwise(F.filter(all_, lambda x: _suspicious(x["found"]))),
    )
    return F.array_sort(
        F.concat(ranked(_kept_assigns(text), 0), ranked(_places(text, ACCESS), 1), ranked(_places(text, HEX), 2), ranked(likely, 3))
    )


def spans_text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``, the array of spans (start, rank in KINDS, stop; code points, stop exclusive).

    A null or empty text has no spans. Every row is scanned by itself, so
    repeated rows give repeated results.
    """
    return docs.withColumn("secrets", secret_spans(text_of(text)))


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; spans that touch or overlap get one mark."""

    def merged(spans: Column) -> Column:
        # array_sort puts the spans in order of start: a span opens a new part if it starts after all earlier stops
        first = F.struct(F.lit(0).cast("long").alias("stop"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, x: Column) -> Column:
            fresh = (x["start"] > acc["stop"]) | (F.size(acc["parts"]) == 0)
            piece = F.concat(
                F.substring(F.col(text), (acc["stop"] + 1).cast("int"), F.greatest(x["start"] - acc["stop"], F.lit(0)).cast("int")), F.lit(mark)
            )
            return F.struct(
                F.greatest(acc["stop"], x["stop"]).alias("stop"),
                F.when(fresh, F.array_append(acc["parts"], piece)).otherwise(acc["parts"]).alias("parts"),
            )

        return F.aggregate(
            spans, first, step,
            lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col(text), (acc["stop"] + 1).cast("int"), F.length(F.col(text)))),
        )

    cut = bind(secret_spans(text_of(text)), lambda spans: F.when(F.size(spans) > 0, merged(spans)).otherwise(F.col(text)))
    return docs.withColumn(text, cut)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(F.col("secrets"), lambda x: x["rank"] < 3)
    count = lambda rank: F.size(F.filter(F.col("secrets"), lambda x: x["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_entropy"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("secrets")).alias("spans"),
    )


QUERIES = {"op3_secret_scan": op3_secret_scan}


def _places_sql(name: str, pattern: str, options: str = "") -> str:
    """CTE of doc_id, start, stop, found for one pattern: matches and the gaps between them, summed up."""
    p = pattern.replace("'", "''")
    return f"""
{name}_m AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{p}'), lambda x: x) AS ms, string_split_regex(text, '{p}') AS gs
  FROM d WHERE regexp_matches(text, '{p}')),
{name} AS (SELECT doc_id, found, start + g AS start, start + g + length(found) AS stop FROM (
  SELECT doc_id, found, g, coalesce(sum(g + length(found)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, i, ms[i] AS found, length(gs[i]) AS g FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM {name}_m))))"""


def _oracle() -> str:
    allowed = " OR ".join(f"regexp_matches(found, '{p}')" for p in ALLOWED)
    limit = "CASE " + " ".join(f"WHEN regexp_matches(found, '{p}') THEN {ceiling(bits)}" for _, p, bits in CLASSES) + " END"
    assign = ASSIGN.replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_places_sql("assign", ASSIGN)},
{_places_sql("access", ACCESS)},
{_places_sql("hex", HEX)},
{_places_sql("cand", CANDIDATE)},
win AS (SELECT found, i, unnest(string_split(substr(found, i, {WINDOW}), '')) AS ch
  FROM (SELECT found, unnest(range(1, length(found) - {WINDOW} + 2)) AS i FROM (SELECT DISTINCT found FROM cand WHERE NOT ({allowed})))),
least AS (SELECT found, min(total) AS total FROM (
  SELECT found, i, sum(CAST(round(1e6 * n * log2(n)) AS BIGINT)) AS total
  FROM (SELECT found, i, ch, count(*) AS n FROM win GROUP BY ALL) GROUP BY found, i) GROUP BY found),
hot AS (SELECT found FROM least WHERE total <= {limit}),
s AS (SELECT doc_id, 0 AS rank, 'assign' AS kind, start, stop FROM assign WHERE length(regexp_extract(found, '{assign}', 2)) >= 6
  UNION ALL SELECT doc_id, 1, 'access', start, stop FROM access
  UNION ALL SELECT doc_id, 2, 'hex', start, stop FROM hex
  UNION ALL SELECT doc_id, 3, 'entropy', start, stop FROM cand WHERE found IN (SELECT found FROM hot)),
a AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n0, count(*) FILTER (WHERE rank = 1) AS n1, count(*) FILTER (WHERE rank = 2) AS n2,
    count(*) FILTER (WHERE rank = 3) AS n3,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  coalesce(n3, 0)::BIGINT AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


ORACLE_SQL = {"op3_secret_scan": _oracle()}
