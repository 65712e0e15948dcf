"""Several detectors' opinions on one document, kept apart and compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scores as B
from ..functions import values as V

OPINION_COLUMNS = ["doc_id", "provider", "ai_probability", "verdict", "confidence", "explanation", "error", "elapsed_ms"]


def provider_case(pick: int, default) -> Column:
    """A provider's fixed fact as a CASE: the registry has six entries."""
    case = None
    for row in L.PROVIDERS:
        hit = F.col("provider") == row[0]
        case = F.when(hit, F.lit(row[pick])) if case is None else case.when(hit, F.lit(row[pick]))
    return case.otherwise(default)


def registry_order() -> Column:
    case = None
    for i, row in enumerate(L.PROVIDERS):
        hit = F.col("provider") == row[0]
        case = F.when(hit, i) if case is None else case.when(hit, i)
    return case.otherwise(99)


def provider_meta_join(opinions: DataFrame) -> DataFrame:
    return (
        opinions.withColumn("label", provider_case(1, F.col("provider")))
        .withColumn("local", provider_case(2, F.lit(True)))
        .withColumn("paid", provider_case(3, F.lit(False)))
        .withColumn("registry_order", registry_order())
    )


def ran() -> Column:
    return F.col("ai_probability").isNotNull() & F.col("error").isNull()


def normalise_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Raw reply texts to the opinion columns."""
    r = replies.withColumn("r", V.normalise_reply(V.parse_reply(F.col(reply))))
    return r.select(*[c for c in replies.columns if c != reply], "r.*")


def _facts(opinions: DataFrame, keys: list[str]) -> DataFrame:
    ok, p = ran(), F.col("ai_probability")
    return opinions.groupBy(*keys).agg(
        F.count_if(ok).alias("providers_ran"),
        F.min(F.when(ok, p)).alias("lo"), F.max(F.when(ok, p)).alias("hi"),
        F.min(F.when(ok, F.col("verdict"))).alias("v_min"), F.max(F.when(ok, F.col("verdict"))).alias("v_max"),
        F.min(F.when(ok, F.col("provider"))).alias("only"),
    )


def detector_consensus(opinions: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:
    """How far the detectors that ran agree; their scores are never averaged."""
    f = _facts(opinions, keys)
    n, spread = F.col("providers_ran"), F.col("hi") - F.col("lo")
    kind = (
        F.when(n == 0, "none").when(n == 1, "single").when(F.col("v_min") == F.col("v_max"), "unanimous")
        .when(spread >= L.CONFLICT_SPREAD, "conflicted").otherwise("mixed")
    )
    return f.select(
        *keys, kind.alias("agreement"), "providers_ran",
        F.round("lo", 1).alias("min_score"), F.round("hi", 1).alias("max_score"), F.round(spread, 1).alias("spread"),
    )


def _spoken(v: Column) -> Column:
    return F.when(v == "likely_ai", "Likely AI").when(v == "likely_human", "Likely Human").otherwise("Uncertain")


def detector_headline(opinions: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:
    """One verdict per document: directional only where all that ran agree.

    The local detector alone may not accuse: its "Likely AI" becomes
    "Uncertain". ``basis`` says how the verdict came about.
    """
    f = _facts(opinions, keys).withColumn("provider", F.col("only"))
    n, one = F.col("providers_ran"), F.col("v_min") == F.col("v_max")
    capped = (n == 1) & (F.col("only") == "heuristic") & (F.col("v_min") == "likely_ai")
    basis = (
        F.when(n == 0, "none").when(capped, "single_capped").when(n == 1, "single")
        .when(one, "agreement").otherwise("disagreement")
    )
    who = provider_case(1, F.col("provider"))
    span = F.concat(F.round("lo", 0).cast("int").cast("string"), F.lit("–"), F.round("hi", 0).cast("int").cast("string"))
    reason = (
        F.when(n == 0, "No detector was able to score this text.")
        .when(capped, F.concat(F.lit("Only one detector ran ("), who, F.lit("), and it leans towards AI.")))
        .when(n == 1, F.concat(F.lit("Based on one detector only ("), who, F.lit(").")))
        .when(one, F.concat(F.lit("All "), n.cast("string"), F.lit(" detectors that ran agree.")))
        .otherwise(F.concat(F.lit("The "), n.cast("string"), F.lit(" detectors that ran disagree ("), span, F.lit("% AI).")))
    )
    verdict = F.when((n == 0) | capped | ~one, "Uncertain").otherwise(_spoken(F.col("v_min")))
    return f.select(*keys, verdict.alias("verdict"), basis.alias("basis"), reason.alias("reason"), "providers_ran")


def local_opinion(scored: DataFrame) -> DataFrame:
    """The document score as the local detector's opinion (confidence is always low)."""
    return scored.select(
        "doc_id", F.lit("heuristic").alias("provider"), F.col("score").alias("ai_probability"),
        F.coalesce(B.verdict_band(F.col("score")), F.lit("unavailable")).alias("verdict"),
        F.lit("low").alias("confidence"), F.lit("").alias("explanation"),
        F.when(F.col("score").isNull(), "not enough analysable text").alias("error"),
        F.lit(0).alias("elapsed_ms"),
    )


def detector_plugin(name: str, scorer: Callable, docs: DataFrame) -> DataFrame:
    """Opinions of a Python scorer of text batches.

    ``scorer()`` is called once per task and returns a function from a pandas
    series of texts to a series of scores. A batch it fails on becomes rows
    with ``error`` set; the job goes on.
    """

    def run(batches):
        import time

        import pandas as pd

        score = None
        for b in batches:
            t0, err, vals = time.perf_counter(), None, None
            try:
                score = score or scorer()
                vals = pd.Series(score(b["text"]), index=b.index, dtype="float64")
            except Exception as exc:  # noqa: BLE001
                err = f"{type(exc).__name__}: {exc}"[:200]
            ms = int((time.perf_counter() - t0) * 1000 / max(len(b), 1))
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "provider": name,
                "ai_probability": vals if vals is not None else pd.Series([None] * len(b), dtype="float64", index=b.index),
                "error": pd.Series([err] * len(b), dtype="object", index=b.index), "elapsed_ms": ms,
            })

    schema = "doc_id long, provider string, ai_probability double, error string, elapsed_ms int"
    raw = docs.select("doc_id", "text").mapInPandas(run, schema)
    score = B.clamp(F.when(~F.isnan("ai_probability"), F.col("ai_probability")), 0.0, 100.0)
    return raw.withColumn("ai_probability", score).select(
        "doc_id", "provider", F.when(F.col("error").isNull(), F.col("ai_probability")).alias("ai_probability"),
        F.when(F.col("error").isNull(), F.coalesce(B.verdict_band(F.col("ai_probability")), F.lit("unavailable")))
        .otherwise("unavailable").alias("verdict"),
        F.lit("low").alias("confidence"), F.lit("").alias("explanation"), "error", "elapsed_ms",
    )
