"""Rates, intervals and ranking quality of a detector on labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scores as B
from .ordered import running_sums


def stratified_sample(
    samples: DataFrame, k: int, by: str = "group", id_col: str = "doc_id", seed: int = 0
) -> DataFrame:
    """``k`` rows per group in the order of a seeded hash of the id.

    The limit on the row number is applied before the shuffle, so a group that
    holds most rows is not gathered in one task.
    """
    salt = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(id_col).cast("string")))
    w = Window.partitionBy(by).orderBy(salt, id_col)
    return samples.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def sample_score_join(samples: DataFrame, scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every sample with its score; null means skipped."""
    return samples.join(scores.select(id_col, "score"), id_col, "left")


def group_eval(scored: DataFrame, by: tuple = ("label", "group"), ai_at: float = L.AI_AT) -> DataFrame:
    s = F.col("score")
    ai, human = s >= ai_at, s <= L.HUMAN_AT
    out = scored.groupBy(*by).agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"), F.count_if(ai).alias("called_ai"),
        F.count_if(~ai & ~human).alias("uncertain"), F.count_if(human & ~ai).alias("called_human"),
        F.count_if(s.isNull()).alias("skipped"),
    )
    ci = B.wilson(F.col("called_ai"), F.col("n"))
    return out.withColumn("ci_low", ci["low"]).withColumn("ci_high", ci["high"])


def score_histogram(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score: the state everything below needs."""
    return scored.filter(F.col("score").isNotNull()).groupBy("score").agg(
        F.count_if(F.col("label") == "ai").alias("pos"), F.count_if(F.col("label") == "human").alias("neg")
    )


def auroc(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """Chance that an AI text outscores a human one, ties count half.

    Exact for scores of any scale and number of digits (``digits`` rounds them
    first): running sums go by sampled ranges of the scores, so no task orders all.
    """
    exact = scored if digits is None else scored.withColumn("score", F.round("score", digits))
    hist = running_sums(score_histogram(exact), [], "score", {"neg": "lower"})
    wins = F.col("pos") * (F.col("lower") + F.col("neg") / 2.0)
    return hist.select("pos", "neg", wins.alias("wins")).agg(
        (F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"),
        F.sum("pos").alias("ai_n"), F.sum("neg").alias("human_n"),
    )


def fpr_tpr_summary(scored: DataFrame, ai_at: float = L.AI_AT) -> DataFrame:
    s, human, ai = F.col("score"), F.col("label") == "human", F.col("label") == "ai"
    out = scored.agg(
        F.count_if(human & (s >= ai_at)).alias("false_positives"), F.count_if(human & s.isNotNull()).alias("human_n"),
        F.count_if(ai & (s >= ai_at)).alias("true_positives"), F.count_if(ai & s.isNotNull()).alias("ai_n"),
    )
    fp = B.wilson(F.col("false_positives"), F.col("human_n"))
    tp = B.wilson(F.col("true_positives"), F.col("ai_n"))
    return out.select("*", fp["low"].alias("fpr_low"), fp["high"].alias("fpr_high"),
                      tp["low"].alias("tpr_low"), tp["high"].alias("tpr_high"))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """FPR and TPR at each threshold, from one pass over the scores."""
    s, human, ai = F.col("score"), F.col("label") == "human", F.col("label") == "ai"
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    hist = scored.filter(s.isNotNull()).groupBy("score").agg(
        F.count_if(human).alias("h"), F.count_if(ai).alias("a")
    ).select("*", at)
    hit = s >= F.col("threshold")
    return hist.groupBy("threshold").agg(
        (F.sum(F.when(hit, F.col("h")).otherwise(0)) / F.nullif(F.sum("h"), F.lit(0))).alias("fpr"),
        (F.sum(F.when(hit, F.col("a")).otherwise(0)) / F.nullif(F.sum("a"), F.lit(0))).alias("tpr"),
    )


def base_rate_precision(summary: DataFrame, prevalence: float = 0.10) -> DataFrame:
    """Share of accusations that are right where ``prevalence`` of texts are AI."""
    tpr = F.col("true_positives") / F.nullif(F.col("ai_n"), F.lit(0))
    fpr = F.col("false_positives") / F.nullif(F.col("human_n"), F.lit(0))
    hit = prevalence * tpr
    return summary.select(
        F.lit(prevalence).alias("prevalence"), tpr.alias("tpr"), fpr.alias("fpr"),
        (hit / F.nullif(hit + (1 - prevalence) * fpr, F.lit(0.0))).alias("precision"),
    )


def robustness_flip(before: DataFrame, after: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What a perturbation does to the AI texts that were caught."""
    caught = before.filter((F.col("label") == "ai") & (F.col("score") >= L.AI_AT))
    both = caught.join(after.select(id_col, F.col("score").alias("after")), id_col).filter(F.col("after").isNotNull())
    out = both.agg(
        F.count("*").alias("n"), F.avg(F.col("after") - F.col("score")).alias("mean_delta"),
        F.count_if(F.col("after") < L.AI_AT).alias("no_longer_ai"),
        F.count_if(F.col("after") <= L.HUMAN_AT).alias("now_human"),
    )
    ci = B.wilson(F.col("no_longer_ai"), F.col("n"))
    return out.withColumn("flip_low", ci["low"]).withColumn("flip_high", ci["high"])


def detector_agreement_matrix(scored: DataFrame, first: str, second: str) -> DataFrame:
    """Both or either flagged, among texts that two detectors scored."""
    a, b = F.col(first) >= L.AI_AT, F.col(second) >= L.AI_AT
    return scored.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(a).alias("first_flagged"), F.count_if(b).alias("second_flagged"),
        F.count_if(a & b).alias("both_flagged"), F.count_if(a | b).alias("either_flagged"),
    )
