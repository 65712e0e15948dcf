"""Signals, bands and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import let, sentences, word_count


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null: greatest and least alone would skip it."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ai_signal(value: Column, low: float | Column, high: float | Column) -> Column:
    """1 at or below ``low``, 0 at or above ``high``, 0.5 where unmeasurable."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    unknown = value.isNull() | F.isnan(value) | lo.isNull() | hi.isNull() | (hi <= lo)
    return F.when(unknown, 0.5).otherwise(1.0 - clamp((value - lo) / (hi - lo), 0.0, 1.0))


def ai_likelihood(
    perplexity: Column, burstiness: Column, marker: Column, uniformity: Column,
    weights: dict[str, float] | None = None,
) -> Column:
    """Weighted mean of four 0..1 signals on a 0..100 scale, one decimal."""
    w = weights or L.SCORE_WEIGHTS
    total = sum(w.values())
    raw = (
        w["perplexity"] * perplexity + w["burstiness"] * burstiness
        + w["marker"] * marker + w["uniformity"] * uniformity
    ) / total
    return F.round(clamp(raw * 100, 0.0, 100.0), 1)


def verdict_band(score: Column, labels: tuple[str, str, str] = ("likely_ai", "likely_human", "uncertain")) -> Column:
    ai, human, mid = labels
    return F.when(score >= L.AI_AT, ai).when(score <= L.HUMAN_AT, human).when(score.isNotNull(), mid)


def confidence_band(score: Column) -> Column:
    d = F.abs(score - 50.0)
    return F.when(d >= 30, "high").when(d >= 15, "medium").otherwise("low")


def code_confidence(n_lines: Column) -> Column:
    return F.when(n_lines >= 60, "High").when(n_lines >= 20, "Medium").otherwise("Low")


def similarity_band(pct: Column) -> Column:
    return F.when(pct >= 50, "flag").when(pct >= 25, "uncertain").otherwise("low")


def sentence_heat_band(ppl: Column) -> Column:
    return F.when(ppl < 25, "machine").when(ppl > 50, "human").otherwise("uncertain")


def sentence_uniformity(c: Column) -> Column:
    """1 for equal sentence lengths, 0 from a coefficient of variation of 0.5 on."""
    lengths = F.filter(F.transform(sentences(c), word_count), lambda n: n >= 3)

    def measure(a: Column) -> Column:
        n = F.size(a)
        sums = F.aggregate(
            a, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
            lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q")),
        )

        def cv(v: Column) -> Column:
            mean = v["s"] / n
            var = F.greatest(v["q"] / n - mean * mean, F.lit(0.0))
            return clamp(1.0 - F.sqrt(var) / (mean + 1e-8) / 0.5, 0.0, 1.0)

        return F.when(n < 2, 0.5).otherwise(let(sums, cv))

    return let(lengths, measure)


def marker_density(c: Column, markers: list[str] | None = None, max_ngram: int = 2) -> Column:
    """Marker hits per word, scaled so that one in thirty words gives 1.

    Only unigrams and bigrams of ``[a-z]+`` words are looked up by default, so
    longer entries never hit; raise ``max_ngram`` to count them.
    """
    lexicon = list(markers if markers is not None else L.MARKERS)
    found = F.regexp_extract_all(F.lower(c), F.lit(r"\b[a-z]+\b"), F.lit(0))

    def count_in(grams: Column, keys: list[str]) -> Column:
        return F.size(F.filter(grams, lambda g: g.isin(*keys)))

    def joined(w: Column, n: int) -> Column:
        m = F.greatest(F.size(w) - (n - 1), F.lit(0))
        parts = F.arrays_zip(*[F.slice(w, F.lit(i + 1), m).alias(f"g{i}") for i in range(n)])
        return F.transform(parts, lambda z: F.concat_ws(" ", *[z[f"g{i}"] for i in range(n)]))

    def hits(w: Column) -> Column:
        total = F.lit(0)
        for n in range(1, max_ngram + 1):
            keys = [m for m in lexicon if len(m.split(" ")) == n]
            if keys:
                total = total + count_in(w if n == 1 else joined(w, n), keys)
        return F.when(F.size(w) == 0, 0.0).otherwise(F.least(total / F.size(w) * 30, F.lit(1.0)))

    return let(found, hits)


def wilson(k: Column, n: Column, z: float = L.WILSON_Z) -> Column:
    """``struct<low, high>``: 95 % score interval for k successes of n."""
    nn = F.when(n > 0, n.cast("double"))
    p = k / nn
    denom = 1 + z * z / nn
    centre = p + z * z / (2 * nn)
    half = z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn))
    low = F.coalesce(F.greatest(F.lit(0.0), (centre - half) / denom), F.lit(0.0))
    high = F.coalesce(F.least(F.lit(1.0), (centre + half) / denom), F.lit(0.0))
    return F.struct(low.alias("low"), high.alias("high"))


def ratio_score(ratio: Column) -> Column:
    """Two-model ratio on the 0..100 scale; lower ratios are more machine-like."""
    ai, human = L.RATIO_BAND
    return (
        F.when(ratio.isNull() | F.isnan(ratio), 50.0)
        .when(ratio <= ai, F.least(F.lit(100.0), 75.0 + (ai - ratio) / ai * 200.0))
        .when(ratio >= human, F.greatest(F.lit(0.0), 25.0 - (ratio - human) / human * 200.0))
        .otherwise(75.0 - (ratio - ai) / (human - ai) * 50.0)
    )


def ratio_confidence(ratio: Column, n_words: Column) -> Column:
    ai, human = L.RATIO_BAND
    margin = F.least(F.abs(ratio - ai), F.abs(ratio - human))
    return (
        F.when(n_words < 120, "low").when(margin > 0.12, "high").when(margin > 0.05, "medium").otherwise("low")
    )
