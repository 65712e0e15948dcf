"""Toxicity: averaged embeddings of subwords under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, so a misspelling that was
never seen shares vectors with the word it resembles. A window of ``WINDOW`` words
is the average of its subwords' vectors; a document's score is that of its most
toxic window, so that a long clean text does not hide an insult. Because softmax
of an average is linear in the vectors, scoring needs one number per subword:
per-word sums, running sums over words, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.llm.grams import hashed_grams, pieces, split_words, word_sums
from inkstone.llm.shared import bounded_sample, release_memory, table

LOW, HIGH, BITS, DIM, WINDOW = 3, 5, 18, 8, 16
WIDE_STEPS, NARROW_STEPS, HALF_BATCH, VECTOR_RATE, DECAY = 250, 450, 32, 50.0, 0.995
TRIM = ".,;:!?\"'()[]{}<>|#*$%&-_«»„“”’…"


@dataclass
class ToxicityModel:
    """One number per subword bucket (toxic minus clean logit), bias, and the scale and shift of the final score."""

    values: np.ndarray
    bias: float
    scale: float
    shift: float

    def window_logits(self, texts: list[str | None]) -> np.ndarray:
        """Highest window logit of each text; texts without a word get that of an empty window."""
        out = np.full(len(texts), -np.inf)
        for rows, parts in pieces(texts, overlap=400):
            owner, codes, distinct = split_words(parts)
            if not len(codes):
                continue
            sums, counts = word_sums([w.strip(TRIM) for w in distinct], LOW, HIGH, BITS, self.values[None, :], whole=True)
            best = _best_windows(sums[0][codes], counts[codes], owner)[0]
            np.maximum.at(out, np.asarray(rows)[np.unique(owner)], best)
        return np.where(np.isneginf(out), 0.0, out) + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.window_logits(texts) + self.shift, -30, 30)))


def _best_windows(values: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest average of any WINDOW words of each owner (owners ascending), and where that window starts."""
    n = len(values)
    v, c = np.concatenate([[0.0], np.cumsum(values)]), np.concatenate([[0.0], np.cumsum(counts)])
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    last = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    at = np.arange(n)
    stop = np.minimum(at + WINDOW, last)
    mean = (v[stop] - v[at]) / np.maximum(c[stop] - c[at], 1)
    whole = at + WINDOW <= last
    whole[first] = True
    mean = np.where(whole, mean, -np.inf)
    best = np.maximum.reduceat(mean, first)
    place = np.flatnonzero(mean == np.repeat(best, np.diff(np.r_[first, n])))
    kept = np.unique(owner[place], return_index=True)[1]
    return best, place[kept]


def _fit(texts: list[str], truth: np.ndarray, seed: int = 7) -> ToxicityModel:
    rng = np.random.default_rng(seed)
    owner, codes, distinct = split_words(texts)
    bucket, word = hashed_grams([w.strip(TRIM) for w in distinct], LOW, HIGH, BITS, whole=True)
    n_grams = np.bincount(word, minlength=len(distinct))
    start = np.concatenate([[0], np.cumsum(n_grams)])
    present = np.unique(owner)
    label = truth[present]
    calibrating = rng.random(len(present)) < 0.2
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    stop = np.r_[first[1:], len(owner)]
    vectors = np.zeros((1 << BITS, DIM))
    head = rng.normal(0, 1 / np.sqrt(DIM), (DIM, 2))
    bias = np.zeros(2)
    head_spread = np.full((DIM, 2), 1e-8)

    def step(begins: np.ndarray, ends: np.ndarray, y: np.ndarray, rate: float) -> None:
        nonlocal head, bias, vectors
        sizes = ends - begins
        at = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        w = codes[at]
        k = n_grams[w]
        gram = bucket[np.repeat(start[w] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())]
        window = np.repeat(np.repeat(np.arange(len(begins)), sizes), k)
        total = np.bincount(window, minlength=len(begins))
        edges = np.concatenate([[0], np.cumsum(total)[:-1]])
        mean = np.add.reduceat(vectors[gram], edges, axis=0) / total[:, None]
        logits = mean @ head + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g_head = mean.T @ p / len(y)
        g_mean = p @ head.T
        order = np.argsort(gram, kind="stable")
        own = gram[order]
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        g = np.add.reduceat((g_mean / total[:, None])[window[order]], cut, axis=0)
        own = own[cut]
        vectors[own] -= VECTOR_RATE * rate * g
        vectors *= DECAY
        head_spread[:] += g_head * g_head
        head -= 0.1 * rate * g_head / np.sqrt(head_spread)
        bias -= 0.1 * rate * p.mean(axis=0)

    def logits() -> tuple[np.ndarray, np.ndarray]:
        value = vectors @ (head[:, 1] - head[:, 0])
        sums = np.bincount(word, weights=value[bucket], minlength=len(distinct))
        return _best_windows(sums[codes], n_grams[codes].astype(float), owner)

    fit = np.flatnonzero(~calibrating)
    toxic, clean = fit[label[fit] == 1], fit[label[fit] == 0]
    if not len(toxic) or not len(clean):
        toxic, clean = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    # first wide windows anywhere in as many toxic as clean texts, then each text's currently most
    # toxic window, and for clean texts another one beside it
    for k in range(WIDE_STEPS + NARROW_STEPS):
        narrow = k >= WIDE_STEPS
        both = np.concatenate([rng.choice(toxic, HALF_BATCH), rng.choice(clean, HALF_BATCH)])
        y = np.repeat([1, 0], HALF_BATCH)
        span = WINDOW if narrow else 6 * WINDOW
        begins = first[both] + (rng.random(len(both)) * np.maximum(stop[both] - first[both] - span + 1, 1)).astype(int)
        if narrow:
            if (k - WIDE_STEPS) % 30 == 0:
                worst = logits()[1]
            begins = np.concatenate([worst[both], begins[HALF_BATCH:]])
            both, y = np.concatenate([both, both[HALF_BATCH:]]), np.concatenate([y, np.zeros(HALF_BATCH, dtype=int)])
        step(begins, np.minimum(begins + span, stop[both]), y, 0.2 if narrow else 0.5)
    best = logits()[0] + bias[1] - bias[0]
    # the final score: logistic regression of the label on the highest window logit, by Newton steps with a little ridge
    use = calibrating if len(np.unique(label[calibrating])) == 2 else np.ones(len(label), dtype=bool)
    # (toxic rows weigh more the rarer they are, by the root of the odds)
    x, y = best[use], label[use].astype(float)
    heavy = np.where(y == 1, np.sqrt(max((y == 0).sum(), 1) / max((y == 1).sum(), 1)), 1.0)
    mean, sd = x.mean(), x.std() + 1e-9
    design, beta = np.stack([(x - mean) / sd, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (heavy * (y - p)) - 0.05 * beta * [1, 0]
        beta += np.linalg.solve((design * (heavy * p * (1 - p) + 1e-9)[:, None]).T @ design + 0.05 * np.diag([1, 1e-6]), grad)
    scale = beta[0] / sd
    return ToxicityModel(
        (vectors @ (head[:, 1] - head[:, 0])).astype(np.float32), float(bias[1] - bias[0]), float(scale), float(beta[1] - scale * mean)
    )


def train_toxicity_model(
    docs: DataFrame, labels: DataFrame, held_out: int | None = 1, folds: int = 3, rows_per_label: int = 1500, chars_per_row: int = 20_000,
) -> ToxicityModel:
    """Fit on at most ``rows_per_label`` labelled documents of each label, by hash of doc_id.

    The sample takes documents of at most ``chars_per_row`` characters, and none
    whose crc32(doc_id) modulo ``folds`` is ``held_out``. Repeated label rows are
    used once. If one of the labels has no row, the model scores every text 0.
    """
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1))
    rows = docs.select("doc_id", "text").where((F.length("text") > 0) & (F.length("text") <= chars_per_row))
    if held_out is not None:
        known, rows = known.where(key % folds != held_out), rows.where(key % folds != held_out)
    # more ids than needed, as some documents are too long; these few (at most 4 * rows_per_label) go to the texts
    ids = bounded_sample(known.distinct(), "toxic", ["doc_id"], 2 * rows_per_label)
    got = rows.join(F.broadcast(ids.select("doc_id", "toxic")), "doc_id").select("doc_id", "toxic", "text").distinct()
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    sample = got.withColumn("place", place).where(F.col("place") <= rows_per_label).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    truth = np.array([r["toxic"] for r in sample], dtype=np.int64)
    if len(np.unique(truth)) < 2:
        return ToxicityModel(np.zeros(1 << BITS, dtype=np.float32), 0.0, 0.0, -30.0)
    return _fit([r["text"] for r in sample], truth)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``, 0 to 1. A null, empty or blank text is scored like a window of unknown words."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            scores = model.score([x if isinstance(x, str) else None for x in batch])
            release_memory()
            yield pd.Series(scores)

    return docs.withColumn("toxicity", scored(F.col(text)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity_model(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


QUERIES = {"op6_toxicity": op6_toxicity}
