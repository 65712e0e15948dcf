"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Trained on the driver with follow-the-regularised-leader (elastic net) on a
bounded sample of labelled rows, then calibrated by one temperature. Scoring
adds up per-word sums inside tasks: each distinct word of a batch is looked up
once, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.grams import hashed_grams, pieces, split_words, word_sums
from inkstone.llm.shared import bounded_sample, drop_kept, release_memory, table

LOW, HIGH, BITS = 1, 4, 18
SCALE = 50.0
LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    """Classes, table of idf * weight (class x bucket), bias and temperature."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        n, c = len(texts), len(self.langs)
        sums, grams = np.zeros((c, n)), np.zeros(n)
        for rows, parts in pieces(texts):
            owner, codes, distinct = split_words(parts)
            if len(codes):
                by_word, count = word_sums(distinct, LOW, HIGH, BITS, self.weights)
                row = np.asarray(rows)[owner]
                grams += np.bincount(row, weights=count[codes], minlength=n)
                for k in range(c):
                    sums[k] += np.bincount(row, weights=by_word[k][codes], minlength=n)
        logits = self.bias[:, None] + SCALE * sums / np.maximum(grams, 1)
        return _softmax(logits.T / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: Texts whose counts leave a task at once.
COUNTED_AT_ONCE = 20


def _gram_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    drop_kept()
    for frame in frames:
        for at in range(0, len(frame), COUNTED_AT_ONCE):
            some = frame.iloc[at : at + COUNTED_AT_ONCE]
            found = [_text_counts(text) for text in some["text"]]
            release_memory()
            yield pd.DataFrame(
                {"lang": some["lang"], "place": some["place"], "buckets": [b for b, _ in found], "counts": [n for _, n in found]}
            )


def _text_counts(text: str) -> tuple[bytes, bytes]:
    """Buckets of a text's n-grams and how often each occurs, packed in the order in which the model reads them."""
    total = np.zeros(1 << BITS)
    for _, parts in pieces([text]):
        _, codes, distinct = split_words(parts)
        if len(codes):
            bucket, owner = hashed_grams(distinct, LOW, HIGH, BITS)
            total += np.bincount(bucket, weights=np.bincount(codes, minlength=len(distinct))[owner], minlength=1 << BITS)
    used = np.flatnonzero(total)
    return used.astype("<i4").tobytes(), total[used].astype("<i4").tobytes()


def train_language_model(
    docs: DataFrame, held_out: int | None = 2, folds: int = 4, rows_per_language: int = 800,
    epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001,
) -> LanguageModel:
    """Fit on at most ``rows_per_language`` documents of each language (by hash of doc_id and text).

    Rows whose crc32(doc_id) modulo ``folds`` is ``held_out`` are never used
    (None: all rows may be), nor are rows without a language or a letter. Inverse
    document frequencies belong to the model and come from the same rows; a fifth
    of them is kept for the temperature. Without usable rows the model has no
    language.
    """
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if held_out is not None:
        rows = rows.where(fold(folds) != held_out)
    sample = bounded_sample(rows, "lang", ["doc_id", "text"], rows_per_language).select("lang", "text", "place")
    got = sample.mapInPandas(_gram_counts, "lang string, place int, buckets binary, counts binary").collect()
    got.sort(key=lambda r: (r["place"], r["lang"]))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return LanguageModel([], np.zeros((0, 1 << BITS), dtype=np.float32), np.zeros(0))
    number = {x: k for k, x in enumerate(langs)}
    data = [(number[r["lang"]], np.frombuffer(r["buckets"], dtype="<i4"), np.frombuffer(r["counts"], dtype="<i4")) for r in got]
    fit = [x for i, x in enumerate(data) if i % 5 != 4]
    seen = np.zeros(1 << BITS)
    for _, bucket, _ in fit:
        seen[bucket] += 1
    idf = np.log((1 + len(fit)) / (1 + seen)) + 1
    c = len(langs)
    z, n = np.zeros((1 << BITS, c)), np.zeros((1 << BITS, c))
    bz, bn = np.zeros(c), np.zeros(c)

    def solved(z_: np.ndarray, n_: np.ndarray, l1_: float) -> np.ndarray:
        return np.where(np.abs(z_) <= l1_, 0.0, -(z_ - np.sign(z_) * l1_) / ((beta + np.sqrt(n_)) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(fit)):
            y, bucket, count = fit[i]
            x = SCALE * idf[bucket] * count / count.sum()
            w, b = solved(z[bucket], n[bucket], l1), solved(bz, bn, 0.0)
            p = _softmax((x @ w + b)[None, :])[0]
            p[y] -= 1
            g = x[:, None] * p
            z[bucket] += g - (np.sqrt(n[bucket] + g * g) - np.sqrt(n[bucket])) / alpha * w
            n[bucket] += g * g
            bz += p - (np.sqrt(bn + p * p) - np.sqrt(bn)) / alpha * b
            bn += p * p
    w, bias = solved(z, n, l1), solved(bz, bn, 0.0)
    held = data[4::5] or data
    logits = np.stack([SCALE * (idf[b] * k / k.sum()) @ w[b] + bias for _, b, k in held])
    truth = np.array([y for y, _, _ in held])
    grid = np.geomspace(0.1, 10, 81)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    del got, data, fit, held, z, n
    release_memory()
    return LanguageModel(langs, (idf[:, None] * w).T.astype(np.float32), bias, float(grid[int(np.argmin(loss))]))


def fold(folds: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text", to: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the columns ``to``: the language and its probability, 0 to 1.

    A null text, one without a letter, and any text under a model without
    languages get ``und`` with score 0. Whole texts are read, in pieces.
    """

    @F.pandas_udf("lang_pred string, lang_score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        drop_kept()
        for batch in batches:
            texts = [x if isinstance(x, str) and model.langs and LETTER.search(x) else None for x in batch]
            if not model.langs:
                yield pd.DataFrame({"lang_pred": ["und"] * len(texts), "lang_score": [0.0] * len(texts)})
                continue
            p = model.probabilities(texts)
            best = p.argmax(axis=1)
            known = np.array([x is not None for x in texts], dtype=bool)
            batch = texts = None
            release_memory()
            yield pd.DataFrame(
                {
                    "lang_pred": np.where(known, np.asarray(model.langs, dtype=object)[best], "und"),
                    "lang_score": np.where(known, p[np.arange(len(best)), best], 0.0),
                }
            )

    both = docs.withColumn(to[0], predicted(F.col(text)))
    return both.withColumns({to[0]: F.col(to[0])["lang_pred"], to[1]: F.col(to[0])["lang_score"]})


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_language_model(docs, held_out=2, folds=4)
    return predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


QUERIES = {"op9_language_id": op9_language_id}
