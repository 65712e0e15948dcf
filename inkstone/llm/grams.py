"""Hashed character n-grams of many words at once (numpy), for the text classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

PIECE_CHARS = 400_000


def pieces(texts: Sequence[str | None], overlap: int = 0, limit: int = PIECE_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and strings that together cover all texts, about ``limit`` characters at a time.

    A longer text comes in several strings cut at blanks, each beginning up to
    ``overlap`` characters before the last one's end, so memory stays bounded
    and no text is cut short.
    """
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        at, n = 0, len(text)
        while at < n:
            end = n
            if n - at > limit:
                end = text.rfind(" ", at + limit // 2, at + limit) + 1 or at + limit
            rows.append(i)
            parts.append(text[max(0, at - overlap) : end] if at else text[:end])
            held += end - at
            at = end
            if held >= limit:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


def split_words(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of all strings: the string's number and the code of each word, and the distinct words."""
    lists = [p.lower().split() for p in parts]
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for x in lists for w in x]
    codes, distinct = pd.factorize(flat)
    return np.repeat(np.arange(len(lists)), sizes), codes, distinct


def hashed_grams(words: Sequence[str], low: int, high: int, bits: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every n-gram (low <= n <= high) of the words between < and >, grouped by word.

    ``whole`` adds one bucket for each whole word.
    """
    if not len(words):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    marked = "".join([f"<{w}>" for w in words])
    chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
    prime, buckets, owners = np.uint64(0x9E3779B97F4A7C15), [], []
    shift = np.uint64(64 - bits)
    h = np.full(len(chars), 0xCBF29CE484222325, dtype=np.uint64)
    for n in range(1, high + 1):
        h = h[: len(chars) - n + 1]
        h = (h ^ chars[n - 1 :]) * prime
        h ^= h >> np.uint64(31)
        if n >= low:
            here = np.flatnonzero(left[: len(h)] >= n)
            buckets.append(((h[here] * prime) >> shift).astype(np.int64))
            owners.append(word[here])
    if whole:
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mixed = (chars + np.uint64(0x1F)) * prime
        mixed ^= mixed >> np.uint64(29)
        order = np.arange(len(chars)) - np.repeat(starts, sizes)
        mixed = mixed * (prime + np.uint64(2) * order.astype(np.uint64))
        total = np.add.reduceat(mixed, starts)
        buckets.append((((total ^ (total >> np.uint64(32))) * prime) >> shift).astype(np.int64))
        owners.append(np.arange(len(words)))
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


def word_sums(words: Sequence[str], low: int, high: int, bits: int, tables: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each word the sums of its grams' entries in each row of ``tables``, and its number of grams."""
    bucket, owner = hashed_grams(words, low, high, bits, whole)
    sums = np.stack([np.bincount(owner, weights=t[bucket], minlength=len(words)) for t in tables])
    return sums, np.bincount(owner, minlength=len(words)).astype(np.float64)
