"""Splitting text: words, sentences, lines, tokens, n-grams and passage windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

BLANKS = " \t\n\x0b\f\r"
SENTENCE_BREAK = r"(?<=[.!?])\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Inside a lambda Catalyst cannot share a sub-expression, so an array that
    is captured by one is bound to a lambda variable first.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    t = strip(c)
    return F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def lines(c: Column) -> Column:
    """Lines without the empty one that a final line break would leave."""
    t = F.regexp_replace(c, r"\r\n?", "\n")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(t, r"\n\z", ""), "\n")
    )


def nonblank(arr: Column) -> Column:
    return F.filter(arr, lambda s: strip(s) != "")


def sentences(c: Column) -> Column:
    parts = F.split(strip(c), SENTENCE_BREAK)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences_strict(c: Column) -> Column:
    """Only breaks before an ASCII capital count; very short or long pieces go."""
    flat = strip(F.regexp_replace(c, r"\s+", " "))
    parts = F.transform(F.split(flat, r"(?<=[.!?])\s+(?=[A-Z])"), strip)
    return F.filter(parts, lambda s: (F.length(s) > 20) & (F.length(s) < 600))


def pseudo_lines(c: Column) -> Column:
    """Real lines where line breaks are dense enough, otherwise sentences."""
    breaks = F.regexp_count(c, F.lit("\n"))
    dense = breaks >= F.greatest(F.lit(1), F.floor(F.length(c) / 200))
    return F.when(dense, lines(c)).otherwise(F.split(c, SENTENCE_BREAK))


def tokens_lexical(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9']+"), F.lit(0))


def tokens_model(c: Column) -> Column:
    """Tokens of the n-gram model: letters of any script, digits, apostrophes."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))


def tokens_content(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"\b[a-zA-Z]{3,}\b"), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda w: ~w.isin(*dict.fromkeys(L.STOPWORDS)))


def ngrams(tokens: Column, n: int = L.NGRAM_N) -> Column:
    """Distinct n-grams, joined by one space; none where there are fewer tokens."""

    def shifted(t: Column) -> Column:
        m = F.size(t) - (n - 1)
        joined = F.transform(
            F.arrays_zip(*[F.slice(t, F.lit(i + 1), m).alias(f"g{i}") for i in range(n)]),
            lambda z: F.concat_ws(" ", *[z[f"g{i}"] for i in range(n)]),
        )
        return F.when(F.size(t) >= n, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))

    return let(tokens, shifted)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(inter / union)


def containment(query: Column, source: Column) -> Column:
    """Share of the query's distinct n-grams that the source has too."""
    inter = F.size(F.array_intersect(query, source))
    return F.when((F.size(query) == 0) | (F.size(source) == 0), 0.0).otherwise(inter / F.size(query))


def marked_places(items: Column, opening: Column, step: Callable[[Column, Column], tuple[Column, Column]], block: int = 256) -> Column:
    """Places (from 0) that a fold over an array marks: ``step`` gives the next state and whether to mark.

    Marks are gathered per block of the array, so that the cost of an item is the same
    in a short array and in a very long one.
    """

    def inner(start: Column, part: Column, first: Column) -> Column:
        def put(acc: Column, x: Column) -> Column:
            state, mark = step(acc["state"], x)
            found = F.when(mark, F.array_append(acc["found"], acc["at"])).otherwise(acc["found"])
            return F.struct(state.alias("state"), (acc["at"] + 1).alias("at"), found.alias("found"))

        none = F.array().cast("array<int>")
        return F.aggregate(part, F.struct(start.alias("state"), first.alias("at"), none.alias("found")), put)

    def outer(acc: Column, part: Column) -> Column:
        return let(inner(acc["state"], part, acc["at"]), lambda r: F.struct(
            r["state"].alias("state"), r["at"].alias("at"), F.array_append(acc["found"], r["found"]).alias("found")
        ))

    def over(a: Column) -> Column:
        last = F.floor((F.size(a) - 1) / F.lit(block)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(a, i * block + 1, F.lit(block)))
        none = F.array().cast("array<array<int>>")
        found = F.aggregate(parts, F.struct(opening.alias("state"), F.lit(0).alias("at"), none.alias("found")), outer)["found"]
        return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(F.flatten(found))

    return let(items, over)


def window_bounds(lengths: Column, window: int, stride: int) -> Column:
    """``array<struct<s,e>>``: sentence ranges [s, e) of the passage windows.

    A start is where a running word count, reset at every start, reaches the
    stride. Since a sentence has at least one word, a window closes within
    ``window`` sentences, so each end only looks at a slice of that size.
    """

    def advance(run: Column, n: Column) -> tuple[Column, Column]:
        full = run + n >= stride
        return F.when(full, 0).otherwise(run + n), full

    def ranges(lens: Column) -> Column:
        n = F.size(lens)
        after = F.transform(marked_places(lens, F.lit(0), advance), lambda i: i + 1)
        starts = F.filter(F.concat(F.array(F.lit(0)), after), lambda s: s < n)

        def close(s: Column) -> Column:
            fold = F.aggregate(
                F.slice(lens, s + 1, F.lit(window)),
                F.struct(F.lit(0).alias("total"), F.lit(0).alias("used")),
                lambda a, k: F.when(
                    a["total"] < window,
                    F.struct((a["total"] + k).alias("total"), (a["used"] + 1).alias("used")),
                ).otherwise(a),
            )
            return F.struct(s.alias("s"), (s + fold["used"]).alias("e"))

        def trim_tail(w: Column) -> Column:
            before = F.concat(F.array(F.lit(-1)), F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x: x["e"]))
            paired = F.zip_with(w, before, lambda x, p: F.struct(x["s"].alias("s"), x["e"].alias("e"), p.alias("p")))
            kept = F.filter(paired, lambda x: x["p"] < n)
            return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

        empty = F.array().cast("array<struct<s:int,e:int>>")
        return F.when(n == 0, empty).otherwise(let(F.transform(starts, close), trim_tail))

    return let(lengths, ranges)


def passages(c: Column, window: int = L.WINDOW_WORDS, stride: int = L.QUERY_STRIDE) -> Column:
    """Sentence-aligned passages of at least ``window`` words; repeats dropped."""

    def cut(sents: Column) -> Column:
        bounds = window_bounds(F.transform(sents, word_count), window, stride)
        return F.array_distinct(
            F.transform(bounds, lambda b: F.array_join(F.slice(sents, b["s"] + 1, b["e"] - b["s"]), " "))
        )

    return let(sentences(c), cut)


def pack_starts(sizes: Column, breaks: Column, limit: int) -> Column:
    """The first unit of every chunk: next-fit up to ``limit``.

    ``breaks`` marks the units that must open a chunk (a gap before them).
    """

    def put(held: Column, x: Column) -> tuple[Column, Column]:
        new = (held < 0) | x["b"] | ((held > 0) & (held + x["n"] > limit))
        return F.when(new, x["n"]).otherwise(held + x["n"]), new

    pairs = F.zip_with(sizes, breaks, lambda n, b: F.struct(n.alias("n"), b.alias("b")))
    return marked_places(pairs, F.lit(-1), put)


def content_tag(c: Column) -> Column:
    """First 12 hex digits of the SHA-256 of the trimmed text."""
    return F.substring(F.sha2(strip(c), 256), 1, 12)
