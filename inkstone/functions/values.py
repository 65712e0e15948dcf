"""Numbers in text, labels, chart choice, replies and grounding checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .scores import clamp, verdict_band
from .text import let, strip


def parse_number(c: Column) -> Column:
    """Number after removing thousands commas, dollar and percent signs; else null."""
    bare = strip(F.translate(strip(c), ",$%", ""))
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def matched_groups(line: Column, pattern: str, n: int) -> Column:
    """The groups of a whole-line pattern as an array; null where it fails.

    One replacement run gives all groups at once, instead of one match each.
    """
    marked = F.regexp_replace(line, pattern, "\x01" + "\x01".join(f"${i}" for i in range(1, n + 1)))
    return let(F.split(marked, "\x01"), lambda g: F.when(F.size(g) == n + 1, F.slice(g, F.lit(2), F.lit(n))))


def scaled_value(groups: Column, shift: int) -> Column:
    """``struct<value, unit, scale_word>`` from matched groups, null if no number.

    ``shift`` is the number of groups before the currency group.
    """

    def group(i: int) -> Column:
        return F.element_at(groups, shift + i)

    number = F.translate(group(2), ",", "").try_cast("double")
    scale = F.lower(group(3))
    factor = F.lit(1.0)
    for word, mult in L.SCALES.items():
        factor = F.when(scale == word, mult).otherwise(factor)
    pct = group(4) == "%"
    scaled = (group(1) != "") | (scale != "")
    out = F.struct(
        F.when(pct | ~scaled, number).otherwise(number * factor).alias("value"),
        F.when(pct, "%").when(scaled, "scaled").otherwise("plain").alias("unit"),
        F.when(~pct & (scale != ""), scale).alias("scale_word"),
    )
    return F.when(groups.isNotNull() & number.isNotNull(), out)


def is_time_label(c: Column) -> Column:
    t = F.lower(strip(c))
    return t.isin(*L.MONTHS) | t.rlike(L.TIME_LABEL_PATTERN)


def choose_chart(items: Column) -> Column:
    """Chart type for ``array<struct<label,value,unit>>``; null where none fits."""
    n = F.size(items)
    pct = F.forall(items, lambda x: x["unit"] == "%")
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + x["value"])
    return (
        F.when(n < L.MIN_CHART_ITEMS, F.lit(None).cast("string"))
        .when(F.forall(items, lambda x: is_time_label(x["label"])), "line")
        .when(pct & (n <= L.PIE_MAX_ITEMS) & total.between(*L.PIE_SUM), "pie")
        .when(n < L.MIN_BAR_ITEMS, F.lit(None).cast("string"))
        .when(n > L.MAX_BAR_ITEMS, "hbar")
        .otherwise("bar")
    )


def chart_points(items: Column, kind: Column) -> Column:
    """``array<struct<name,value>>`` in the order and rounding of the chart type."""
    ranked = F.transform(
        F.array_sort(F.transform(
            items, lambda x, i: F.struct((-x["value"]).alias("k"), i.alias("i"), x["label"].alias("name"), x["value"].alias("value"))
        )),
        lambda x: F.struct(x["name"].alias("name"), F.round(x["value"], 2).alias("value")),
    )
    plain = F.transform(items, lambda x: F.struct(x["label"].alias("name"), F.round(x["value"], 2).alias("value")))
    tenths = F.transform(items, lambda x: F.struct(x["label"].alias("name"), F.round(x["value"], 1).alias("value")))
    return (
        F.when(kind == "line", plain).when(kind == "pie", tenths)
        .when(kind == "hbar", F.slice(ranked, F.lit(1), F.lit(L.MAX_HBAR_ITEMS)))
        .when(kind == "bar", ranked)
    )


def doc_type(c: Column) -> Column:
    """Type with most of its keywords contained, at least two; first listed wins."""
    # the lower-cased text is bound: as a shared column it would be made again for each keyword
    hits = let(F.lower(c), lambda low: F.array(*[
        sum((low.contains(k).cast("int") for k in kws), F.lit(0)) for kws in L.DOC_TYPE_KEYWORDS.values()
    ]))
    names = F.array(*[F.lit(n) for n in L.DOC_TYPE_KEYWORDS])
    return let(
        hits,
        lambda h: F.when(F.array_max(h) >= 2, F.element_at(names, F.array_position(h, F.array_max(h)).cast("int")))
        .otherwise("general"),
    )


def focus_words(kind: Column) -> Column:
    case = None
    for name, kws in L.FOCUS_KEYWORDS.items():
        arr = F.array(*[F.lit(k) for k in kws])
        case = F.when(kind == name, arr) if case is None else case.when(kind == name, arr)
    return case.otherwise(F.array().cast("array<string>"))


def mid_phrase(c: Column) -> Column:
    """Words 3 to 12 where there are at least twelve, quotes removed."""
    from .text import words

    return let(
        words(F.translate(c, '"\\', "  ")),
        lambda w: F.array_join(F.when(F.size(w) >= 12, F.slice(w, F.lit(3), F.lit(10))).otherwise(w), " "),
    )


def strip_fences(c: Column) -> Column:
    t = strip(c)
    bare = F.regexp_replace(F.regexp_replace(t, r"\A```[a-zA-Z]*\n?", ""), r"\n?```\z", "")
    return strip(F.when(t.startswith("```"), bare).otherwise(t))


def candidate_reason(original: Column, candidate: Column) -> Column:
    """Why a rewrite cannot be used; empty where it can."""
    clean = strip_fences(candidate)
    meta = F.lit(False)
    for p in L.META_PREFIXES:
        meta = meta | F.lower(clean).startswith(p)
    ratio = F.length(clean) / F.greatest(F.length(original), F.lit(1))
    return (
        F.when(F.coalesce(strip(candidate), F.lit("")) == "", "empty response")
        .when(clean == "", "empty after stripping code fences")
        .when(meta, "contains meta-commentary rather than just the rewrite")
        .when(~ratio.between(*L.LENGTH_RATIO), "length ratio outside safe bounds (likely truncated or padded)")
        .otherwise("")
    )


def fold_spaces(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", " "))


def quote_grounded(text: Column, quote: Column) -> Column:
    q = strip(fold_spaces(quote))
    return (q != "") & fold_spaces(text).contains(q)


def quotes_grounded(text: Column, quotes: Column) -> Column:
    """``array<boolean>``: which of many quotes are in a text, which is folded once for all of them."""

    def found(folded: Column) -> Column:
        return F.transform(quotes, lambda x: let(strip(fold_spaces(x)), lambda q: (q != "") & folded.contains(q)))

    return let(fold_spaces(text), found)


def numbers_grounded(value: Column, context: Column) -> Column:
    flat = F.lower(F.regexp_replace(context, r"[,\s]", ""))
    digits = F.regexp_extract_all(value, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return let(
        F.struct(digits.alias("d"), flat.alias("c")),
        lambda v: (F.size(v["d"]) > 0) & F.forall(v["d"], lambda d: v["c"].contains(d)),
    )


REPLY_SCHEMA = "ai_probability string, confidence string, explanation string"


def parse_reply(c: Column) -> Column:
    """Reply JSON as a struct: fences removed, else the outermost braces."""
    t = strip(c)
    bare = F.when(
        t.startswith("```"), F.regexp_replace(t, r"\A```(?:json)?\s*|\s*```\z", "")
    ).otherwise(t)
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)

    def read(s: Column) -> Column:
        valid = F.get_json_object(s, "$").isNotNull() & strip(s).startswith("{")
        return F.when(valid, F.from_json(s, REPLY_SCHEMA))

    return F.coalesce(read(bare), read(braces))


def normalise_reply(reply: Column) -> Column:
    """``struct<ai_probability, verdict, confidence, explanation, error>``."""
    raw = reply["ai_probability"]
    number = raw.try_cast("double")
    is_float = raw.rlike(r"[.eE]")
    score = clamp(F.when(is_float & number.between(0.0, 1.0), number * 100.0).otherwise(number), 0.0, 100.0)
    conf = F.lower(F.coalesce(reply["confidence"], F.lit("medium")))
    error = (
        F.when(reply.isNull() | raw.isNull(), "the provider did not return a usable score.")
        .when(number.isNull(), "the returned score was not numeric.")
    )
    return let(
        F.struct(score.alias("s"), error.alias("e")),
        lambda v: F.struct(
            F.when(v["e"].isNull(), F.round(v["s"], 1)).alias("ai_probability"),
            F.when(v["e"].isNull(), verdict_band(v["s"])).otherwise("unavailable").alias("verdict"),
            F.when(conf.isin("low", "medium", "high"), conf).otherwise("medium").alias("confidence"),
            F.substring(F.coalesce(reply["explanation"], F.lit("")), 1, 600).alias("explanation"),
            v["e"].alias("error"),
        ),
    )


def relative_time(ts: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    return (
        F.when(ts.isNull(), "—").when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .when(s < 604800, F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ts, "MMM d, yyyy"))
    )


def parse_time(c: Column) -> Column:
    """Timestamp of an ISO text (date, or date and time with T or a blank, fraction, Z or offset; without one: UTC); null if it is none."""
    text = F.btrim(c)
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?([Zz]|[+-]\d{2}:?\d{2})?)?$")
    # a colon in the offset, and UTC where none is named
    offset = F.regexp_replace(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"[zZ]$", "+00:00")
    named = F.when(offset.rlike(r"[T ].*[+-]\d{2}:\d{2}$"), offset).when(F.length(offset) == 10, F.concat(offset, F.lit(" 00:00:00+00:00"))).otherwise(F.concat(offset, F.lit("+00:00")))
    return F.when(iso, F.try_to_timestamp(F.regexp_replace(named, "T", " ")))
