"""Row-to-rows operators: units, sentences, passages, chunks, code blocks, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import quality as Q
from ..functions import text as T
from ..functions import values as V

UNIT_BREAK = r"\n\n|\f"


def units_from_text(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """One row per non-blank page; the 1-based index counts blank ones too."""
    parts = df.select(id_col, *keep, F.posexplode(F.split(text, UNIT_BREAK)).alias("pos", "unit_text"))
    return parts.filter(T.strip(F.col("unit_text")) != "").select(
        id_col, *keep, (F.col("pos") + 1).alias("unit_index"), F.col("unit_text").alias("text")
    )


def explode_sentences(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    return df.select(id_col, *keep, F.posexplode(T.sentences(F.col(text))).alias("sent_no", "sentence"))


def explode_passages(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple = (),
    window: int = L.WINDOW_WORDS, stride: int = L.QUERY_STRIDE,
) -> DataFrame:
    return df.select(
        id_col, *keep, F.posexplode(T.passages(F.col(text), window, stride)).alias("passage_no", "passage")
    )


def pack_row_units(units: Column, by_chars: bool) -> Column:
    """Chunks of the units held in one row.

    ``units`` is ``array<struct<unit_index,text>>`` in order; the result is
    ``array<struct<chunk_no,text,unit_indices>>``. No shuffle is needed.
    """
    limit = L.CODE_CHUNK_CHARS if by_chars else L.PROSE_CHUNK_WORDS

    def build(u: Column) -> Column:
        sizes = F.transform(u, lambda x: F.length(x["text"]) if by_chars else T.word_count(x["text"]))
        before = F.concat(
            F.array(F.lit(-1)), F.transform(F.slice(u, F.lit(1), F.size(u) - 1), lambda x: x["unit_index"])
        )
        gaps = F.zip_with(u, before, lambda x, p: x["unit_index"] != p + 1)

        def gather(v: Column) -> Column:
            ends = F.concat(F.slice(v["at"], F.lit(2), F.greatest(F.size(v["at"]) - 1, F.lit(0))), F.array(F.size(v["u"])))
            return F.transform(F.arrays_zip(v["at"].alias("s"), ends.alias("e")), lambda r, c: T.let(
                F.slice(v["u"], r["s"] + 1, r["e"] - r["s"]),
                lambda own: F.struct(
                    c.alias("chunk_no"), F.array_join(F.transform(own, lambda x: x["text"]), "\n\n").alias("text"),
                    F.transform(own, lambda x: x["unit_index"]).alias("unit_indices"),
                ),
            ))

        packed = T.let(F.struct(u.alias("u"), T.pack_starts(sizes, gaps, limit).alias("at")), gather)
        empty = F.array().cast("array<struct<chunk_no:int,text:string,unit_indices:array<int>>>")
        return F.when(F.size(u) == 0, empty).otherwise(packed)

    return T.let(units, build)


BLOCK = 4096


def pack_units(
    df: DataFrame, id_col: str = "doc_id", index: str = "unit_index", text: str = "text",
    by_chars: bool = False, limit: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """Next-fit chunks of a unit table, safe where one document holds most rows.

    Chunk boundaries depend on everything before them, yet only through the
    size of the open chunk. Each block of consecutive unit indices is summed
    up by how it maps that size at its start to the size at its end
    (``_block_map``); the few numbers per block are chained per document, and
    then all blocks are numbered in parallel. Only sizes go through those
    groups: text is joined back on (document, unit) and concatenated within
    chunks, which the limit bounds.
    """
    limit = limit or (L.CODE_CHUNK_CHARS if by_chars else L.PROSE_CHUNK_WORDS)
    size = F.length("text") if by_chars else T.word_count(F.col("text"))
    units = (
        df.select(F.col(id_col).alias("doc"), F.col(index).cast("long").alias("idx"), T.strip(F.col(text)).alias("text"))
        .filter(F.col("text") != "")
    )
    sizes = units.select("doc", "idx", size.cast("long").alias("n"), F.floor(F.col("idx") / block).alias("block"))
    doc_type = sizes.schema["doc"].dataType.simpleString()

    maps = sizes.groupBy("doc", "block").applyInPandas(
        _block_map(limit),
        f"doc {doc_type}, block long, first long, last long, heads array<long>, ends array<long>, opened array<long>",
    )
    entries = maps.groupBy("doc").applyInPandas(
        _chain(limit), f"doc {doc_type}, block long, carried long, chunk long"
    )
    numbered = (
        sizes.groupBy("doc", "block").cogroup(entries.groupBy("doc", "block"))
        .applyInPandas(_number(limit), f"doc {doc_type}, idx long, chunk long")
    )
    parts = units.join(numbered, ["doc", "idx"])
    return (
        parts.groupBy("doc", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("u"))
        .select(
            F.col("doc").alias(id_col), F.col("chunk").alias("chunk_no"),
            F.array_join(F.transform("u", lambda x: x["text"]), "\n\n").alias("text"),
            F.transform("u", lambda x: x["idx"]).alias("unit_indices"),
        )
    )


def _runs(idx, n, limit):
    """For sorted units: where a chunk opened at each unit ends, by prefix sums."""
    import numpy as np

    prefix = np.concatenate([[0], np.cumsum(n)])
    gap = np.flatnonzero(np.diff(idx) != 1) + 1
    stop = np.append(gap, len(n))
    next_gap = stop[np.searchsorted(stop, np.arange(len(n)), side="right")]
    fit = np.searchsorted(prefix, prefix[:-1] + limit, side="right") - 1
    nxt = np.minimum(np.maximum(fit, np.arange(len(n)) + 1), next_gap)
    return prefix, next_gap, nxt


def _block_map(limit: int):
    def run(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("idx")
        idx, n = pdf["idx"].to_numpy(), pdf["n"].to_numpy()
        prefix, next_gap, nxt = _runs(idx, n, limit)
        ends = np.zeros(len(n), dtype=np.int64)
        opened = np.zeros(len(n), dtype=np.int64)
        for i in range(len(n) - 1, -1, -1):
            j = nxt[i]
            if j >= len(n):
                ends[i], opened[i] = prefix[-1] - prefix[i], 1
            else:
                ends[i], opened[i] = ends[j], opened[j] + 1
        # Only as many leading units matter as an open chunk could still take in.
        most = int(min(np.searchsorted(prefix, limit, side="right") - 1, next_gap[0]))
        heads = prefix[: most + 1]
        return pd.DataFrame({
            "doc": [key[0]], "block": [key[1]], "first": [idx[0]], "last": [idx[-1]],
            "heads": [heads], "ends": [ends[: most + 1]], "opened": [opened[: most + 1]],
        })

    return run


def _taken(heads, carried: int, limit: int) -> int:
    """How many leading units still fit into a chunk already holding ``carried``."""
    import numpy as np

    return max(int(np.searchsorted(heads, limit - carried, side="right")) - 1, 0)


def _chain(limit: int):
    def run(key, pdf):
        import pandas as pd

        out, carried, chunk, last = [], 0, 0, None
        for r in pdf.sort_values("block").itertuples():
            held = carried if last is not None and r.first == last + 1 else 0
            out.append((key[0], r.block, held, chunk))
            taken = _taken(r.heads, held, limit) if held else 0
            if taken == len(r.ends):  # the open chunk takes in the whole block
                carried = held + int(r.heads[-1])
            else:
                carried, chunk = int(r.ends[taken]), chunk + int(r.opened[taken])
            last = r.last
        return pd.DataFrame(out, columns=["doc", "block", "carried", "chunk"])

    return run


def _number(limit: int):
    def run(key, pdf, entry):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("idx")
        idx, n = pdf["idx"].to_numpy(), pdf["n"].to_numpy()
        prefix, next_gap, nxt = _runs(idx, n, limit)
        carried, chunk = int(entry["carried"].iloc[0]), int(entry["chunk"].iloc[0])
        mark = np.zeros(len(n), dtype=np.int64)
        i = min(_taken(prefix, carried, limit), int(next_gap[0])) if carried else 0
        while i < len(n):
            mark[i] = 1
            i = nxt[i]
        return pd.DataFrame({"doc": pdf["doc"].to_numpy(), "idx": idx, "chunk": chunk - 1 + np.cumsum(mark)})

    return run


def extract_code_blocks(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_lines: int = 4) -> DataFrame:
    """Runs of code lines, blank lines allowed inside, with enough code in them.

    Runs are cut within the row: every line that is neither code nor blank
    becomes a separator, so no window over a document is needed.
    """
    marked = F.transform(
        T.lines(F.col(text)), lambda s: F.when(Q.is_code_line(s) | (T.strip(s) == ""), s).otherwise("\x01")
    )
    runs = F.split(F.array_join(marked, "\n"), "\x01")
    dense = F.filter(runs, lambda b: F.size(T.nonblank(F.split(b, "\n"))) >= min_lines)
    return df.select(id_col, F.posexplode(F.transform(dense, T.strip)).alias("block_no", "code"))


def probe_sentences(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = L.PROBES) -> DataFrame:
    """The longest long sentence of each of ``n`` equal slices, first words only."""

    def pick(s: Column) -> Column:
        k = F.least(F.lit(n), F.size(s))
        per = F.size(s) / F.nullif(k, F.lit(0))

        def longest(i: Column) -> Column:
            lo, hi = F.floor(i * per).cast("int"), F.floor((i + 1) * per).cast("int")
            part = F.slice(s, lo + 1, F.greatest(hi - lo, F.lit(1)))
            ranked = F.array_sort(F.transform(
                part, lambda x, j: F.struct((-T.word_count(x)).alias("k"), j.alias("j"), x.alias("x"))
            ))
            return F.array_join(F.slice(T.words(ranked[0]["x"]), F.lit(1), F.lit(L.PROBE_WORDS)), " ")

        empty = F.array().cast("array<string>")
        return F.when(F.size(s) == 0, empty).otherwise(F.transform(F.sequence(F.lit(0), k - 1), longest))

    long_ones = F.filter(T.sentences(F.col(text)), lambda s: T.word_count(s) >= L.PROBE_MIN_WORDS)
    return df.select(id_col, F.posexplode(T.let(long_ones, pick)).alias("probe_no", "probe"))


def _first_by_label(pairs: DataFrame, id_col: str) -> DataFrame:
    """First pair per case-folded label; the first thirty of a document stay."""
    firsts = pairs.groupBy(id_col, F.lower("label").alias("k")).agg(
        F.min_by(F.struct("line_no", "label", "value", "unit", "scale_word"), "line_no").alias("p")
    ).select(id_col, "p.*")
    w = Window.partitionBy(id_col).orderBy("line_no")
    return firsts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= L.MAX_PAIRS).drop("rn")


def kv_pairs_same_line(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``Label: value`` lines as (label, value, unit, scale_word)."""
    stripped = F.transform(T.lines(F.col(text)), T.strip)
    rows = df.select(id_col, F.posexplode(stripped).alias("line_no", "line"))
    # Every pair has a digit and a delimiter: a cheap test before the pattern.
    rows = rows.filter(F.col("line").rlike("[0-9]") & F.col("line").rlike("[:=–—\t]"))
    hits = rows.withColumn("g", V.matched_groups(F.col("line"), L.PAIR_LINE_PATTERN, 5)).filter("g IS NOT NULL")
    pairs = hits.select(
        id_col, "line_no", T.strip(F.element_at("g", 1)).alias("label"), V.scaled_value(F.col("g"), 1).alias("v")
    ).filter(F.col("v").isNotNull() & (F.col("label") != ""))
    return _first_by_label(pairs.select(id_col, "line_no", "label", "v.*"), id_col)


def kv_pairs_adjacent_line(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A label line directly above a value line (blank lines between are skipped)."""

    def couple(a: Column) -> Column:
        m = F.greatest(F.size(a) - 1, F.lit(0))
        return F.zip_with(
            F.slice(a, F.lit(1), m), F.slice(a, F.lit(2), m),
            lambda x, y: F.struct(x.alias("above"), y.alias("below")),
        )

    stripped = F.filter(F.transform(T.lines(F.col(text)), T.strip), lambda s: s != "")
    rows = df.select(id_col, F.posexplode(T.let(stripped, couple)).alias("line_no", "p"))
    rows = rows.filter(F.col("p.below").rlike("[0-9]"))
    hits = rows.select(
        id_col, "line_no", V.matched_groups(F.col("p.above"), L.LABEL_LINE_PATTERN, 1)[0].alias("label"),
        V.matched_groups(F.col("p.below"), L.VALUE_LINE_PATTERN, 4).alias("g"),
    ).filter("label IS NOT NULL AND g IS NOT NULL")
    pairs = hits.select(
        id_col, "line_no", T.strip(F.col("label")).alias("label"), V.scaled_value(F.col("g"), 0).alias("v")
    ).filter(F.col("v").isNotNull() & (F.col("label") != ""))
    return _first_by_label(pairs.select(id_col, "line_no", "label", "v.*"), id_col)


def quantitative_pairs(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Same-line pairs; adjacent-line ones join in only where fewer than two exist."""
    same = kv_pairs_same_line(df, id_col, text).withColumn("src", F.lit(0))
    enough = same.groupBy(id_col).agg(F.count("*").alias("n")).filter(F.col("n") >= L.MIN_CHART_ITEMS)
    known = same.select(id_col, F.lower("label").alias("k"))
    beside = kv_pairs_adjacent_line(df, id_col, text).withColumn("k", F.lower("label"))
    extra = beside.join(enough.select(id_col), id_col, "left_anti").join(known, [id_col, "k"], "left_anti")
    return same.unionByName(extra.drop("k").withColumn("src", F.lit(1)))


def largest_unit_bucket(pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Keep the pairs of a document's most common unit, at least two of them."""
    counts = pairs.groupBy(id_col, "unit").agg(
        F.count("*").alias("n"), F.min(F.struct("src", "line_no")).alias("first")
    )
    best = counts.groupBy(id_col).agg(
        F.min_by(F.struct("unit", "n"), F.struct((-F.col("n")).alias("k"), "first")).alias("b")
    )
    keep = best.filter(F.col("b.n") >= L.MIN_CHART_ITEMS).select(id_col, F.col("b.unit").alias("unit"))
    return pairs.join(keep, [id_col, "unit"])
