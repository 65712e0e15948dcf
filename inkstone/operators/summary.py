"""Term frequencies and extractive sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import values as V

#: Documents scored at once.
ROWS_AT_ONCE = 200


def term_frequency(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term, n, norm): counts over the document's largest count.

    Both steps reduce on (document, term) before the shuffle; the maximum is a
    second aggregate joined back, not a window over all terms of a document.
    """
    counts = (
        df.select(id_col, F.explode(T.tokens_content(F.col(text))).alias("term"))
        .groupBy(id_col, "term").agg(F.count("*").alias("n"))
    )
    peak = counts.groupBy(id_col).agg(F.max("n").alias("peak"))
    return counts.join(peak, id_col).select(id_col, "term", "n", (F.col("n") / F.col("peak")).alias("norm"))


def sentence_scores(df: DataFrame, id_col: str = "doc_id", text: str = "text", kind=None) -> DataFrame:
    """(id, pos, sentence, score) for sentences that have content words.

    score = (mean term frequency + place bonus + focus share) * length factor. A row is
    one document and is scored where it is read: its words are counted in the row.
    """
    what = kind if kind is not None else V.doc_type(F.col(text))
    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    cut = df.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(
        id_col, hashes(T.tokens_content(F.col(text))).alias("words"), T.sentences_strict(F.col(text)).alias("s"), T.let(what, lambda kind: hashes(V.focus_words(kind))).alias("focus")
    )
    parts = cut.select(id_col, "words", "focus", "s", F.transform("s", lambda x: hashes(T.tokens_content(x))).alias("w"))
    rows = parts.select(id_col, "words", "focus", "s", F.flatten("w").alias("w"), F.transform("w", F.size).alias("k"))
    schema = Y.StructType([df.schema[id_col], *Y._parse_datatype_string("pos int, sentence string, score double").fields])
    return rows.mapInArrow(_score_rows, schema)


def _score_rows(batches):  # noqa: ANN001, ANN202
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield _scored(batch.slice(at, ROWS_AT_ONCE))


def _scored(rows):  # noqa: ANN001, ANN202
    """The scored sentences of some documents: id, words, focus, s, w (words of all sentences) and k (how many in each)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def flat(name):  # noqa: ANN001, ANN202
        column = rows.column(name)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return pc.list_flatten(column), sizes, np.repeat(np.arange(len(sizes)), sizes)

    (words, _, word_row), (focus, _, focus_row), (w, _, w_row) = flat("words"), flat("focus"), flat("w")
    sentences, totals, s_row = flat("s")
    k = flat("k")[0].to_numpy(zero_copy_only=False).astype(np.int64)
    values = [x.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for x in (words, focus, w)]
    codes = np.unique(np.concatenate(values), return_inverse=True)[1]
    n_codes = int(codes.max(initial=0)) + 1
    own, told, met = (r * n_codes + c for r, c in zip((word_row, focus_row, w_row), np.split(codes, np.cumsum([len(x) for x in values])[:-1]), strict=True))
    terms, n = np.unique(own, return_counts=True)
    peak = np.zeros(rows.num_rows, np.int64)
    np.maximum.at(peak, terms // n_codes, n)
    norm = n / peak[terms // n_codes]
    at = np.minimum(np.searchsorted(terms, met), max(len(terms) - 1, 0))
    found = terms[at] == met if len(terms) else np.zeros(len(met), bool)
    sent = np.repeat(np.arange(len(k)), k)
    add = lambda where, v=None: np.bincount(sent[where], v, minlength=len(k))
    n_found, in_focus = add(found), add(np.isin(met, told))
    keep = np.flatnonzero(n_found)
    tf = add(found, norm[at[found]])[keep] / n_found[keep]
    pos = np.arange(len(k)) - (np.cumsum(totals) - totals)[s_row]
    ratio = (pos / np.maximum(totals[s_row] - 1, 1))[keep]
    bonus = np.where((ratio <= 0.20) | (ratio >= 0.85), 0.2, 0.0)
    score = (tf + bonus + 0.15 * in_focus[keep] / k[keep]) * np.minimum(k[keep] / 10.0, 1.0)
    take = lambda column, i: column.take(pa.array(i, pa.int64()))
    out = [take(rows.column(0), s_row[keep]), pa.array(pos[keep], pa.int32()), take(sentences, keep), pa.array(score)]
    return pa.RecordBatch.from_arrays(out, names=[rows.schema.names[0], "pos", "sentence", "score"])


def extractive_summary(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = L.SUMMARY_POINTS, kind=None
) -> DataFrame:
    """The ``n`` best sentences per document, numbered in document order."""
    best = Window.partitionBy(id_col).orderBy(F.desc(F.round("score", 9)), "pos")
    top = sentence_scores(df, id_col, text, kind).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    return top.withColumn("point_no", F.row_number().over(Window.partitionBy(id_col).orderBy("pos")))
