"""Documents to authorship-likelihood scores, prose and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codestyle as C
from ..functions import lexicon as L
from ..functions import quality as Q
from ..functions import scores as B
from ..functions import text as T
from ..operators import lm as M
from ..operators import scoring as R
from ..operators import segment as G
from ..session import materialize


def classified_units(c: Column) -> Column:
    """``array<struct<unit_index,text,kind,weight>>`` of a text's non-blank pages."""
    pages = F.transform(
        F.split(c, G.UNIT_BREAK), lambda t, i: F.struct((i + 1).alias("unit_index"), T.strip(t).alias("text"))
    )
    pages = F.filter(pages, lambda u: u["text"] != "")
    return F.transform(
        pages,
        lambda u: T.let(
            Q.classify_block(u["text"]),
            lambda k: F.struct(
                u["unit_index"].alias("unit_index"), u["text"].alias("text"), k.alias("kind"),
                Q.block_weight(u["text"], k).alias("weight"),
            ),
        ),
    )


def chunk_documents(docs: DataFrame, kind: str, keep: tuple = ()) -> DataFrame:
    """(doc_id, chunk_no, text, unit_indices) of the prose or code pages. Mixed
    pages belong to both. Everything happens within the row."""
    units = docs.select("doc_id", *keep, classified_units(F.col("text")).alias("u"))
    part = F.filter("u", lambda x: x["kind"].isin(kind, "mixed"))
    packed = G.pack_row_units(
        F.transform(part, lambda x: F.struct(x["unit_index"].alias("unit_index"), x["text"].alias("text"))),
        by_chars=kind == "code",
    )
    return units.select("doc_id", *keep, F.explode(packed).alias("c")).select("doc_id", *keep, "c.*")


def chunk_measures(docs: DataFrame, lm: M.NgramModel, fold: Column, markers: list[str] | None = None) -> DataFrame:
    """Per prose chunk: gate, words, perplexity, burstiness, marker and uniformity."""
    chunks = chunk_documents(docs.withColumn("fold", fold), "prose", ("fold",))
    text = F.col("text")
    facts = chunks.select(
        "doc_id", "chunk_no", Q.quality_gate(text).alias("q"),
        B.marker_density(text, markers).alias("marker_signal"), B.sentence_uniformity(text).alias("uniformity_signal"),
    ).select("doc_id", "chunk_no", "q.status", F.col("q.word_count").alias("words"), "marker_signal", "uniformity_signal")
    keys = ["doc_id", "chunk_no"]
    surprise = M.sentence_surprise(chunks, keys, lm, fold=F.col("fold"))
    per_sentence = F.when(
        (F.col("n_words") >= 3) & (F.col("inner_n") > 0), F.round(F.exp(F.col("inner_nll") / F.col("inner_n")), 2)
    )
    measured = surprise.groupBy(*keys).agg(
        F.exp(F.sum("nll") / F.sum("n")).alias("perplexity"), F.collect_list(per_sentence).alias("p")
    ).select(*keys, "perplexity", mad(F.col("p")).alias("burstiness"))
    return facts.join(measured, keys, "left")


def mad(values: Column) -> Column:
    """Exact median absolute deviation of one chunk's sentence values."""

    def median(a: Column) -> Column:
        n = F.size(a)
        return (F.element_at(a, F.floor((n - 1) / 2).cast("int") + 1) + F.element_at(a, F.floor(n / 2).cast("int") + 1)) / 2

    def spread(a: Column) -> Column:
        return T.let(median(a), lambda m: median_of(F.transform(a, lambda x: F.abs(x - m))))

    def median_of(a: Column) -> Column:
        return T.let(F.array_sort(a), median)

    return T.let(F.array_sort(values), lambda a: F.when(F.size(a) >= 2, spread(a)))


def score_chunks(measures: DataFrame, bands: dict | None = None) -> DataFrame:
    """Signals and score per chunk. ``bands`` gives (low, high) for perplexity and
    burstiness, as numbers or columns; the fixed ones belong to another model."""
    b = {"perplexity": L.PERPLEXITY_BAND, "burstiness": L.BURSTINESS_BAND, **(bands or {})}
    ps = B.ai_signal(F.col("perplexity"), *b["perplexity"])
    bs = B.ai_signal(F.col("burstiness"), *b["burstiness"])
    return measures.select(
        "*", ps.alias("perplexity_signal"), bs.alias("burstiness_signal")
    ).withColumn(
        "score",
        B.ai_likelihood(F.col("perplexity_signal"), F.col("burstiness_signal"), F.col("marker_signal"), F.col("uniformity_signal")),
    )


def score_documents(
    docs: DataFrame, lm: M.NgramModel | None = None, markers: list[str] | None = None,
    bands: dict | str | None = "calibrated",
) -> DataFrame:
    """One score per document.

    Without a model, one is counted on the documents themselves in two folds,
    and each document is scored by the fold it is not in. "calibrated" takes
    the 10th and 90th percentile of the scored chunks as bands.
    """
    fold = F.pmod(F.col("doc_id"), F.lit(2)).cast("int")
    if lm is None:
        lm = M.ngram_lm_fit(docs, fold=1 - fold)
    else:
        fold = F.lit(0)
    measures = materialize(chunk_measures(docs, lm, fold, markers), "chunk-measures")
    if bands == "calibrated":
        ok = measures.filter(F.col("status") == "ok")
        bands = {}
        for c in ("perplexity", "burstiness"):
            # two numbers: as subqueries, each use of a band would be planned and run again
            band = M.calibrate_band(ok, c).first()
            bands[c] = tuple(F.lit(band[x] if band else None).cast("double") for x in ("low", "high"))
    return R.weighted_score(score_chunks(measures, bands), ["doc_id"])


def score_code(files: DataFrame, filename: str | None = "file_name") -> DataFrame:
    """Language, ten signals, score and wording per source text (doc_id, text)."""
    name = F.col(filename) if filename and filename in files.columns else None
    base = files.withColumn("language", C.detect_language(F.col("text"), name))
    sig = base.withColumn("signals", C.code_signals(F.col("text"), F.col("language")))
    scored = sig.withColumn("score", C.code_score(F.col("signals"))).withColumn("n_lines", F.size(T.lines(F.col("text"))))
    return scored.select(
        "doc_id", "language", "n_lines", "signals", "score", F.round(100.0 - F.col("score"), 1).alias("human_score"),
        B.verdict_band(F.col("score")).alias("verdict"), B.code_confidence(F.col("n_lines")).alias("confidence"),
        C.code_explanation(F.col("score"), F.col("signals"), F.col("language")).alias("explanation"),
    )


def score_code_documents(docs: DataFrame) -> DataFrame:
    """Code pages of documents, packed, scored and rolled up by lines."""
    chunks = chunk_documents(docs, "code").select(F.struct("doc_id", "chunk_no").alias("doc_id"), "text")
    scored = score_code(chunks, None).select("doc_id.*", "language", "n_lines", "score", "signals")
    return R.weighted_code_score(scored, ["doc_id"])


def analyse_documents(docs: DataFrame, **options) -> DataFrame:
    """Class, prose score, code score and status per document."""
    units = docs.select("doc_id", F.explode(classified_units(F.col("text"))).alias("u")).select("doc_id", "u.*")
    cls = R.document_class(units, ["doc_id"]).select("doc_id", "document_class")
    prose = score_documents(docs, **options).select(
        "doc_id", F.col("score").alias("prose_score"), "verdict", "chunks_analyzed", "chunks_skipped"
    )
    code = score_code_documents(docs).select("doc_id", F.col("score").alias("code_score"), F.col("language").alias("code_language"))
    out = docs.select("doc_id", Q.quality_gate(F.col("text")).alias("q")).join(cls, "doc_id", "left").join(
        prose, "doc_id", "left").join(code, "doc_id", "left")
    return out.withColumn(
        "status", status_label(F.col("prose_score"), F.col("code_score"), F.col("document_class"), F.col("q.status"))
    ).drop("q")


def status_label(prose: Column, code: Column, document_class: Column, gate: Column) -> Column:
    return (
        F.when(prose.isNotNull() & code.isNotNull(), "mixed").when(code.isNotNull(), "code")
        .when(prose.isNotNull(), "analyzed").when(document_class.isNull(), "extraction_failure")
        .when(gate == "insufficient", "insufficient_text").otherwise(gate)
    )


def structure_label(filename: Column) -> Column:
    low = F.lower(filename)
    return F.when(low.endswith(".pdf"), "pdf_pages").when(
        low.endswith(".pptx") | low.endswith(".ppt"), "pptx_slides"
    ).otherwise("flat")


def excerpt_preview(units: Column, chars: int = 3000) -> Column:
    """First characters of the joined prose pages, or of all pages if none is prose.

    ``units``: ``array<struct<text,kind>>``.
    """
    prose = F.filter(units, lambda u: u["kind"].isin("prose", "mixed"))
    shown = F.when(F.size(prose) > 0, prose).otherwise(units)
    return F.substring(T.strip(F.array_join(F.transform(shown, lambda u: u["text"]), "\n\n")), 1, chars)
