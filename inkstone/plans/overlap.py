"""Overlap of documents with a corpus, with fetched pages, and its reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import external as E
from ..operators import overlap as O
from ..operators import rewrite as W
from ..operators import segment as G
from ..operators.ordered import running_sums
from ..session import materialize


def query_passages(docs: DataFrame) -> DataFrame:
    """doc_id, passage_no, passage, tag, seq of documents (tag and seq optional)."""
    d = docs
    if "tag" not in d.columns:
        d = d.withColumn("tag", F.col("doc_id").cast("string"))
    if "seq" not in d.columns:
        d = d.withColumn("seq", F.lit(0).cast("long"))
    return G.explode_passages(d, keep=("tag", "seq"))


def corpus_passages(docs: DataFrame) -> DataFrame:
    """chunk_id, passage, tag, seq of stored documents; chunk ids follow doc ids and never collide."""
    d = docs
    if "tag" not in d.columns:
        d = d.withColumn("tag", F.col("doc_id").cast("string"))
    if "seq" not in d.columns:
        d = d.withColumn("seq", F.lit(0).cast("long"))
    p = G.explode_passages(d, keep=("tag", "seq"), stride=L.STORE_STRIDE)
    return p.select(
        O.chunk_number(F.col("doc_id"), F.col("passage_no")).alias("chunk_id"), "passage", "tag", "seq"
    )


def match_passages(
    docs: DataFrame, stored: DataFrame, floor: float = 0.0, exclude_own_tag: bool = False,
    earlier_only: bool = False,
) -> DataFrame:
    """Verified best match of every passage of ``docs`` among those of ``stored``."""
    best = O.best_match_per_passage(
        query_passages(docs), corpus_passages(stored), floor, exclude_own_tag, earlier_only
    )
    return O.lexical_corroboration(best)


def corpus_sizes(docs: DataFrame, corpus: DataFrame, exclude_own_tag: bool = False, earlier_only: bool = False) -> DataFrame:
    """(doc_id, corpus_size): how many stored passages each document was compared with."""
    total = corpus.count()
    if earlier_only:
        one = corpus.groupBy("seq").agg(F.count("*").alias("n"))
        seqs = docs.select("seq").distinct().withColumn("n", F.lit(0).cast("long")).unionByName(one).groupBy("seq").agg(F.sum("n").alias("n"))
        sizes = docs.select("doc_id", "seq").join(running_sums(seqs, [], "seq", {"n": "corpus_size"}), "seq", "left").select("doc_id", "corpus_size")
    else:
        sizes = docs.select("doc_id", F.lit(total).cast("long").alias("corpus_size"))
    if exclude_own_tag:
        own = corpus.groupBy("tag", *(["seq"] if earlier_only else [])).agg(F.count("*").alias("own"))
        mine = docs.select("doc_id", F.col("tag").alias("_tag"), *([F.col("seq").alias("_seq")] if earlier_only else []))
        met = mine.join(own, (F.col("tag") == F.col("_tag")) & ((F.col("seq") < F.col("_seq")) if earlier_only else F.lit(True)))
        held = met.groupBy("doc_id").agg(F.sum("own").alias("own"))
        sizes = sizes.join(held, "doc_id", "left").select("doc_id", (F.col("corpus_size") - F.coalesce("own", F.lit(0))).alias("corpus_size"))
    return sizes.groupBy("doc_id").agg(F.max("corpus_size").alias("corpus_size"))


def find_overlap(
    docs: DataFrame, stored: DataFrame, floor: float = 0.0, exclude_own_tag: bool = False,
    earlier_only: bool = False,
) -> DataFrame:
    """One report row per document, blank ones included; means and maxima over all passages are exact.

    Adds how many passages of the document were compared, with how many stored ones,
    and says so where there were none. A search ``floor`` above 0 is cheaper and counts
    passages below it as 0.
    """
    base = docs
    if "tag" not in base.columns:
        base = base.withColumn("tag", F.col("doc_id").cast("string"))
    if "seq" not in base.columns:
        base = base.withColumn("seq", F.lit(0).cast("long"))
    report = O.with_all_documents(O.overlap_report(match_passages(docs, stored, floor, exclude_own_tag, earlier_only)), docs)
    sized = report.join(corpus_sizes(base, corpus_passages(stored), exclude_own_tag, earlier_only), "doc_id")
    unmatched = (F.col("corpus_size") == 0) & (F.col("passages") > 0)
    return sized.withColumn("chunks_compared", F.when(F.col("corpus_size") > 0, F.col("passages")).otherwise(0)).withColumn(
        "note", F.when(unmatched, O.NOTE_NO_CORPUS).otherwise(F.col("note"))
    )


def match_report(found: DataFrame, sources: DataFrame, k: int = L.TOP_MATCHES) -> DataFrame:
    """The first ``k`` matches of every document, each with where it comes from.

    ``found``: verified best matches. ``sources``: source_id (the stored document),
    source_name, source_created_at, source_kind, source_url. A match whose source is
    not listed keeps its row.
    """
    percent = lambda c: F.round(100 * F.col(c), 1).alias(c)
    top = O.top_matches(found, k).withColumn("source_id", O.chunk_document(F.col("chunk_id")))
    return top.join(sources, "source_id", "left").select(
        "doc_id", "rank", "passage", "matched_text", percent("score"), percent("word_overlap"), percent("ngram_overlap"), "verified",
        "source_id", "source_name", "source_created_at", F.coalesce("source_kind", F.lit("submission")).alias("source_kind"), "source_url",
    )


def external_overlap(docs: DataFrame, external_docs: DataFrame, stored: DataFrame, floor: float = 0.0) -> DataFrame:
    """Reports over stored passages and the pages fetched for each document.

    A page wins only with a strictly higher score: stored passages come first.
    Adds the status of the check and the number of pages.
    """
    q = query_passages(docs)
    corpus = corpus_passages(stored)
    kept = materialize(E.external_prefilter(docs, external_docs), "external")
    inside = O.best_match_per_passage(q, corpus, floor)
    outside = E.best_external_match(q, kept, corpus).select(
        "doc_id", "passage_no", F.col("score").alias("x_score"), F.col("matched_text").alias("x_text"), F.col("kind").alias("x_kind")
    )
    both = inside.join(outside, ["doc_id", "passage_no"], "left")
    better = F.coalesce(F.col("x_score") > F.col("score"), F.lit(False))
    merged = both.select(
        "doc_id", "passage_no", "passage",
        F.when(better, F.col("x_score")).otherwise(F.col("score")).alias("score"),
        F.when(better, F.col("x_text")).otherwise(F.col("matched_text")).alias("matched_text"),
        F.when(better, F.col("x_kind")).when(F.col("score") > 0, "submission").alias("source_kind"),
    )
    found = O.lexical_corroboration(merged)
    report = O.overlap_report(found)
    from_pages = found.filter("verified").groupBy("doc_id").agg(
        F.count_if(F.col("source_kind") != "submission").alias("verified_from_pages")
    )
    pages = external_docs.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    out = (
        report.join(from_pages, "doc_id", "left").join(pages, "doc_id", "left")
        .join(E.probe_counts(docs), "doc_id", "left")
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        *report.columns, n("verified_from_pages").alias("verified_from_pages"), n("n_pages").alias("n_pages"),
        E.check_status(F.lit(len(L.SOURCE_LABELS)), n("n_probes"), n("n_pages"), F.lit(0)).alias("check_status"),
    )


def select_best_candidate(
    docs: DataFrame, candidates: DataFrame, stored: DataFrame, exclude_own_tag: bool = True,
) -> DataFrame:
    """The candidate rewrite with least verified overlap, if it is strictly less.

    ``candidates``: doc_id, candidate_no, source, text. Unusable ones never
    win. All candidates are searched in one job, the original as number 0.
    """
    base = docs if "tag" in docs.columns else docs.withColumn("tag", F.col("doc_id").cast("string"))
    usable = W.validate_candidates(
        candidates.join(base.select("doc_id", "tag", F.col("text").alias("original")), "doc_id"), "original", "text"
    ).filter(F.col("reason") == "")
    versions = base.select(
        "doc_id", F.lit(0).alias("candidate_no"), F.lit("none").alias("source"), "text", "tag"
    ).unionByName(usable.select("doc_id", F.col("candidate_no").cast("int").alias("candidate_no"), "source",
                                F.col("clean").alias("text"), "tag"))
    versions = materialize(versions.withColumn("vid", F.struct("doc_id", "candidate_no")), "versions")
    q = query_passages(versions.select(F.col("vid").alias("doc_id"), "text", "tag"))
    found = O.lexical_corroboration(
        O.best_match_per_passage(q, corpus_passages(stored), exclude_own_tag=exclude_own_tag)
    )
    rep = O.overlap_report(found).select("doc_id.*", "matched_portion", "top_match")
    scored = versions.join(rep, ["doc_id", "candidate_no"], "left").fillna(0.0, ["matched_portion", "top_match"])
    best = scored.groupBy("doc_id").agg(
        F.min_by(F.struct("candidate_no", "source", "text", "matched_portion"),
                 F.struct("matched_portion", "top_match", "candidate_no")).alias("b"),
        F.max(F.when(F.col("candidate_no") == 0, F.struct("matched_portion", "text"))).alias("o"),
        (F.count("*") - 1).alias("candidates_tried"),
    )
    better = F.col("b.matched_portion") < F.col("o.matched_portion")
    return best.select(
        "doc_id", "candidates_tried", F.col("o.matched_portion").alias("before"),
        F.when(better, F.col("b.matched_portion")).otherwise(F.col("o.matched_portion")).alias("after"),
        better.alias("improved"), F.when(better, F.col("b.source")).otherwise("none").alias("source"),
        F.when(better, F.col("b.candidate_no")).otherwise(0).alias("candidate_no"),
        F.when(better, F.col("b.text")).otherwise(F.col("o.text")).alias("rewritten_text"),
    )


def reduce_overlap(docs: DataFrame, stored: DataFrame, exclude_own_tag: bool = True) -> DataFrame:
    """Rewrite only verified passages, and only where that lowers the overlap."""
    found = match_passages(docs, stored, exclude_own_tag=exclude_own_tag)
    excerpts = materialize(W.verified_excerpts(found), "excerpts")
    return select_best_candidate(docs, W.local_candidates(docs, excerpts), stored, exclude_own_tag)


def rewrite_by_rules(docs: DataFrame, sentences: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, rewritten, changed): the chosen sentences reworded.

    ``sentences``: doc_id, sent_no, chosen; without it every sentence is.
    """
    from ..functions import text as T

    s = F.col("s")
    key = lambda i: F.xxhash64("doc_id", i, F.lit(seed))
    base = docs.select("doc_id", T.sentences(F.col("text")).alias("s"))
    if sentences is None:
        chosen = base.withColumn("pick", F.lit(None).cast("array<int>"))
    else:
        picks = sentences.filter("chosen").groupBy("doc_id").agg(F.collect_set("sent_no").alias("pick"))
        chosen = base.join(picks, "doc_id", "left").withColumn("pick", F.coalesce("pick", F.array().cast("array<int>")))
    new = F.transform(
        s, lambda x, i: F.when(F.col("pick").isNull() | F.array_contains("pick", i), W.reword(x, key(i))).otherwise(x)
    )
    done = chosen.select("doc_id", "s", new.alias("n"))
    changed = F.size(F.filter(F.zip_with("s", "n", lambda a, b: a != b), lambda x: x))
    return done.select("doc_id", F.array_join("n", " ").alias("rewritten"), changed.alias("changed"))
