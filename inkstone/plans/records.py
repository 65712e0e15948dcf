"""Opinions, evaluation, history overview and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import opinions as O

RESULT_SCHEMA = """
heuristic struct<ai_likelihood_score: double, verdict: string, perplexity: double, burstiness: double>,
gemini_text struct<ai_probability: double, confidence: string, explanation: string,
                   flagged_sections: array<struct<text: string, reason: string>>>,
similarity struct<overall_similarity: double, chunks_compared: bigint, corpus_size: bigint, note: string,
                  top_match: double, top_match_verified: boolean, matched_portion: double, possible_portion: double,
                  matches: array<struct<matched_text: string, source_name: string, score: double, verified: boolean>>,
                  external: struct<status: string, note: string, sources: array<struct<title: string, url: string>>>>,
image_result struct<ai_probability: double, confidence: string, classification: string, explanation: string,
                    indicators: array<string>>,
extracted_text_preview string, final_verdict string, verdict_reason string
"""


def combine_detectors(opinions: DataFrame) -> DataFrame:
    """Headline and agreement per document over all opinions."""
    head = O.detector_headline(opinions)
    return head.join(O.detector_consensus(opinions).drop("providers_ran"), "doc_id")


def evaluate_detector(samples: DataFrame, scores: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """Per-group rates, one row per group and one for all: sampled, joined, rated."""
    chosen = samples if k is None else E.stratified_sample(samples, k, "group", "doc_id", seed)
    scored = E.sample_score_join(chosen.select("doc_id", "label", "group"), scores)
    groups = E.group_eval(scored)
    total = E.group_eval(scored.withColumn("group", F.lit("(all)")))
    return groups.unionByName(total)


def result_struct(text: Column) -> Column:
    """The stored result as a struct; malformed text gives an empty one."""
    return F.from_json(F.coalesce(text, F.lit("{}")), RESULT_SCHEMA)


def report_rows(history: DataFrame, result: str = "result") -> DataFrame:
    """(id, section, row_no, label, value): one row per line of a report."""
    r = F.col(result)
    # a pattern without groups: a plain number of digits would put commas into thousands
    pct = lambda c: F.concat(F.call_function("format_number", F.coalesce(c, F.lit(0.0)), F.lit("0.0")), F.lit("%"))
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("—"))

    def line(section: str, no: int, label, value, when=None) -> Column:
        text = F.lit(label) if isinstance(label, str) else label
        row = F.struct(F.lit(section).alias("section"), F.lit(no).alias("row_no"), text.alias("label"), value.alias("value"))
        return row if when is None else F.when(when, row)

    sim, gem, heu, img = r["similarity"], r["gemini_text"], r["heuristic"], r["image_result"]

    def many(section: str, arr: Column, limit: int, label, value) -> Column:
        items = F.slice(F.coalesce(arr, F.array()), F.lit(1), F.lit(limit))
        return F.transform(items, lambda x, i: F.struct(
            F.lit(section).alias("section"), i.alias("row_no"), label(x).alias("label"), value(x).alias("value")
        ))

    fixed = F.array_compact(F.array(
        line("record", 0, "File", dash(F.col("file_name"))),
        line("record", 1, "Analysed", dash(F.col("created_at"))),
        line("ai", 0, "Hosted analysis", pct(gem["ai_probability"]), gem.isNotNull()),
        line("ai", 1, "Local heuristic (writing-pattern signals)", pct(heu["ai_likelihood_score"]), heu.isNotNull()),
        line("ai", 2, "Explanation", gem["explanation"], gem["explanation"].isNotNull()),
        line("similarity", 0, "Overall similarity", pct(sim["overall_similarity"]), sim.isNotNull()),
        line("similarity", 1, "Matched sections", F.coalesce(F.size(sim["matches"]), F.lit(0)).cast("string"), sim.isNotNull()),
        line("similarity", 2, "Corpus size compared against", F.concat(F.coalesce(sim["corpus_size"], F.lit(0)).cast("string"), F.lit(" chunk(s)")), sim.isNotNull()),
        line("similarity", 3, "Note", sim["note"], (F.coalesce(F.size(sim["matches"]), F.lit(0)) <= 0) & (F.coalesce(sim["note"], F.lit("")) != "")),
        line("external", 0, "Note", sim["external"]["note"], F.coalesce(sim["external"]["note"], F.lit("")) != ""),
        line("image", 0, "AI-generated likelihood", pct(img["ai_probability"]), img.isNotNull()),
        line("image", 1, "Classification", F.initcap(F.replace(dash(img["classification"]), F.lit("_"), F.lit(" "))), img.isNotNull()),
        line("preview", 0, "Original text (excerpt)", F.concat(
            F.substring(r["extracted_text_preview"], 1, 1500),
            F.when(F.length(r["extracted_text_preview"]) > 1500, "…").otherwise(""),
        ), F.coalesce(r["extracted_text_preview"], F.lit("")) != ""),
        line("summary", 0, "Overall verdict", F.concat_ws(" ", r["final_verdict"], r["verdict_reason"]), r["final_verdict"].isNotNull()),
    ))
    rows = F.concat(
        fixed,
        many("flagged", gem["flagged_sections"], 10, lambda x: x["text"], lambda x: F.coalesce(x["reason"], F.lit(""))),
        many("match", sim["matches"], 10, lambda x: F.concat(pct(x["score"]), F.lit(" "), F.coalesce(x["source_name"], F.lit(""))),
             lambda x: F.substring(F.coalesce(x["matched_text"], F.lit("")), 1, 200)),
        many("source", sim["external"]["sources"], 1000, lambda x: x["title"], lambda x: F.coalesce(x["url"], F.lit(""))),
    )
    return history.select("id", F.explode(rows).alias("l")).select("id", "l.*")
