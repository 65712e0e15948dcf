"""Opinions of several detectors and evaluation on labelled texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import scores as B
from inkstone.functions import text as T
from inkstone.functions import values as V
from inkstone.operators import evaluate as E
from inkstone.operators import opinions as O
from inkstone.plans import records as R
from inkstone.sources.readers import read_table

from .kit import OPINION_SQL, check, docs, opinions, r6, strip, wc
from .scoring import UNIF

FACTS = f"""{OPINION_SQL}, f AS (SELECT doc_id, count(*) FILTER (r) AS n, min(ai_probability) FILTER (r) AS lo, max(ai_probability) FILTER (r) AS hi, count(DISTINCT verdict) FILTER (r) AS nv,
 min(verdict) FILTER (r) AS v, min(provider) FILTER (r) AS p FROM (SELECT *, ai_probability IS NOT NULL AND error IS NULL AS r FROM ops) GROUP BY 1)"""
CONS = "CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'single' WHEN nv = 1 THEN 'unanimous' WHEN hi - lo >= 40 THEN 'conflicted' ELSE 'mixed' END"
CAP = "(n = 1 AND p = 'heuristic' AND v = 'likely_ai')"
VERD = f"CASE WHEN n = 0 OR {CAP} OR nv > 1 THEN 'Uncertain' WHEN v = 'likely_ai' THEN 'Likely AI' WHEN v = 'likely_human' THEN 'Likely Human' ELSE 'Uncertain' END"
BASIS = f"CASE WHEN n = 0 THEN 'none' WHEN {CAP} THEN 'single_capped' WHEN n = 1 THEN 'single' WHEN nv = 1 THEN 'agreement' ELSE 'disagreement' END"


@check("detectors_that_ran", f"WITH {OPINION_SQL} SELECT doc_id, provider FROM ops WHERE ai_probability IS NOT NULL AND error IS NULL")
def _(spark, sf):
    return opinions(spark, sf).filter(O.ran()).select("doc_id", "provider")


@check("detector_consensus", f"WITH {FACTS} SELECT doc_id, {CONS} AS agreement, n AS providers_ran, round(lo, 1) AS min_score, round(hi, 1) AS max_score, round(hi - lo, 1) AS spread FROM f")
def _(spark, sf):
    return O.detector_consensus(opinions(spark, sf))


@check("detector_headline", f"WITH {FACTS} SELECT doc_id, {VERD} AS verdict, {BASIS} AS basis, n AS providers_ran FROM f")
def _(spark, sf):
    return O.detector_headline(opinions(spark, sf)).drop("reason")


@check("combine_detectors", f"WITH {FACTS} SELECT doc_id, {VERD} AS verdict, {BASIS} AS basis, {CONS} AS agreement, round(hi - lo, 1) AS spread FROM f")
def _(spark, sf):
    return R.combine_detectors(opinions(spark, sf)).select("doc_id", "verdict", "basis", "agreement", "spread")


META = [("heuristic", "Local statistical", 0), ("binoculars", "Binoculars", 1), ("groq", "Groq (Llama)", 2), ("gemini", "Gemini", 3), ("openrouter", "OpenRouter (free pool)", 4), ("ollama", "Ollama (local)", 5)]


@check("provider_meta_join", f"WITH {OPINION_SQL} SELECT doc_id, provider, CASE provider " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b, _ in META) + " END AS label, CAST(CASE provider " + " ".join(f"WHEN '{a}' THEN {c}" for a, _, c in META) + " END AS INT) AS registry_order FROM ops")
def _(spark, sf):
    return O.provider_meta_join(opinions(spark, sf)).select("doc_id", "provider", "label", "registry_order")


REPLY = (
    "CASE doc_id % 7 WHEN 0 THEN '{\"ai_probability\": ' || CAST(doc_id % 101 AS STRING) || ', \"confidence\": \"HIGH\", \"explanation\": \"e' || source || '\"}' "
    "WHEN 1 THEN '```json' || chr(10) || '{\"ai_probability\": 0.' || CAST(doc_id % 9 AS STRING) || '5, \"confidence\": \"low\"}' || chr(10) || '```' "
    "WHEN 2 THEN 'Sure: {\"ai_probability\": 130, \"confidence\": \"certain\"} ok' WHEN 3 THEN 'no json' WHEN 4 THEN '{\"confidence\": \"low\"}' "
    "WHEN 5 THEN '{\"ai_probability\": \"many\"}' ELSE '{\"ai_probability\": -3.5, \"explanation\": \"' || repeat('x', 700) || '\"}' END"
)
JSON = r"CASE WHEN regexp_matches(reply, '(?s)\{.*\}') THEN regexp_extract(reply, '(?s)\{.*\}') END"
RAW_SQL = f"""r0 AS (SELECT doc_id, {REPLY} AS reply FROM documents), r1 AS (SELECT doc_id, {JSON} AS j FROM r0),
r2 AS (SELECT doc_id, j, json_extract_string(j, '$.ai_probability') AS p, json_extract_string(j, '$.confidence') AS c, json_extract_string(j, '$.explanation') AS e FROM r1)"""


@check("parse_model_reply", f"WITH {RAW_SQL} SELECT doc_id, p AS ai_probability, c AS confidence, substr(e, 1, 40) AS explanation FROM r2")
def _(spark, sf):
    r = docs(spark, sf).select("doc_id", V.parse_reply(F.expr(REPLY)).alias("r"))
    return r.select("doc_id", "r.ai_probability", "r.confidence", F.substring("r.explanation", 1, 40).alias("explanation"))


@check("normalise_reply_score", rf"""WITH {RAW_SQL}, k AS (SELECT *, TRY_CAST(p AS DOUBLE) AS n FROM r2), m AS (SELECT *, CASE WHEN n IS NOT NULL THEN greatest(0.0, least(100.0, CASE WHEN regexp_matches(p, '[.eE]') AND n BETWEEN 0 AND 1 THEN n * 100 ELSE n END)) END AS s FROM k)
 SELECT doc_id, round(s, 1) AS ai_probability, CASE WHEN s IS NULL THEN 'unavailable' WHEN s >= 60 THEN 'likely_ai' WHEN s <= 40 THEN 'likely_human' ELSE 'uncertain' END AS verdict,
 CASE WHEN lower(coalesce(c, 'medium')) IN ('low', 'medium', 'high') THEN lower(coalesce(c, 'medium')) ELSE 'medium' END AS confidence, len(coalesce(substr(e, 1, 600), '')) AS n_chars,
 CASE WHEN p IS NULL THEN 'the provider did not return a usable score.' WHEN n IS NULL THEN 'the returned score was not numeric.' END AS error FROM m""")
def _(spark, sf):
    r = O.normalise_replies(docs(spark, sf).select("doc_id", F.expr(REPLY).alias("reply")))
    return r.select("doc_id", "ai_probability", "verdict", "confidence", F.length("explanation").cast("long").alias("n_chars"), "error")


def _plug():
    return lambda texts: 100.0 * texts.str.count("e") / texts.str.len()


@check("detector_plugin", "SELECT doc_id, round(100.0 * (len(text) - len(replace(text, 'e', ''))) / len(text), 6) AS ai_probability FROM documents")
def _(spark, sf):
    return O.detector_plugin("letters", _plug, docs(spark, sf)).select("doc_id", r6("ai_probability").alias("ai_probability"))


# --- evaluation: two measured signals as detectors, labels as truth -----------------
# Ratios are rounded once, from exact counts, so both engines see the same scores.

TTR = lambda x: F.when(T.word_count(x) >= 12, F.round(100.0 * F.size(F.array_distinct(T.words(x))) / F.greatest(T.word_count(x), F.lit(1)), 0))
SAMPLE_SQL = f"""{UNIF}, sm AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'human' ELSE 'ai' END AS label, d.lang AS "group", {wc('d.text')} AS words,
  CASE WHEN {wc(strip('d.text'))} >= 12 THEN round(100 * u.u, 0) END AS score,
  CASE WHEN {wc('d.text')} >= 12 THEN round(100.0 * len(list_distinct(string_split_regex({strip('d.text')}, '\\s+'))) / {wc('d.text')}, 0) END AS score2
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN un u ON u.doc_id = d.doc_id)"""


def samples(spark, sf):
    lab = read_table(spark, sf, "labels")
    d = docs(spark, sf).join(lab, "doc_id")
    x = F.col("text")
    return d.select(
        "doc_id", F.when(F.col("quality") == 1, "human").otherwise("ai").alias("label"), F.col("lang").alias("group"),
        T.word_count(x).alias("words"), F.when(T.word_count(x) >= 12, F.round(100 * B.sentence_uniformity(x), 0)).alias("score"),
        TTR(T.strip(x)).alias("score2"),
    )


def wil(k: str, n: str, side: str) -> str:
    z = "1.96"
    p = f"({k} / nullif(CAST({n} AS DOUBLE), 0))"
    half = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n}))"
    centre = f"({p} + {z} * {z} / (2.0 * {n}))"
    den = f"(1 + {z} * {z} / {n})"
    if side == "low":
        return f"CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0, ({centre} - {half}) / {den}) END"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE least(1.0, ({centre} + {half}) / {den}) END"


GROUP_AGG = "count(score) AS n, round(avg(score), 6) AS mean, count(*) FILTER (score >= 60) AS called_ai, count(*) FILTER (score > 40 AND score < 60) AS uncertain, count(*) FILTER (score <= 40) AS called_human, count(*) FILTER (score IS NULL) AS skipped"
GROUP_COLS = ["label", "group", "n", "called_ai", "uncertain", "called_human", "skipped"]
GSEL = 'label, "group", n, called_ai, uncertain, called_human, skipped, mean'


def _groups(df):
    return df.select(*GROUP_COLS, r6("mean").alias("mean"))


@check("sample_score_join", f"WITH {SAMPLE_SQL} SELECT doc_id, label, score FROM sm")
def _(spark, sf):
    s = samples(spark, sf)
    return E.sample_score_join(s.select("doc_id", "label"), s.filter("score IS NOT NULL")).select("doc_id", "label", "score")


@check("group_eval", f'WITH {SAMPLE_SQL} SELECT label, "group", {GROUP_AGG} FROM sm GROUP BY 1, 2')
def _(spark, sf):
    return _groups(E.group_eval(samples(spark, sf)))


@check("wilson_interval", f"""WITH {SAMPLE_SQL}, g AS (SELECT label, "group", {GROUP_AGG} FROM sm GROUP BY 1, 2) SELECT label, "group", round({wil('called_ai', 'n', 'low')}, 6) AS ci_low, round({wil('called_ai', 'n', 'high')}, 6) AS ci_high FROM g""")
def _(spark, sf):
    return E.group_eval(samples(spark, sf)).select("label", "group", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


@check("auroc", f"""WITH {SAMPLE_SQL} SELECT round(sum(CASE WHEN a.score > h.score THEN 1.0 WHEN a.score = h.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc FROM sm a, sm h WHERE a.label = 'ai' AND h.label = 'human' AND a.score IS NOT NULL AND h.score IS NOT NULL""")
def _(spark, sf):
    return E.auroc(samples(spark, sf)).select(r6("auroc").alias("auroc"))


FT = "count(*) FILTER (label = 'human' AND score >= 60) AS fp, count(score) FILTER (label = 'human') AS hn, count(*) FILTER (label = 'ai' AND score >= 60) AS tp, count(score) FILTER (label = 'ai') AS an"


@check("fpr_tpr_summary", f"WITH {SAMPLE_SQL}, t AS (SELECT {FT} FROM sm) SELECT fp AS false_positives, hn AS human_n, tp AS true_positives, an AS ai_n, round({wil('fp', 'hn', 'low')}, 6) AS fpr_low, round({wil('tp', 'an', 'high')}, 6) AS tpr_high FROM t")
def _(spark, sf):
    o = E.fpr_tpr_summary(samples(spark, sf))
    return o.select("false_positives", "human_n", "true_positives", "ai_n", r6("fpr_low").alias("fpr_low"), r6("tpr_high").alias("tpr_high"))


@check("base_rate_precision", f"WITH {SAMPLE_SQL}, t AS (SELECT {FT} FROM sm) SELECT 0.1::DOUBLE AS prevalence, round(tp / an, 6) AS tpr, round(fp / hn, 6) AS fpr, round(0.1 * tp / an / nullif(0.1 * tp / an + 0.9 * fp / hn, 0), 6) AS \"precision\" FROM t")
def _(spark, sf):
    o = E.base_rate_precision(E.fpr_tpr_summary(samples(spark, sf)))
    return o.select("prevalence", *[r6(c).alias(c) for c in ("tpr", "fpr", "precision")])


@check("threshold_sweep", f"WITH {SAMPLE_SQL}, t AS (SELECT unnest([50.0, 60.0, 75.0]::DOUBLE[]) AS threshold) SELECT threshold, round(count(*) FILTER (label = 'human' AND score >= threshold) / count(score) FILTER (label = 'human'), 6) AS fpr, round(count(*) FILTER (label = 'ai' AND score >= threshold) / count(score) FILTER (label = 'ai'), 6) AS tpr FROM sm, t GROUP BY 1")
def _(spark, sf):
    return E.threshold_sweep(samples(spark, sf), [50, 60, 75]).select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@check("length_matched_rates", f'WITH {SAMPLE_SQL} SELECT label, "group", {GROUP_AGG} FROM sm WHERE words BETWEEN 60 AND 150 GROUP BY 1, 2')
def _(spark, sf):
    return _groups(E.group_eval(samples(spark, sf).filter(F.col("words").between(60, 150))))


@check("robustness_flip", f"WITH {SAMPLE_SQL}, c AS (SELECT score, score2 FROM sm WHERE label = 'ai' AND score >= 60 AND score2 IS NOT NULL) SELECT count(*) AS n, round(avg(score2 - score), 6) AS mean_delta, count(*) FILTER (score2 < 60) AS no_longer_ai, count(*) FILTER (score2 <= 40) AS now_human FROM c")
def _(spark, sf):
    s = samples(spark, sf)
    o = E.robustness_flip(s, s.select("doc_id", F.col("score2").alias("score")))
    return o.select("n", r6("mean_delta").alias("mean_delta"), "no_longer_ai", "now_human")


@check("detector_agreement_matrix", f"WITH {SAMPLE_SQL} SELECT label, count(*) AS n, count(*) FILTER (score >= 60) AS first_flagged, count(*) FILTER (score2 >= 60) AS second_flagged, count(*) FILTER (score >= 60 AND score2 >= 60) AS both_flagged, count(*) FILTER (score >= 60 OR score2 >= 60) AS either_flagged FROM sm WHERE score IS NOT NULL AND score2 IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return E.detector_agreement_matrix(samples(spark, sf), "score", "score2")


PICK = "pick AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY \"group\" ORDER BY md5('0#' || CAST(doc_id AS VARCHAR)), doc_id) <= 25)"


@check("stratified_sample", f'WITH {SAMPLE_SQL}, {PICK} SELECT doc_id, "group" FROM pick')
def _(spark, sf):
    return E.stratified_sample(samples(spark, sf), 25).select("doc_id", "group")


@check("evaluate_detector", f'WITH {SAMPLE_SQL} SELECT label, "group", {GROUP_AGG} FROM sm GROUP BY 1, 2 UNION ALL SELECT label, \'(all)\', {GROUP_AGG} FROM sm GROUP BY 1')
def _(spark, sf):
    s = samples(spark, sf)
    return _groups(R.evaluate_detector(s.select("doc_id", "label", "group"), s))
