"""Summaries of prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import lexicon as L
from inkstone.functions import values as V
from inkstone.operators import summary as S
from inkstone.plans import summaries as P

from .kit import FIGURES_SQL, check, docs, figure_texts, q, r6
from .texts import CONTENT, PAIRS_SQL, STRICT, TAB_SQL

TXT = lambda: F.col("text")
TOPIC = (
    "CASE doc_id % 4 WHEN 0 THEN 'Revenue growth and profit margin. ' WHEN 1 THEN 'The patient needs treatment now. ' "
    "WHEN 2 THEN 'Dataset results and regression analysis. ' ELSE '' END || text"
)
TYPED = f"td AS (SELECT doc_id, {TOPIC} AS text FROM documents)"
SCORES = "[" + ", ".join(
    "(" + " + ".join(f"CAST(contains(lower(text), {q(k)}) AS INT)" for k in kws) + ")" for kws in L.DOC_TYPE_KEYWORDS.values()
) + "]"
TYPE_SQL = f"""{TYPED}, ty AS (SELECT doc_id, CASE WHEN list_max(h) >= 2 THEN [{', '.join(q(k) for k in L.DOC_TYPE_KEYWORDS)}][list_position(h, list_max(h))] ELSE 'general' END AS doc_type FROM (SELECT doc_id, {SCORES} AS h FROM td))"""
TF_SQL = f"""tw AS (SELECT doc_id, unnest({CONTENT('text')}) AS term FROM td), tc AS (SELECT doc_id, term, count(*) AS n FROM tw GROUP BY 1, 2),
tf AS (SELECT doc_id, term, n, n / max(n) OVER (PARTITION BY doc_id) AS norm FROM tc)"""
FOCUS = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN list_contains([{', '.join(q(w) for w in v)}], t)" for k, v in L.FOCUS_KEYWORDS.items()) + " ELSE FALSE END"
SENT_SQL = f"""{TYPE_SQL}, {TF_SQL}, ss AS (SELECT doc_id, {STRICT} AS s FROM td), se AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos, len(s) AS total FROM ss),
sw AS (SELECT doc_id, pos, total, unnest({CONTENT('sentence')}) AS t FROM se),
sa AS (SELECT w.doc_id, w.pos, any_value(total) AS total, count(*) AS m, avg(f.norm) AS tf, count(*) FILTER ({FOCUS}) AS fc FROM sw w JOIN ty ON ty.doc_id = w.doc_id JOIN tf f ON f.doc_id = w.doc_id AND f.term = w.t GROUP BY 1, 2),
sv AS (SELECT a.doc_id, a.pos, e.sentence, (a.tf + CASE WHEN a.pos / greatest(a.total - 1, 1) <= 0.20 OR a.pos / greatest(a.total - 1, 1) >= 0.85 THEN 0.2 ELSE 0 END + 0.15 * fc / m) * least(m / 10, 1.0) AS score FROM sa a JOIN se e ON e.doc_id = a.doc_id AND e.pos = a.pos),
sx AS (SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) <= 8)"""


def typed(spark, sf):
    return docs(spark, sf).select("doc_id", F.expr(TOPIC).alias("text"))


@check("doc_type", f"WITH {TYPE_SQL} SELECT doc_id, doc_type FROM ty")
def _(spark, sf):
    return typed(spark, sf).select("doc_id", V.doc_type(TXT()).alias("doc_type"))


@check("term_frequency", f"WITH {TYPED}, {TF_SQL} SELECT doc_id, max(n) AS peak, count(*) AS terms, round(sum(norm), 6) AS norm_sum FROM tf GROUP BY 1")
def _(spark, sf):
    return S.term_frequency(typed(spark, sf)).groupBy("doc_id").agg(F.max("n").alias("peak"), F.count("*").alias("terms"), r6(F.sum("norm")).alias("norm_sum"))


@check("sentence_score", f"WITH {SENT_SQL} SELECT doc_id, CAST(pos AS INT) AS pos, round(score, 9) AS score FROM sv")
def _(spark, sf):
    return S.sentence_scores(typed(spark, sf)).select("doc_id", "pos", F.round("score", 9).alias("score"))


@check("extractive_summary", f"WITH {SENT_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS point_no, sentence FROM sx")
def _(spark, sf):
    return S.extractive_summary(typed(spark, sf)).select("doc_id", "point_no", "sentence")


CHART_SQL = """it AS (SELECT doc_id, count(*) AS n, bool_and(unit = '%') AS pct, sum(value) AS s, bool_and(regexp_matches(lower(label), '^(q[1-4]|fy\\s?\\d{2,4}|year\\s?\\d+|\\d{4})$')) AS tl FROM bucket GROUP BY 1),
ch AS (SELECT doc_id, CASE WHEN n < 2 THEN NULL WHEN tl THEN 'line' WHEN pct AND n <= 8 AND s BETWEEN 85 AND 115 THEN 'pie' WHEN n < 3 THEN NULL WHEN n > 8 THEN 'hbar' ELSE 'bar' END AS chart_type FROM it)"""


@check("choose_chart", f"WITH {FIGURES_SQL}, {PAIRS_SQL}, {CHART_SQL} SELECT doc_id, chart_type FROM ch WHERE chart_type IS NOT NULL")
def _(spark, sf):
    return P.key_figures(figure_texts(spark, sf)).select("doc_id", "chart_type")


@check("chart_points", f"""WITH {FIGURES_SQL}, {PAIRS_SQL}, {CHART_SQL} SELECT b.doc_id, string_agg(label, ';' ORDER BY CASE WHEN chart_type IN ('bar', 'hbar') THEN -value ELSE 0 END, src, line_no) AS labels FROM bucket b JOIN ch ON ch.doc_id = b.doc_id WHERE chart_type IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return P.key_figures(figure_texts(spark, sf)).select("doc_id", F.array_join(F.transform("points", lambda x: x["name"]), ";").alias("labels"))


@check("summarize_documents", f"""WITH {SENT_SQL}, tab AS ({TAB_SQL('td')}), pt AS (SELECT doc_id, string_agg(sentence, ' # ' ORDER BY pos) AS points FROM sx GROUP BY 1)
 SELECT p.doc_id, ty.doc_type, p.points FROM pt p JOIN ty ON ty.doc_id = p.doc_id JOIN tab ON tab.doc_id = p.doc_id WHERE NOT coalesce(tab.is_tabular, FALSE)""")
def _(spark, sf):
    out = P.summarize_documents(typed(spark, sf)).filter("NOT is_tabular")
    has = S.sentence_scores(typed(spark, sf)).select("doc_id").distinct()
    return out.join(has, "doc_id", "left_semi").select("doc_id", "doc_type", F.array_join("points", " # ").alias("points"))
