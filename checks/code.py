"""Source code: language, signals, score, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import codelex as C
from inkstone.functions import codestyle as S
from inkstone.functions import scores as B
from inkstone.operators import scoring as R
from inkstone.plans import scoring as P

from .kit import CODE_SQL, check, code_files, docs, lines, q, r6, strip

TXT = lambda: F.col("text")
LANG = lambda: F.col("language")


def count(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {q(p)}))"


def by_lang(fn, default: str | None = None, table=None) -> str:
    rules = table or C.LANGUAGES
    tail = fn(rules[C.FALLBACK_LANGUAGE]) if default is None else default
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {fn(v)}" for k, v in rules.items()) + f" ELSE {tail} END"


HITS = "[" + ", ".join(
    "(" + " + ".join(f"CAST(contains(lower(text), {q(k.lower())}) AS INT)" for k in r["keywords"]) + ")" for r in C.LANGUAGES.values()
) + "]"
NAMES = "[" + ", ".join(q(k) for k in C.LANGUAGES) + "]"
EXT = "CASE lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in C.EXTENSIONS.items()) + " END"
LANG_SQL = f"""{CODE_SQL}, h AS (SELECT *, {HITS} AS h FROM code),
lg AS (SELECT doc_id, text, coalesce({EXT}, CASE WHEN list_max(h) > 0 THEN {NAMES}[list_position(h, list_max(h))] ELSE 'unknown' END) AS language FROM h)"""
FUNCS = by_lang(lambda r: count("text", "(?m)" + r["func"]))
EDGES = by_lang(lambda r: " + ".join(count("text", "(?i)" + p) for p in r["edge"]))
DOCS = by_lang(lambda r: count("text", r["docstring"]))
ERRS = by_lang(lambda r: count("text", "(?is)" + r["error"]))
COMM = by_lang(lambda r: f"regexp_extract_all(text, {q('(?m)' + r['comment'])})")
CLEAN_SQL = "greatest(0.0, 1.0 - 0.2 * (" + " + ".join(f"CAST(regexp_matches(text, {q(p)}) AS INT)" for p in C.LEFTOVERS) + "))"
CL = f"list_filter({lines('text')}, lambda x0: {strip('x0')} <> '' AND NOT regexp_matches({strip('x0')}, {q(C.COMMENT_STARTS)}))"
IDS = f"regexp_extract_all(text, {q(C.IDENTIFIER)})"
KEPT = f"list_filter(ids, lambda x1: NOT list_contains([{', '.join(q(w) for w in C.IDENTIFIER_IGNORED)}], lower(x1)))"
SIG_SQL = f"""{LANG_SQL},
s0 AS (SELECT *, {FUNCS} AS nf, {EDGES} AS ne, {DOCS} AS nd, {ERRS} AS nr, {COMM} AS cm, {CL} AS cl, {IDS} AS ids FROM lg),
mk AS (SELECT doc_id, {by_lang(lambda r: f"regexp_replace(text, {q('(?m)(' + r['func'] + ')')}, chr(1) || {chr(39)}{chr(92)}1{chr(39)}, 'g')")} AS m FROM lg),
fl AS (SELECT doc_id, string_split(m, chr(1)) AS p FROM mk),
fm AS (SELECT doc_id, list_transform(CASE WHEN len(p) > 2 THEN p[2:len(p) - 1] ELSE [] END, lambda x0: len(x0) - len(replace(x0, chr(10), '')) + CASE WHEN ends_with(x0, chr(10)) THEN 0 ELSE 1 END) AS a FROM fl),
s1 AS (SELECT s0.*, {KEPT} AS kept, list_transform(cl, lambda x0: len(x0)) AS ll, fm.a AS fa FROM s0 JOIN fm ON fm.doc_id = s0.doc_id),
s2 AS (SELECT doc_id, language, text, len({lines('text')}) AS n_lines,
  round(len(cm) / greatest(len(cl), 1), 3) AS comment_density, round(len(list_filter(cm, lambda x0: regexp_matches(x0, {q(C.CLICHE_COMMENT)}))) / greatest(len(cm), 1), 3) AS generic_comment_ratio,
  round(least(nd / greatest(nf, 1), 1.0), 3) AS docstring_coverage,
  round(CASE WHEN len(kept) < 5 THEN 0.5 ELSE greatest(len(list_filter(kept, lambda x0: contains(x0, '_') AND x0 = lower(x0))), len(list_filter(kept, lambda x1: regexp_matches(x1, '^[a-z][a-zA-Z0-9]*[A-Z]'))), len(list_filter(kept, lambda x2: regexp_matches(x2, '^[A-Z][a-zA-Z0-9]+$')))) / len(kept) END, 3) AS naming_consistency,
  round(least(nr / greatest(nf, 1), 1.0), 3) AS error_handling_density, CAST(round(CAST(CASE WHEN len(ids) = 0 THEN 5.0 ELSE list_sum(list_transform(ids, lambda x0: len(x0))) / len(ids) END AS DECIMAL(18, 9)), 2) AS DOUBLE) AS avg_identifier_length,
  round(greatest(0.0, 1.0 - CASE WHEN len(fa) = 0 OR list_sum(fa) = 0 THEN 0.5 ELSE list_stddev_pop(fa) / list_avg(fa) END), 3) AS func_length_uniformity,
  round({CLEAN_SQL}, 3) AS cleanness, round(least(ne / (greatest(nf, 1) * 2.0), 1.0), 3) AS edge_case_density,
  round(CASE WHEN len(ll) < 6 THEN 0.5 ELSE greatest(0.0, least(1.0, 1.0 - (list_stddev_pop(ll) / greatest(list_avg(ll), 1.0) - 0.3) / 1.2)) END, 3) AS line_uniformity FROM s1),
s3 AS (SELECT *, round(greatest(0.0, least(100.0, 100 * ({' + '.join(f'{w} * {k}' for k, w in C.CODE_WEIGHTS.items())}))), 1) AS score FROM s2)"""
FEW = ["comment_density", "generic_comment_ratio", "docstring_coverage", "error_handling_density", "avg_identifier_length", "func_length_uniformity"]


def _typed(spark, sf):
    f = code_files(spark, sf)
    return f.withColumn("language", S.detect_language(TXT(), F.col("file_name")))


@check("detect_language", f"WITH {LANG_SQL} SELECT doc_id, language FROM lg")
def _(spark, sf):
    return _typed(spark, sf).select("doc_id", "language")


@check("code_signals", f"WITH {SIG_SQL} SELECT doc_id, {', '.join(FEW)} FROM s2")
def _(spark, sf):
    return _typed(spark, sf).select("doc_id", S.code_signals(TXT(), LANG()).alias("s")).select("doc_id", *[f"s.{c}" for c in FEW])


def _one(name: str, col):
    @check(name, f"WITH {SIG_SQL} SELECT doc_id, {name} FROM s2")
    def _(spark, sf):
        return _typed(spark, sf).select("doc_id", F.round(col(), 3).alias(name))


_one("cleanness", lambda: S.cleanness(TXT()))
_one("edge_case_density", lambda: S.edge_case_density(TXT(), LANG()))
_one("line_uniformity", lambda: S.line_uniformity(TXT()))
_one("naming_consistency", lambda: S.naming_consistency(TXT()))


@check("code_score", f"WITH {SIG_SQL} SELECT doc_id, score FROM s3")
def _(spark, sf):
    return _typed(spark, sf).select("doc_id", S.code_score(S.code_signals(TXT(), LANG())).alias("score"))


@check("score_code", f"""WITH {SIG_SQL} SELECT doc_id, language, CAST(n_lines AS INT) AS n_lines, score, round(100.0 - score, 1) AS human_score,
 CASE WHEN score >= 60 THEN 'likely_ai' WHEN score <= 40 THEN 'likely_human' ELSE 'uncertain' END AS verdict, CASE WHEN n_lines >= 60 THEN 'High' WHEN n_lines >= 20 THEN 'Medium' ELSE 'Low' END AS confidence FROM s3""")
def _(spark, sf):
    return P.score_code(code_files(spark, sf)).drop("signals", "explanation")


REASONS = ", ".join(
    "CASE WHEN " + " AND ".join(f"{name} {op} {bound}" for name, op, bound in terms) + f" THEN {q(text)} END" for terms, text in C.EXPLANATION_REASONS
)


@check("explanation_text", f"""WITH {SIG_SQL}, r AS (SELECT *, list_filter([{REASONS}], lambda x0: x0 IS NOT NULL) AS rs FROM s3)
 SELECT doc_id, 'This ' || language || ' code appears ' || CASE {' '.join(f"WHEN {rule} THEN {q(text)}" for rule, text in C.EXPLANATION_VERDICTS)} ELSE {q(C.EXPLANATION_OTHERWISE)} END || '. Key indicators: '
  || CASE WHEN len(rs) = 0 THEN {q(C.EXPLANATION_NO_REASON)} ELSE array_to_string(rs[1:4], '; ') END || {q('. ' + C.EXPLANATION_CLOSING)} AS explanation FROM r""")
def _(spark, sf):
    return P.score_code(code_files(spark, sf)).select("doc_id", "explanation")


@check("weighted_code_score", f"""WITH {SIG_SQL}, g AS (SELECT doc_id // 3 AS grp, doc_id % 3 AS k, * FROM s3), f AS (SELECT grp, language, min(k) AS k FROM g GROUP BY 1, 2), o AS (SELECT grp, string_agg(language, ', ' ORDER BY k) AS languages, count(*) AS n FROM f GROUP BY 1)
 SELECT g.grp AS doc_id, round(sum(score * greatest(n_lines, 1)) / sum(greatest(n_lines, 1)), 9) AS score, round(sum(cleanness * greatest(n_lines, 1)) / sum(greatest(n_lines, 1)), 9) AS cleanness,
 CAST(sum(greatest(n_lines, 1)) AS BIGINT) AS lines_analyzed, CASE WHEN any_value(o.n) = 1 THEN any_value(o.languages) ELSE 'multiple (' || any_value(o.languages) || ')' END AS language FROM g JOIN o ON o.grp = g.grp GROUP BY 1""")
def _(spark, sf):
    s = P.score_code(code_files(spark, sf)).withColumn("chunk_no", F.col("doc_id") % 3).withColumn("doc_id", F.floor(F.col("doc_id") / 3))
    out = R.weighted_code_score(s, ["doc_id"], digits=9)
    return out.select("doc_id", "score", "cleanness", "lines_analyzed", "language")


def _metric(table, x="text"):
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {count(x, '(?m)' + v)}" for k, v in table.items()) + " ELSE 0 END"


@check("code_metrics", f"""WITH {LANG_SQL} SELECT doc_id, CAST(len(list_filter({lines('text')}, lambda x0: {strip('x0')} <> '')) AS INT) AS lines, CAST({_metric(C.METRIC_FUNC)} AS INT) AS functions, CAST({_metric(C.METRIC_CLASS)} AS INT) AS classes, CAST({_metric(C.METRIC_IMPORT)} AS INT) AS imports FROM lg""")
def _(spark, sf):
    return _typed(spark, sf).select("doc_id", S.code_metrics(TXT(), LANG()).alias("m")).select("doc_id", "m.*")


@check("size_reduction", f"""WITH {LANG_SQL}, m AS (SELECT doc_id, len(list_filter({lines('text')}, lambda x0: {strip('x0')} <> '')) AS a, len(list_filter({lines("regexp_replace(text, '(?m)^ *(//|#).*$', '', 'g')")}, lambda x1: {strip('x1')} <> '')) AS b FROM lg)
 SELECT doc_id, round((a - b) * 100.0 / a, 6) AS reduction FROM m""")
def _(spark, sf):
    t = _typed(spark, sf).withColumn("after", F.regexp_replace("text", r"(?m)^ *(//|#).*$", ""))
    m = t.select("doc_id", S.code_metrics(TXT(), LANG())["lines"].alias("a"), S.code_metrics(F.col("after"), LANG())["lines"].alias("b"))
    return m.select("doc_id", r6(S.size_reduction(F.col("a"), F.col("b"))).alias("reduction"))


@check("scaled_code_signals", f"WITH {SIG_SQL} SELECT doc_id, round(least(1.0, greatest(0.0, comment_density / 0.3)), 6) AS comment_scaled, round(least(1.0, greatest(0.0, (avg_identifier_length - 4) / 7)), 6) AS identifier_scaled FROM s2")
def _(spark, sf):
    t = _typed(spark, sf).select("doc_id", S.scaled_signals(S.code_signals(TXT(), LANG())).alias("s"))
    return t.select("doc_id", r6("s.comment_scaled").alias("comment_scaled"), r6("s.identifier_scaled").alias("identifier_scaled"))
