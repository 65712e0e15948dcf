"""Registry, derived inputs and SQL building blocks (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query with its equivalent SQL (None: rows only)."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, dealt evenly: nearly all checks work within their rows."""
    return read_table(spark, sf, "documents", parts=spark.sparkContext.defaultParallelism).select("doc_id", "text", "lang", "source")


def r6(c):
    return F.round(c, 6)


# --- derived inputs: one SQL expression, read by both engines ----------------------

NL = "chr(10)"


def _code_expr() -> str:
    """Source text per document, in a language and a size that follow doc_id."""
    nm = "source || '_' || lang"
    todo = f"CASE WHEN doc_id % 5 = 0 THEN '{{c}} TODO: check ' || source || {NL} ELSE '' END"
    cliche = f"'{{c}} This function returns the value for ' || lang || {NL}"
    tmp = f"CASE WHEN doc_id % 7 = 0 THEN '    tmp = 1' || {NL} ELSE '' END"

    def brace(head: str, sig: str, body: str, comment: str, n: str) -> str:
        return (
            f"'{head}' || {NL} || {NL} || {todo.format(c=comment)} || repeat({cliche.format(c=comment)} || '{sig}' || {nm} || '(value) {{' || {NL}"
            f" || {tmp} || '{body}' || {NL} || '    return value;' || {NL} || '}}' || {NL} || {NL}, {n})"
        )

    n = "1 + CAST(doc_id % 4 AS INT)"
    py = (
        f"'import ' || lang || {NL} || {NL} || {todo.format(c='#')} || repeat('def handle_' || {nm} || '(value):' || {NL}"
        f" || CASE WHEN doc_id % 3 = 0 THEN '    \"\"\"Return the value.\"\"\"' || {NL} ELSE '' END || {tmp}"
        f" || '    if value is None:' || {NL} || '        raise ValueError(\"no ' || source || '\")' || {NL}"
        f" || '    try:' || {NL} || '        return int(value)' || {NL} || '    except TypeError:' || {NL} || '        return 0' || {NL} || {NL}, {n})"
    )
    sql = (
        f"'-- report of ' || source || {NL} || repeat('SELECT ' || lang || ', COALESCE(total, 0) FROM ' || source || ' WHERE total IS NOT NULL;' || {NL}, {n})"
    )
    by = {
        0: py,
        1: brace("const base = require(\"fs\");", "function ", "    if (value === null) { throw new TypeError(\"x\"); }", "//", n),
        2: brace("export interface Row { name: string; size: number }", "function ", "    if (value instanceof Row) { let k = 1; }", "//", n),
        3: brace("import java.util.List;", "public static int ", "    if (value == null) { throw new IllegalArgumentException(); }", "//", n),
        4: brace("#include <vector>", "int ", "    std::cout << value; assert(value != nullptr);", "//", n),
        5: brace("#include <stdio.h>", "int ", "    printf(value); if (value == NULL) { free(value); }", "//", n),
        6: brace("using System;", "public int ", "    Console.WriteLine(value); if (value == null) { throw new ArgumentNullException(); }", "//", n),
        7: brace("<?php", "function ", "    echo $_GET; if (is_null($value)) { $x = array(1); }", "//", n),
        8: brace("package main", "func ", "    fmt.Println(value); if err != nil { k := 1 }", "//", n),
        9: f"'require ' || lang || {NL} || {todo.format(c='#')} || repeat('def ' || {nm} || '(value)' || {NL} || '  puts value' || {NL} || '  raise ArgumentError if value.nil?' || {NL} || 'end' || {NL} || {NL}, {n})",
        10: brace("data class Row(val name: String)", "fun ", "    println(value); require(value != null)", "//", n),
        11: brace("protocol Sized { }", "func ", "    guard let size = value else { print(value) }", "//", n),
        12: sql,
    }
    return "CASE " + " ".join(f"WHEN doc_id % 13 = {k} THEN {v}" for k, v in by.items()) + " END"


CODE_EXPR = _code_expr()
EXT_EXPR = (
    "CASE doc_id % 13 WHEN 0 THEN 'a.py' WHEN 1 THEN 'b.JS' WHEN 4 THEN 'c.v2.cpp' WHEN 6 THEN 'd.cs' "
    "WHEN 12 THEN 'q.sql' WHEN 9 THEN 'noext' ELSE 'notes.txt' END"
)
CODE_SQL = f"code AS (SELECT doc_id, {CODE_EXPR} AS text, {EXT_EXPR} AS file_name FROM documents)"


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.expr(CODE_EXPR).alias("text"), F.expr(EXT_EXPR).alias("file_name"))


_T, _P = "CAST(o_custkey AS STRING)", "CAST(o_totalprice AS STRING)"
FIGURES_EXPR = (
    f"CASE o_orderkey % 8 WHEN 5 THEN 'Summary of the order' || {NL} || 'Total Price' || {NL} || '$' || {_P} || {NL} || {NL}"
    f" || 'Units sold' || {NL} || {_T} || 'k' "
    f"WHEN 6 THEN 'Order ' || {_T} || ' was shipped.' || {NL} || 'Nothing else is known' "
    f"WHEN 7 THEN 'Q1: ' || {_T} || {NL} || 'Q2: 7' || {NL} || 'Q3 = 1,200' "
    f"WHEN 1 THEN 'Red: ' || CAST(o_custkey % 60 AS STRING) || '%' || {NL} || '* Green – 30%' || {NL} || 'Blue\t12.5 %' "
    f"ELSE '- Quantity: ' || {_T} || {NL} || 'Extended price: $' || {_P} || {NL}"
    f" || 'Discount = 5%' || {NL} || 'Tax – ' || CAST(o_custkey % 9 AS STRING) || ' %' || {NL}"
    f" || 'quantity: 99' || {NL} || 'Backlog' || CASE WHEN o_orderkey % 8 = 3 THEN ': 2.5 million' ELSE ': 3 lakh' END || {NL}"
    f" || 'Parts = ' || {_T} || {NL} || 'not a pair' END"
)
FIGURES_SQL = f"figs AS (SELECT o_orderkey AS doc_id, {FIGURES_EXPR} AS text FROM orders)"


def figure_texts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.expr(FIGURES_EXPR).alias("text")
    )


def _history(num: str) -> str:
    return (
        "event_id AS id, 'file_' || CAST(user_id AS STRING) AS file_name, 'txt' AS file_type, "
        "CASE WHEN event_type = 'error' THEN 'image' ELSE 'text' END AS analysis_type, "
        "CASE WHEN event_type = 'signup' THEN NULL ELSE least(value, 100.0) END AS ai_probability, "
        f"CASE WHEN event_type = 'error' THEN NULL ELSE CAST({num} AS DOUBLE) END AS similarity_score, "
        "'analyzed' AS status, ts AS created_at"
    )


HISTORY_SQL = f"hist AS (SELECT {_history('''regexp_replace(props, '[^0-9]', '', 'g')''')} FROM events)"
NOW = "2024-01-30 12:00:00"


def history(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("file_"), F.col("user_id").cast("string")).alias("file_name"),
        F.lit("txt").alias("file_type"),
        F.when(F.col("event_type") == "error", "image").otherwise("text").alias("analysis_type"),
        F.when(F.col("event_type") != "signup", F.least("value", F.lit(100.0))).alias("ai_probability"),
        F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("double")).alias("similarity_score"),
        F.lit("analyzed").alias("status"), F.col("ts").alias("created_at"),
    )


OPINION_COLS = (
    "CASE i WHEN 0 THEN 'heuristic' WHEN 1 THEN 'binoculars' WHEN 2 THEN 'groq' WHEN 3 THEN 'gemini' "
    "WHEN 4 THEN 'openrouter' ELSE 'ollama' END AS provider, "
    "CASE WHEN doc_id % 3 = 0 THEN (doc_id * 37 + i * 531) % 1001 / 10.0 "
    "ELSE least(100.0, greatest(0.0, (doc_id * 37) % 101 + (doc_id * 13 + i * 7) % 21 - 10.0)) END AS p, "
    "CASE WHEN doc_id % 11 = 0 OR (doc_id + i) % 4 = 3 OR (doc_id % 5 = 1 AND i > 0) THEN 'timeout' END AS error"
)
OPINION_SQL = (
    f"op0 AS (SELECT doc_id, {OPINION_COLS} FROM (SELECT doc_id, unnest([0,1,2,3,4,5]) AS i FROM documents)), "
    "ops AS (SELECT doc_id, provider, CASE WHEN error IS NULL THEN CAST(p AS DOUBLE) END AS ai_probability, error, "
    "CASE WHEN error IS NOT NULL THEN 'unavailable' WHEN p >= 60 THEN 'likely_ai' WHEN p <= 40 THEN 'likely_human' "
    "ELSE 'uncertain' END AS verdict FROM op0)"
)


def opinions(spark: SparkSession, sf: str) -> DataFrame:
    from inkstone.functions.scores import verdict_band

    base = read_table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    base = base.selectExpr("doc_id", *[c for c in _split_top(OPINION_COLS)])
    ok = F.col("error").isNull()
    return base.select(
        "doc_id", "provider", F.when(ok, F.col("p").cast("double")).alias("ai_probability"), "error",
        F.when(ok, verdict_band(F.col("p"))).otherwise("unavailable").alias("verdict"),
    )


def _split_top(exprs: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for part in exprs.split(", "):
        cur = part if not cur else cur + ", " + part
        if cur.count("(") == cur.count(")") and cur.count("CASE") == cur.count("END"):
            out.append(cur)
            cur = ""
    return out


# --- SQL building blocks ----------------------------------------------------------

BL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BL})"


def sents(x: str) -> str:
    cut = rf"string_split(regexp_replace({strip(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s0: {strip('s0')}), lambda s0: s0 <> '')"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w0: w0 <> '')"


def wc(x: str) -> str:
    return f"len({words(x)})"


def lines(x: str) -> str:
    return rf"CASE WHEN {x} = '' THEN [] ELSE string_split(regexp_replace({x}, '\n\z', ''), chr(10)) END"


def lex(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9'']+')"


def grams(t: str, n: int = 3) -> str:
    """Distinct n-grams of a token list column."""
    parts = " || ' ' || ".join(f"{t}[i0 + {k}]" if k else f"{t}[i0]" for k in range(n))
    return f"list_distinct(list_transform(range(1, greatest(len({t}) - {n - 2}, 1)), lambda i0: {parts}))"


def setjac(a: str, b: str) -> str:
    """Jaccard of two lists of distinct items."""
    inter = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {inter} / (len({a}) + len({b}) - {inter}) END"


def contain(qg: str, sg: str) -> str:
    return f"CASE WHEN len({qg}) = 0 OR len({sg}) = 0 THEN 0.0 ELSE len(list_intersect({qg}, {sg})) / len({qg}) END"


def passages_sql(name: str, src: str, window: int, stride: int, idc: str = "doc_id") -> str:
    """CTEs ending in ``name(doc_id, passage_no, passage)`` over ``src(doc_id, text)``."""
    n = name
    return f"""
{n}_s AS (SELECT {idc} AS doc_id, {sents('text')} AS ss FROM {src}),
{n}_e AS (SELECT doc_id, len(ss) AS n, unnest(range(1, len(ss) + 1)) AS pos, ss FROM {n}_s WHERE len(ss) > 0),
{n}_l AS (SELECT doc_id, n, pos, {wc('ss[pos]')} AS w FROM {n}_e),
{n}_c AS (SELECT doc_id, n, pos, w, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS cum FROM {n}_l),
{n}_a AS (SELECT doc_id, n, pos, cum - w + {window} AS t_end, cum - w + {stride} AS t_next FROM {n}_c),
{n}_b AS (SELECT a.doc_id, a.n, a.pos, a.t_next, coalesce(b.pos, a.n) AS e FROM {n}_a a
   ASOF LEFT JOIN {n}_c b ON a.doc_id = b.doc_id AND a.t_end <= b.cum),
{n}_n AS (SELECT a.doc_id, a.n, a.pos, a.e, coalesce(b.pos + 1, a.n + 1) AS nx FROM {n}_b a
   ASOF LEFT JOIN {n}_c b ON a.doc_id = b.doc_id AND a.t_next <= b.cum),
{n}_r AS (SELECT doc_id, n, pos, e, nx FROM {n}_n WHERE pos = 1
   UNION ALL SELECT x.doc_id, x.n, x.pos, x.e, x.nx FROM {n}_r r JOIN {n}_n x ON x.doc_id = r.doc_id AND x.pos = r.nx WHERE r.e < r.n),
{n}_p AS (SELECT r.doc_id, r.pos, array_to_string(s.ss[r.pos:r.e], ' ') AS passage FROM {n}_r r JOIN {n}_s s ON s.doc_id = r.doc_id),
{n} AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS INT) AS passage_no, passage
   FROM {n}_p GROUP BY doc_id, passage)"""


def vectors_sql(name: str, texts: str, idf: str, count: str) -> str:
    """``name(key, term, w)``: unit TF-IDF vectors of ``texts(key, passage)``."""
    return f"""
{name}_t AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest({lex('passage')}) AS term FROM {texts}) GROUP BY 1, 2),
{name}_w AS (SELECT t.key, t.term, t.tf * coalesce(i.idf, ln((SELECT n FROM {count}) + 1.0)) AS raw, i.term IS NOT NULL AS known
   FROM {name}_t t LEFT JOIN {idf} i ON i.term = t.term),
{name} AS (SELECT w.key, w.term, w.raw / l.len AS w FROM {name}_w w
   JOIN (SELECT key, sqrt(sum(raw * raw)) AS len FROM {name}_w GROUP BY key) l ON l.key = w.key WHERE w.known AND w.raw > 0)"""


def overlap_sql(qp: str, cp: str, floor: float, allowed: str = "TRUE") -> str:
    """CTEs ending in ``found``: every passage of ``qp(doc_id, passage_no, passage,
    tag, seq)`` with its best chunk of ``cp(chunk_id, passage, tag, seq)``."""
    return f"""
cd AS (SELECT md5(passage) AS key, any_value(passage) AS passage FROM {cp} GROUP BY 1),
cn AS (SELECT count(*) AS n FROM cd),
idf AS (SELECT term, ln(((SELECT n FROM cn) + 1.0) / (count(DISTINCT key) + 1.0)) AS idf
   FROM (SELECT key, unnest({lex('passage')}) AS term FROM cd) GROUP BY term),
qd AS (SELECT md5(passage) AS key, any_value(passage) AS passage FROM {qp} GROUP BY 1),
{vectors_sql('cv', 'cd', 'idf', 'cn')},
{vectors_sql('qv', 'qd', 'idf', 'cn')},
sim AS (SELECT a.key AS qkey, b.key AS ckey, round(sum(a.w * b.w), 9) AS score FROM qv a JOIN cv b ON a.term = b.term GROUP BY 1, 2
   HAVING round(sum(a.w * b.w), 9) >= {floor} AND round(sum(a.w * b.w), 9) > 0),
qq AS (SELECT *, md5(passage) AS key FROM {qp}),
cc AS (SELECT *, md5(passage) AS key FROM {cp}),
hit AS (SELECT q.doc_id, q.passage_no, arg_max(struct_pack(score := s.score, chunk_id := c.chunk_id, matched_text := c.passage),
      struct_pack(a := s.score, b := -c.chunk_id)) AS m
   FROM qq q JOIN sim s ON s.qkey = q.key JOIN cc c ON c.key = s.ckey AND ({allowed}) GROUP BY 1, 2),
best AS (SELECT q.doc_id, q.passage_no, q.passage, coalesce(h.m.score, 0.0) AS score, h.m.chunk_id AS chunk_id, h.m.matched_text AS matched_text
   FROM {qp} q LEFT JOIN hit h ON h.doc_id = q.doc_id AND h.passage_no = q.passage_no),
{corroborate_sql('found', 'best')}"""


def corroborate_sql(name: str, best: str, floor: float = 0.45) -> str:
    return f"""
{name}_k AS (SELECT *, {lex('passage')} AS qt, {lex("coalesce(matched_text, '')")} AS st FROM {best}),
{name}_g AS (SELECT *, list_distinct(qt) AS qw, list_distinct(st) AS sw, {grams('qt')} AS qg, {grams('st')} AS sg FROM {name}_k),
{name}_o AS (SELECT *, CASE WHEN score >= {floor} THEN {setjac('qw', 'sw')} END AS word_overlap,
   CASE WHEN score >= {floor} THEN {contain('qg', 'sg')} END AS ngram_overlap FROM {name}_g),
{name} AS (SELECT *, coalesce(word_overlap >= 0.25 OR ngram_overlap >= 0.15, FALSE) AS verified FROM {name}_o)"""


REPORT_SQL = """
rep AS (SELECT doc_id, round(100 * avg(score), 1) AS overall_similarity, round(100 * max(score), 1) AS top_match,
   arg_max(verified, struct_pack(a := score, b := -passage_no)) AS top_match_verified,
   round(100.0 * count(*) FILTER (verified) / count(*), 1) AS matched_portion,
   round(100.0 * count(*) FILTER (score >= 0.45 AND NOT verified) / count(*), 1) AS possible_portion, count(*) AS passages,
   CASE WHEN bool_or(verified) THEN '' WHEN bool_or(score >= 0.45) THEN 'High topical similarity found, but no matching phrasing was verified — this can indicate a shared subject rather than copied content.'
   ELSE 'No individual passages crossed the match threshold.' END AS note FROM found GROUP BY doc_id)"""

QP_DOCS = passages_sql("qp0", "documents", 60, 30) + ", qp AS (SELECT *, CAST(doc_id AS VARCHAR) AS tag, 0 AS seq FROM qp0)"
CP_DOCS = passages_sql("cp0", "documents", 60, 60) + (
    ", cp AS (SELECT doc_id * 2147483648 + passage_no AS chunk_id, passage, CAST(doc_id AS VARCHAR) AS tag, 0 AS seq FROM cp0)"
)
BENCH_SRC = "bm AS (SELECT item_id AS doc_id, text FROM benchmark)"
CP_BENCH = BENCH_SRC + ", " + passages_sql("cp0", "bm", 60, 60) + (
    ", cp AS (SELECT doc_id * 2147483648 + passage_no AS chunk_id, passage, 'b' AS tag, 0 AS seq FROM cp0)"
)


def benchmark_docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
