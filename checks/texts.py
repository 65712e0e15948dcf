"""Admission, routing, bands and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import lexicon as L
from inkstone.functions import quality as Q
from inkstone.functions import scores as B
from inkstone.functions import text as T
from inkstone.functions import values as V
from inkstone.operators import segment as G
from inkstone.plans import scoring as P
from inkstone.sources.readers import read_table

from .kit import (
    CODE_SQL, FIGURES_SQL, check, code_files, docs, figure_texts, grams, history, HISTORY_SQL, lex, lines,
    passages_sql, q, r6, sents, strip, wc, words,
)

TXT = lambda: F.col("text")
ST = strip("text")
ALPHA = rf"(len(regexp_replace({ST}, '[^\p{{L}}]+', '', 'g')) / nullif(len({ST}), 0))"
# RE2 has no back-references: the run is spelt out for every character up to U+017F.
RUN = "|".join(
    (("\\" + chr(c)) if chr(c) in r"\.+*?()|[]{}^$" else chr(c)) + "{5,}" for c in [*range(33, 127), *range(161, 384)]
)
RUN_SQL = f"regexp_matches({ST}, {q(RUN)})"
KEYS = "[" + ", ".join(q(w) for w in Q.keyboard_windows()) + "]"


def token_flag(t: str) -> str:
    low = f"replace(lower({t}), '''', '')"
    vowels = f"len(regexp_replace({low}, '[^aeiouy]', '', 'g'))"
    ratio = f"CASE WHEN len({low}) = 0 THEN 0.0 ELSE {vowels} / len({low}) END"
    starts = f"list_filter(range(1, greatest(len({t}) - 3, 1)), lambda p0: list_contains({KEYS}, lower({t})[p0:p0 + 4]))"
    cover = f"len(list_distinct(flatten(list_transform({starts}, lambda p1: range(p1, p1 + 5))))) / len({t})"
    return (
        f"len({t}) >= 5 AND (({ratio}) = 0 OR (len({t}) >= 8 AND ({ratio}) < 0.15) OR ({cover}) >= 0.5)"
    )


TOK_SQL = f"""tok AS (SELECT doc_id, unnest(regexp_extract_all({ST}, '[A-Za-z'']+')) AS t FROM documents),
gib AS (SELECT doc_id, count(*) FILTER ({token_flag('t')}) / count(*) AS share FROM tok GROUP BY doc_id)"""
GATE_SQL = f"""{TOK_SQL},
gate AS (SELECT d.doc_id, {wc(ST.replace('text', 'd.text'))} AS word_count,
  CASE WHEN coalesce({strip('d.text')}, '') = '' THEN 'insufficient'
    WHEN {ALPHA.replace('text', 'd.text')} < 0.40 THEN 'unanalyzable'
    WHEN {RUN_SQL.replace('text', 'd.text')} THEN 'unanalyzable'
    WHEN g.share >= 0.5 OR g.share IS NULL THEN 'unanalyzable'
    WHEN {wc(strip('d.text'))} < 12 THEN 'insufficient' ELSE 'ok' END AS status
  FROM documents d LEFT JOIN gib g ON g.doc_id = d.doc_id)"""


@check("alpha_ratio", f"SELECT doc_id, round({ALPHA}, 6) AS alpha_ratio FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", r6(Q.alpha_ratio(TXT())).alias("alpha_ratio"))


@check("repeated_run", f"SELECT doc_id, {RUN_SQL} AS repeated FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", Q.repeated_run(T.strip(TXT())).alias("repeated"))


@check("gibberish_token", f"""WITH {TOK_SQL}, u AS (SELECT DISTINCT t FROM tok),
 made AS (SELECT t FROM u UNION SELECT t[1:4] || 'qwertyui' || t[5:6] FROM u UNION SELECT 'zxcvb' || t[1:5] FROM u)
 SELECT t AS token, {token_flag('t')} AS gibberish FROM made""")
def _(spark, sf):
    seen = docs(spark, sf).select(F.explode(Q.latin_tokens(T.strip(TXT()))).alias("t")).distinct()
    t = F.col("t")
    made = seen.select(F.explode(F.array(
        t, F.concat(F.substring(t, 1, 4), F.lit("qwertyui"), F.substring(t, 5, 2)), F.concat(F.lit("zxcvb"), F.substring(t, 1, 5)),
    )).alias("token")).distinct()
    return made.select("token", Q.gibberish_token(F.col("token")).alias("gibberish"))


@check("gibberish_ratio", f"WITH {TOK_SQL} SELECT d.doc_id, round(g.share, 6) AS share FROM documents d LEFT JOIN gib g ON g.doc_id = d.doc_id")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", r6(Q.gibberish_ratio(TXT())).alias("share"))


@check("quality_gate", f"WITH {GATE_SQL} SELECT doc_id, status, word_count FROM gate")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", Q.quality_gate(TXT()).alias("g")).select("doc_id", "g.status", "g.word_count")


# RE2 word boundaries are ASCII only; a non-ASCII letter becomes an ASCII one first.
FLAT = lambda x: rf"regexp_replace({x}, '[^\x00-\x7F]', 'z', 'g')"
HITS = lambda x: f"len(regexp_extract_all({FLAT(x)}, {q(L.CODE_TOKEN_PATTERN)}))"
CODE_LINE = lambda x: f"(len({strip(x)}) >= 3 AND {HITS(strip(x))} >= 2)"
PSEUDO = (
    f"CASE WHEN len({ST}) - len(replace({ST}, chr(10), '')) >= greatest(1, len({ST}) // 200) THEN {lines(ST)} "
    rf"ELSE string_split(regexp_replace({ST}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END"
)


@check("is_code_line", f"""WITH {CODE_SQL}, src AS (SELECT doc_id, text FROM code UNION ALL SELECT page_id + 1000000000, html FROM pages),
 ln AS (SELECT doc_id, unnest({lines('text')}) AS line FROM src)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({CODE_LINE('line')}) AS code_lines FROM ln GROUP BY doc_id""")
def _(spark, sf):
    pages = read_table(spark, sf, "pages").select((F.col("page_id") + 1000000000).alias("doc_id"), F.col("html").alias("text"))
    both = code_files(spark, sf).select("doc_id", "text").unionByName(pages)
    rows = both.select("doc_id", F.explode(T.lines(TXT())).alias("line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(Q.is_code_line(F.col("line"))).alias("code_lines"))


BLOCK_SQL = lambda src: f"""ps AS (SELECT doc_id, list_filter({PSEUDO}, lambda x0: {strip('x0')} <> '') AS ls FROM {src}),
pl AS (SELECT doc_id, len(ls) AS n, unnest(CASE WHEN len(ls) = 0 THEN [NULL] ELSE ls END) AS line FROM ps),
pr AS (SELECT doc_id, any_value(n) AS n, count(*) FILTER (line IS NOT NULL AND {CODE_LINE('line')}) / nullif(any_value(n), 0) AS r FROM pl GROUP BY doc_id),
blk AS (SELECT doc_id, CASE WHEN r IS NULL THEN 'empty' WHEN r >= 0.5 THEN 'code' WHEN r <= 0.15 THEN 'prose' ELSE 'mixed' END AS kind FROM pr)"""  # noqa: E731
MIXED_SRC = f"{CODE_SQL}, src AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000, text FROM code UNION ALL SELECT page_id + 2000000000, html FROM pages)"


def mixed_source(spark, sf):
    pages = read_table(spark, sf, "pages").select((F.col("page_id") + 2000000000).alias("doc_id"), F.col("html").alias("text"))
    code = code_files(spark, sf).select((F.col("doc_id") + 1000000000).alias("doc_id"), "text")
    return docs(spark, sf).select("doc_id", "text").unionByName(code).unionByName(pages)


@check("classify_block", f"WITH {MIXED_SRC}, {BLOCK_SQL('src')} SELECT doc_id, kind FROM blk")
def _(spark, sf):
    return mixed_source(spark, sf).select("doc_id", Q.classify_block(TXT()).alias("kind"))


@check("pseudo_lines", f"SELECT doc_id, array_to_string({PSEUDO}, '|') AS parts FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.pseudo_lines(T.strip(TXT())), "|").alias("parts"))


TAB_SQL = lambda src: f"""WITH t AS (SELECT doc_id, list_filter({lines(ST)}, lambda x0: {strip('x0')} <> '') AS ls FROM {src})
 SELECT doc_id, len(ls) >= 3 AND (len(list_filter(ls, lambda x1: len(x1) - len(replace(x1, ',', '')) >= 3))
   + len(list_filter(ls, lambda x2: len(x2) - len(replace(x2, chr(9), '')) >= 3))) / nullif(len(ls), 0) > 0.5 AS is_tabular FROM t"""  # noqa: E731


@check("is_tabular", TAB_SQL("documents"))
def _(spark, sf):
    return docs(spark, sf).select("doc_id", Q.is_tabular(TXT()).alias("is_tabular"))


# --- bands over the history table --------------------------------------------------

def band(name: str, sql_case: str, column):
    @check(name, f"WITH {HISTORY_SQL} SELECT id, {sql_case} AS band FROM hist")
    def _(spark, sf):
        return history(spark, sf).select("id", column().alias("band"))


P_, S_ = "ai_probability", "similarity_score"
band("verdict_band", f"CASE WHEN {P_} >= 60 THEN 'likely_ai' WHEN {P_} <= 40 THEN 'likely_human' WHEN {P_} IS NOT NULL THEN 'uncertain' END", lambda: B.verdict_band(F.col(P_)))
band("confidence_band", f"CASE WHEN abs({P_} - 50) >= 30 THEN 'high' WHEN abs({P_} - 50) >= 15 THEN 'medium' ELSE 'low' END", lambda: B.confidence_band(F.col(P_)))
band("similarity_band", f"CASE WHEN {S_} >= 50 THEN 'flag' WHEN {S_} >= 25 THEN 'uncertain' ELSE 'low' END", lambda: B.similarity_band(F.col(S_)))
band("sentence_heat_band", f"CASE WHEN {P_} < 25 THEN 'machine' WHEN {P_} > 50 THEN 'human' ELSE 'uncertain' END", lambda: B.sentence_heat_band(F.col(P_)))
band("code_confidence", f"CASE WHEN {S_} >= 60 THEN 'High' WHEN {S_} >= 20 THEN 'Medium' ELSE 'Low' END", lambda: B.code_confidence(F.col(S_)))


# --- segmentation ------------------------------------------------------------------

@check("units_from_text", f"""WITH u AS (SELECT doc_id, string_split_regex(text, '\\n\\n|\\f') AS p FROM (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS text FROM documents)),
 e AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, p FROM u) SELECT doc_id, CAST(i AS INT) AS unit_index, p[i] AS text FROM e WHERE {strip('p[i]')} <> ''""")
def _(spark, sf):
    paged = docs(spark, sf).withColumn("text", F.replace(TXT(), F.lit(".\n"), F.lit(".\n\n")))
    return G.units_from_text(paged)


@check("split_sentences", f"WITH s AS (SELECT doc_id, {sents('text')} AS ss FROM documents), e AS (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, ss FROM s) SELECT doc_id, CAST(i - 1 AS INT) AS sent_no, ss[i] AS sentence FROM e")
def _(spark, sf):
    return G.explode_sentences(docs(spark, sf))


STRICT = rf"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s0: {strip('s0')}), lambda s1: len(s1) > 20 AND len(s1) < 600)"


@check("split_sentences_strict", f"WITH s AS (SELECT doc_id, {STRICT} AS ss FROM documents), e AS (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, ss FROM s) SELECT doc_id, CAST(i - 1 AS INT) AS sent_no, ss[i] AS sentence FROM e")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(T.sentences_strict(TXT())).alias("sent_no", "sentence"))


@check("passage_windows", f"WITH RECURSIVE {passages_sql('a', 'documents', 60, 30)}, {passages_sql('b', 'documents', 60, 60)} SELECT 'query' AS side, * FROM a UNION ALL SELECT 'store', * FROM b")
def _(spark, sf):
    d = docs(spark, sf)
    one = G.explode_passages(d).withColumn("side", F.lit("query"))
    return one.unionByName(G.explode_passages(d, stride=L.STORE_STRIDE).withColumn("side", F.lit("store")))


PACK_SQL = f"""u AS (SELECT conv_id AS doc_id, turn + 1 + turn // 3 AS idx, {strip('text')} AS text, {wc(strip('text'))} AS n FROM conversations WHERE {strip('text')} <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rn, lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS pv FROM u),
f AS (SELECT doc_id, rn, n AS buf, 0 AS chunk FROM o WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.rn, CASE WHEN o.idx <> o.pv + 1 OR f.buf + o.n > 350 THEN o.n ELSE f.buf + o.n END,
    f.chunk + CASE WHEN o.idx <> o.pv + 1 OR f.buf + o.n > 350 THEN 1 ELSE 0 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1)"""


@check("pack_chunks", f"""WITH RECURSIVE {PACK_SQL} SELECT f.doc_id, CAST(f.chunk AS BIGINT) AS chunk_no, string_agg(o.text, chr(10) || chr(10) ORDER BY o.idx) AS text,
 string_agg(CAST(o.idx AS VARCHAR), ',' ORDER BY o.idx) AS units FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn GROUP BY 1, 2""")
def _(spark, sf):
    turns = read_table(spark, sf, "conversations").select(  # a gap after every third turn
        F.col("conv_id").alias("doc_id"), F.expr("turn + 1 + turn div 3").alias("unit_index"), "text"
    )
    return G.pack_units(turns).select("doc_id", "chunk_no", "text", F.array_join(F.transform("unit_indices", lambda i: i.cast("string")), ",").alias("units"))


CODE_MIX = f"mix AS (SELECT d.doc_id, d.text || chr(10) || c.text || chr(10) || d.lang || chr(10) || c.text AS text FROM documents d JOIN code c ON c.doc_id = d.doc_id)"


def prose_with_code(spark, sf):
    c = code_files(spark, sf).select("doc_id", F.col("text").alias("code"))
    return docs(spark, sf).join(c, "doc_id").select(
        "doc_id", F.concat_ws("\n", "text", "code", "lang", "code").alias("text")
    )


@check("extract_code_blocks", f"""WITH {CODE_SQL}, {CODE_MIX}, ln AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM (SELECT doc_id, {lines('text')} AS ls FROM mix)),
 k AS (SELECT doc_id, i, ls[i] AS line, CASE WHEN {CODE_LINE('ls[i]')} THEN 1 WHEN {strip('ls[i]')} = '' THEN 0 ELSE -1 END AS c FROM ln),
 g AS (SELECT *, sum(CASE WHEN c = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM k),
 b AS (SELECT doc_id, grp, string_agg(line, chr(10) ORDER BY i) AS code FROM g WHERE c >= 0 GROUP BY 1, 2 HAVING count(*) FILTER (c = 1) >= 4)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INT) AS block_no, {strip('code')} AS code FROM b""")
def _(spark, sf):
    return G.extract_code_blocks(prose_with_code(spark, sf))


@check("tokens_lexical", f"SELECT doc_id, array_to_string({lex('text')}, ' ') AS tokens FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.tokens_lexical(TXT()), " ").alias("tokens"))


STOP = "[" + ", ".join(q(w) for w in dict.fromkeys(L.STOPWORDS)) + "]"
# A word of three letters or more that no other letter, digit or underscore touches.
CONTENT = lambda x: (
    rf"list_filter(list_transform(list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w1: regexp_full_match(w1, '[a-zA-Z]{{3,}}')), lambda w2: lower(w2)), lambda w3: NOT list_contains({STOP}, w3))"
)


@check("tokens_content", f"SELECT doc_id, array_to_string({CONTENT('text')}, ' ') AS tokens FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.tokens_content(TXT()), " ").alias("tokens"))


@check("ngrams", f"""WITH t AS (SELECT doc_id, unnest(tk) AS w, generate_subscripts(tk, 1) AS i FROM (SELECT doc_id, {lex('text')} AS tk FROM documents)),
 g AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS gram FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i))
 SELECT DISTINCT doc_id, gram FROM g WHERE gram IS NOT NULL""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(T.ngrams(T.tokens_lexical(TXT()))).alias("gram"))


@check("probe_sentences", f"""WITH s AS (SELECT doc_id, list_filter({sents('text')}, lambda x0: {wc('x0')} >= 9) AS ss FROM documents),
 e AS (SELECT doc_id, len(ss) AS m, least(3, len(ss)) AS k, unnest(range(0, least(3, len(ss)))) AS i, ss FROM s WHERE len(ss) > 0),
 c AS (SELECT doc_id, i, CAST(floor(i * (m / k)) AS INT) AS lo, CAST(floor((i + 1) * (m / k)) AS INT) AS hi, ss FROM e),
 x AS (SELECT doc_id, i, unnest(range(lo + 1, greatest(hi, lo + 1) + 1)) AS j, ss FROM c),
 b AS (SELECT doc_id, i, arg_min(ss[j], struct_pack(a := -{wc('ss[j]')}, b := j)) AS best FROM x GROUP BY 1, 2)
 SELECT doc_id, CAST(i AS INT) AS probe_no, array_to_string({words('best')}[1:24], ' ') AS probe FROM b""")
def _(spark, sf):
    return G.probe_sentences(docs(spark, sf))


@check("mid_phrase", f"""WITH s AS (SELECT doc_id, unnest({sents('text')}) AS x FROM documents), w AS (SELECT doc_id, {words("translate(x, '\"\\', '  ')")} AS ws FROM s)
 SELECT doc_id, array_to_string(CASE WHEN len(ws) >= 12 THEN ws[3:12] ELSE ws END, ' ') AS phrase FROM w""")
def _(spark, sf):
    return G.explode_sentences(docs(spark, sf)).select("doc_id", V.mid_phrase(F.col("sentence")).alias("phrase"))


# --- numbers in text ---------------------------------------------------------------

def value_cols(line: str, pattern: str, shift: int) -> str:
    g = lambda k: f"regexp_extract({line}, {q(pattern)}, {shift + k})"
    num = f"TRY_CAST(replace({g(2)}, ',', '') AS DOUBLE)"
    sc = f"lower({g(3)})"
    mult = "CASE " + " ".join(f"WHEN {sc} = '{k}' THEN {v}" for k, v in L.SCALES.items()) + " ELSE 1.0 END"
    return (
        f"{num} AS num, CASE WHEN {g(4)} = '%' OR ({g(1)} = '' AND {sc} = '') THEN {num} ELSE {num} * {mult} END AS value, "
        f"CASE WHEN {g(4)} = '%' THEN '%' WHEN {g(1)} <> '' OR {sc} <> '' THEN 'scaled' ELSE 'plain' END AS unit, "
        f"CASE WHEN {g(4)} <> '%' AND {sc} <> '' THEN {sc} END AS scale_word"
    )


SAME_SQL = f"""f_ln AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM (SELECT doc_id, {lines('text')} AS ls FROM figs)),
f_st AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, {strip('ls[i]')} AS line FROM f_ln),
f_hit AS (SELECT doc_id, line_no, {strip(f"regexp_extract(line, {q(L.PAIR_LINE_PATTERN)}, 1)")} AS label, {value_cols('line', L.PAIR_LINE_PATTERN, 1)} FROM f_st WHERE regexp_matches(line, {q(L.PAIR_LINE_PATTERN)})),
f_one AS (SELECT * FROM f_hit WHERE num IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, lower(label) ORDER BY line_no) = 1),
same AS (SELECT doc_id, line_no, label, value, unit, scale_word FROM f_one QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 30)"""
BESIDE_SQL = f"""a_ln AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS k, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM f_st WHERE line <> ''),
a_hit AS (SELECT doc_id, CAST(k AS INT) AS line_no, {strip(f"regexp_extract(line, {q(L.LABEL_LINE_PATTERN)}, 1)")} AS label, {value_cols('nxt', L.VALUE_LINE_PATTERN, 0)} FROM a_ln
  WHERE regexp_matches(line, {q(L.LABEL_LINE_PATTERN)}) AND regexp_matches(nxt, {q(L.VALUE_LINE_PATTERN)})),
a_one AS (SELECT * FROM a_hit WHERE num IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, lower(label) ORDER BY line_no) = 1),
beside AS (SELECT doc_id, line_no, label, value, unit, scale_word FROM a_one QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 30)"""
PAIRS_SQL = f"""{SAME_SQL}, {BESIDE_SQL},
pairs AS (SELECT 0 AS src, * FROM same UNION ALL SELECT 1, b.* FROM beside b
  WHERE (SELECT count(*) FROM same s WHERE s.doc_id = b.doc_id) < 2 AND NOT EXISTS (SELECT 1 FROM same s WHERE s.doc_id = b.doc_id AND lower(s.label) = lower(b.label))),
ucount AS (SELECT doc_id, unit, count(*) AS n, min(src * 1000 + line_no) AS f FROM pairs GROUP BY 1, 2),
upick AS (SELECT doc_id, arg_min(unit, struct_pack(a := -n, b := f)) AS unit, max(n) AS n FROM ucount GROUP BY 1),
bucket AS (SELECT p.* FROM pairs p JOIN upick u ON u.doc_id = p.doc_id AND u.unit = p.unit WHERE u.n >= 2)"""


@check("kv_pairs_same_line", f"WITH {FIGURES_SQL}, {SAME_SQL} SELECT * FROM same")
def _(spark, sf):
    return G.kv_pairs_same_line(figure_texts(spark, sf))


@check("kv_pairs_adjacent_line", f"WITH {FIGURES_SQL}, {SAME_SQL}, {BESIDE_SQL} SELECT * FROM beside")
def _(spark, sf):
    return G.kv_pairs_adjacent_line(figure_texts(spark, sf))


@check("largest_unit_bucket", f"WITH {FIGURES_SQL}, {PAIRS_SQL} SELECT doc_id, CAST(src AS INT) AS src, line_no, label, value, unit, scale_word FROM bucket")
def _(spark, sf):
    return G.largest_unit_bucket(G.quantitative_pairs(figure_texts(spark, sf)))


@check("parse_number", r"""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN '$' || CAST(l_extendedprice AS STRING) WHEN 1 THEN ' 1,' || CAST(l_partkey AS STRING) || ' '
 WHEN 2 THEN CAST(l_discount AS STRING) || '%' ELSE l_returnflag || CAST(l_quantity AS STRING) END AS v FROM lineitem)
 SELECT id, CAST(TRY_CAST(CASE WHEN regexp_full_match(trim(regexp_replace(v, '[,$%]', '', 'g')), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN trim(regexp_replace(v, '[,$%]', '', 'g')) END AS DOUBLE) AS DOUBLE) AS number FROM c""")
def _(spark, sf):
    v = F.expr(
        "CASE l_linenumber % 4 WHEN 0 THEN '$' || CAST(l_extendedprice AS STRING) WHEN 1 THEN ' 1,' || CAST(l_partkey AS STRING) || ' ' "
        "WHEN 2 THEN CAST(l_discount AS STRING) || '%' ELSE l_returnflag || CAST(l_quantity AS STRING) END"
    )
    return read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), V.parse_number(v).alias("number")
    )


@check("parse_scaled_value", f"WITH {FIGURES_SQL}, {SAME_SQL} SELECT doc_id, line_no, round(value, 6) AS value, unit, scale_word FROM f_hit WHERE num IS NOT NULL")
def _(spark, sf):
    rows = figure_texts(spark, sf).select("doc_id", F.posexplode(T.lines(TXT())).alias("line_no", "raw"))
    rows = rows.withColumn("v", V.scaled_value(V.matched_groups(T.strip(F.col("raw")), L.PAIR_LINE_PATTERN, 5), 1)).filter("v IS NOT NULL")
    return rows.select("doc_id", "line_no", r6(F.col("v.value")).alias("value"), "v.unit", "v.scale_word")


@check("is_time_label", """WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%b') WHEN 1 THEN 'Q' || CAST(o_orderkey % 7 AS STRING)
 WHEN 2 THEN CAST(year(o_orderdate) AS STRING) WHEN 3 THEN 'FY ' || CAST(o_orderkey % 100 AS STRING) ELSE o_orderpriority END AS label FROM orders)
 SELECT id, list_contains([""" + ", ".join(q(m) for m in L.MONTHS) + "], lower(trim(label))) OR regexp_matches(lower(trim(label)), " + q(L.TIME_LABEL_PATTERN) + ") AS is_time FROM s")
def _(spark, sf):
    label = F.expr(
        "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'MMM') WHEN 1 THEN 'Q' || CAST(o_orderkey % 7 AS STRING) "
        "WHEN 2 THEN CAST(year(o_orderdate) AS STRING) WHEN 3 THEN 'FY ' || CAST(o_orderkey % 100 AS STRING) ELSE o_orderpriority END"
    )
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), V.is_time_label(label).alias("is_time"))


# --- candidates, quotes, figures ----------------------------------------------------

CAND = (
    "CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'Here is the rewritten ' || text WHEN 2 THEN substr(text, 1, 20) "
    "WHEN 3 THEN '```text' || chr(10) || text || chr(10) || '```' WHEN 4 THEN text || ' ' || text || ' ' || text WHEN 5 THEN '``````' ELSE lower(text) END"
)
CLEAN = (
    rf"CASE WHEN starts_with({strip('cand')}, '```') THEN {strip(r'''regexp_replace(regexp_replace(''' + strip('cand') + r''', '\A```[a-zA-Z]*\n?', ''), '\n?```\z', '')''')} ELSE {strip('cand')} END"
)
META = " OR ".join(f"starts_with(lower(clean), {q(p)})" for p in L.META_PREFIXES)


@check("validate_candidates", f"""WITH c AS (SELECT doc_id, text, {CAND} AS cand FROM documents), k AS (SELECT *, {CLEAN} AS clean FROM c)
 SELECT doc_id, clean, CASE WHEN {strip('cand')} = '' THEN 'empty response' WHEN clean = '' THEN 'empty after stripping code fences'
  WHEN {META} THEN 'contains meta-commentary rather than just the rewrite'
  WHEN NOT (len(clean) / greatest(len(text), 1) BETWEEN 0.5 AND 2.0) THEN 'length ratio outside safe bounds (likely truncated or padded)' ELSE '' END AS reason FROM k""")
def _(spark, sf):
    from inkstone.operators.rewrite import validate_candidates

    c = docs(spark, sf).select("doc_id", "text", F.expr(CAND).alias("cand"))
    return validate_candidates(c, "text", "cand").select("doc_id", "clean", "reason")


FOLD = lambda x: rf"lower(regexp_replace({x}, '\s+', ' ', 'g'))"


@check("grounded_quotes", f"""WITH s AS (SELECT doc_id, text, unnest({sents('text')}) AS x FROM documents), k AS (SELECT doc_id, text, lower(x) || CASE WHEN len(x) % 4 = 0 THEN ' zq' ELSE '' END AS quote FROM s)
 SELECT doc_id, quote, trim({FOLD('quote')}) <> '' AND contains({FOLD('text')}, trim({FOLD('quote')})) AS grounded FROM k""")
def _(spark, sf):
    quote = lambda x: F.concat(F.lower(x), F.when(F.length(x) % 4 == 0, " zq").otherwise(""))
    k = docs(spark, sf).select("doc_id", "text", F.transform(T.sentences(TXT()), quote).alias("quotes"))
    both = k.select("doc_id", F.arrays_zip("quotes", V.quotes_grounded(TXT(), F.col("quotes")).alias("grounded")).alias("x"))
    return both.select("doc_id", F.inline("x").alias("quote", "grounded"))


@check("grounded_numbers", r"""WITH k AS (SELECT o_orderkey AS id, 'total ' || CAST(o_totalprice AS STRING) || ', customer ' || CAST(o_custkey AS STRING) AS ctx,
  CASE o_orderkey % 3 WHEN 0 THEN CAST(o_totalprice AS STRING) WHEN 1 THEN 'about ' || CAST(o_custkey AS STRING) || ' of 77123' ELSE o_orderpriority END AS v FROM orders),
 d AS (SELECT id, lower(regexp_replace(ctx, '[,\s]', '', 'g')) AS c, regexp_extract_all(v, '-?\d+(?:\.\d+)?') AS n FROM k)
 SELECT id, len(n) > 0 AND len(list_filter(n, lambda x0: NOT contains(c, x0))) = 0 AS grounded FROM d""")
def _(spark, sf):
    ctx = F.concat(F.lit("total "), F.col("o_totalprice").cast("string"), F.lit(", customer "), F.col("o_custkey").cast("string"))
    v = F.expr(
        "CASE o_orderkey % 3 WHEN 0 THEN CAST(o_totalprice AS STRING) WHEN 1 THEN 'about ' || CAST(o_custkey AS STRING) || ' of 77123' ELSE o_orderpriority END"
    )
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), V.numbers_grounded(v, ctx).alias("grounded"))


@check("excerpt_preview", f"""WITH {MIXED_SRC}, {BLOCK_SQL('src')} SELECT s.doc_id, substr({strip('s.text')}, 1, 3000) AS preview FROM src s JOIN blk b ON b.doc_id = s.doc_id""")
def _(spark, sf):
    u = mixed_source(spark, sf).select("doc_id", F.array(F.struct(TXT().alias("text"), Q.classify_block(TXT()).alias("kind"))).alias("u"))
    return u.select("doc_id", P.excerpt_preview(F.col("u")).alias("preview"))
