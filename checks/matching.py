"""Overlap, duplicates, external pages, vectors, rewriting, ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import dense as D
from inkstone.operators import external as E
from inkstone.operators import overlap as O
from inkstone.operators import rewrite as W
from inkstone.operators import segment as G
from inkstone.plans import overlap as P
from inkstone.session import materialize, scratch_dir
from inkstone.sources.readers import read_table
from inkstone.streaming import ingest as I

from .kit import (
    BENCH_SRC, CP_BENCH, HISTORY_SQL, QP_DOCS, REPORT_SQL, benchmark_docs, check, contain, corroborate_sql, docs, grams, history, lex,
    overlap_sql, passages_sql, q, r6, sents, setjac, strip, vectors_sql, wc,
)

TXT = lambda: F.col("text")
BENCH_FULL = f"WITH RECURSIVE {QP_DOCS}, {CP_BENCH}, {overlap_sql('qp', 'cp', 0)}"
# Pairs of all documents are too many for plain SQL: those queries have none and
# are compared with brute force on a small fixture in the tests.
REPORT_COLS = "doc_id, overall_similarity, top_match, top_match_verified, matched_portion, possible_portion, passages, note"


def bench_matches(spark, sf, floor=0.0):
    return P.match_passages(docs(spark, sf), benchmark_docs(spark, sf).withColumn("tag", F.lit("b")), floor)


@check("best_match_per_passage", f"{BENCH_FULL} SELECT doc_id, passage_no, score, coalesce(chunk_id, -1) AS chunk_id FROM best")
def _(spark, sf):
    b = O.best_match_per_passage(P.query_passages(docs(spark, sf)), P.corpus_passages(benchmark_docs(spark, sf)))
    return b.select("doc_id", "passage_no", "score", F.coalesce(F.col("chunk_id").cast("long"), F.lit(-1)).alias("chunk_id"))


@check("lexical_corroboration", f"{BENCH_FULL} SELECT doc_id, passage_no, round(word_overlap, 6) AS word_overlap, round(ngram_overlap, 6) AS ngram_overlap, verified FROM found WHERE score >= 0.45")
def _(spark, sf):
    return bench_matches(spark, sf, 0.45).filter("score >= 0.45").select(
        "doc_id", "passage_no", r6("word_overlap").alias("word_overlap"), r6("ngram_overlap").alias("ngram_overlap"), "verified"
    )


FULL_COLS = REPORT_COLS + ", corpus_size, chunks_compared"


@check("find_overlap", f"""{BENCH_FULL}, {REPORT_SQL} SELECT d.doc_id, coalesce(overall_similarity, 0) AS overall_similarity, coalesce(top_match, 0) AS top_match, coalesce(top_match_verified, FALSE) AS top_match_verified,
 coalesce(matched_portion, 0) AS matched_portion, coalesce(possible_portion, 0) AS possible_portion, coalesce(passages, 0) AS passages, coalesce(note, {q(O.NOTE_EMPTY)}) AS note,
 (SELECT count(*) FROM cp) AS corpus_size, coalesce(passages, 0) AS chunks_compared FROM documents d LEFT JOIN rep r ON r.doc_id = d.doc_id""")
def _(spark, sf):
    return P.find_overlap(docs(spark, sf), benchmark_docs(spark, sf).withColumn("tag", F.lit("b"))).select(*FULL_COLS.split(", "))


@check("match_report", f"""{BENCH_FULL}, {HISTORY_SQL}, tm AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY verified DESC, round(score * 100, 1) DESC, passage_no) AS rank FROM found WHERE score >= 0.45)
 SELECT doc_id, CAST(rank AS INT) AS rank, md5(passage) AS passage_md5, md5(matched_text) AS matched_md5, round(100 * score, 1) AS score, round(100 * word_overlap, 1) AS word_overlap, round(100 * ngram_overlap, 1) AS ngram_overlap, verified,
 chunk_id // 2147483648 AS source_id, h.file_name AS source_name, strftime(h.created_at, '%Y-%m-%d %H:%M:%S') AS source_created_at, h.file_type AS source_kind FROM tm LEFT JOIN hist h ON h.id = chunk_id // 2147483648 WHERE rank <= 8""")
def _(spark, sf):
    """Matches of all documents among the benchmark passages, named by the history record of the same id."""
    sources = history(spark, sf).select(
        F.col("id").alias("source_id"), F.col("file_name").alias("source_name"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("source_created_at"),
        F.col("file_type").alias("source_kind"), F.lit(None).cast("string").alias("source_url"),
    )
    m = P.match_report(bench_matches(spark, sf, 0.45), sources)
    return m.select("doc_id", "rank", F.md5("passage").alias("passage_md5"), F.md5("matched_text").alias("matched_md5"), "score", "word_overlap", "ngram_overlap",
                    "verified", "source_id", "source_name", "source_created_at", "source_kind")


@check("overlap_report")
def _(spark, sf):
    d = docs(spark, sf)
    return P.find_overlap(d, d, exclude_own_tag=True).select(*REPORT_COLS.split(", "))


@check("top_matches", f"""{BENCH_FULL}, tm AS (SELECT doc_id, passage_no, verified, round(score * 100, 1) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY verified DESC, round(score * 100, 1) DESC, passage_no) AS rank FROM found WHERE score >= 0.45)
 SELECT doc_id, passage_no, verified, score, CAST(rank AS INT) AS rank FROM tm WHERE rank <= 8""")
def _(spark, sf):
    return O.top_matches(bench_matches(spark, sf, 0.45)).select(
        "doc_id", "passage_no", "verified", F.round(F.col("score") * 100, 1).alias("score"), "rank"
    )


@check("exclude_source")
def _(spark, sf):
    d = docs(spark, sf)
    m = O.best_match_per_passage(P.query_passages(d), P.corpus_passages(d), exclude_own_tag=True)
    return m.filter("score > 0").select("doc_id", "passage_no", "score", F.col("chunk_id").cast("long").alias("chunk_id"))


@check("tfidf_vectors", f"""WITH RECURSIVE {BENCH_SRC}, {passages_sql('cp', 'bm', 60, 60)}, cd AS (SELECT md5(passage) AS key, any_value(passage) AS passage FROM cp GROUP BY 1),
 cn AS (SELECT count(*) AS n FROM cd), idf AS (SELECT term, ln(((SELECT n FROM cn) + 1.0) / (count(DISTINCT key) + 1.0)) AS idf FROM (SELECT key, unnest({lex('passage')}) AS term FROM cd) GROUP BY term),
 {vectors_sql('cv', 'cd', 'idf', 'cn')} SELECT key, term, round(w, 6) AS w FROM cv""")
def _(spark, sf):
    p = P.corpus_passages(benchmark_docs(spark, sf)).select(O.text_key(F.col("passage")).alias("key"), "passage").dropDuplicates(["key"])
    t = O.term_rows(p)
    return O.tfidf_vectors(t, O.fit_idf(t, p), p.select(F.count("*")).scalar()).select("key", "term", r6("w").alias("w"))


@check("passage_cosine", f"""WITH RECURSIVE {QP_DOCS}, {CP_BENCH}, {overlap_sql('qp', 'cp', 0.2)}
 SELECT qkey, ckey, score FROM sim""")
def _(spark, sf):
    """All pairs of distinct passages at or above a cosine of 0.2."""
    return O.similar_pairs(P.query_passages(docs(spark, sf)), P.corpus_passages(benchmark_docs(spark, sf)), 0.2).select(
        "qkey", "ckey", "score"
    )


@check("word_jaccard", f"""WITH d AS (SELECT doc_id, list_distinct({lex('text')}) AS a FROM documents), n AS (SELECT count(*) AS n FROM benchmark), b AS (SELECT item_id, list_distinct({lex('text')}) AS b FROM benchmark)
 SELECT doc_id, item_id, round({setjac('a', 'b')}, 6) AS jaccard FROM d JOIN b ON b.item_id = d.doc_id % (SELECT n FROM n)""")
def _(spark, sf):
    d, b = _paired(spark, sf)
    return d.join(b, "item_id").select(
        "doc_id", "item_id", r6(T.jaccard(F.array_distinct(T.tokens_lexical(F.col("text"))), F.array_distinct(T.tokens_lexical(F.col("other"))))).alias("jaccard")
    )


@check("ngram_containment", f"""WITH d AS (SELECT doc_id, {lex('text')} AS a FROM documents), n AS (SELECT count(*) AS n FROM benchmark), b AS (SELECT item_id, {lex('text')} AS b FROM benchmark),
 dg AS (SELECT doc_id, unnest(list_distinct(a)) AS g FROM d), bg AS (SELECT item_id, unnest({grams('b', 2)}) AS g FROM b),
 dt AS (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM d), d2 AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM dt) WHERE g IS NOT NULL),
 tot AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1),
 hit AS (SELECT d2.doc_id, count(*) AS k FROM d2 JOIN bg ON bg.item_id = d2.doc_id % (SELECT n FROM n) AND bg.g = d2.g GROUP BY 1)
 SELECT d.doc_id, round(coalesce(CASE WHEN EXISTS (SELECT 1 FROM d2 WHERE d2.doc_id = d.doc_id) THEN h.k END, 0) / t.n, 6) AS containment
 FROM d JOIN tot t ON t.item_id = d.doc_id % (SELECT n FROM n) LEFT JOIN hit h ON h.doc_id = d.doc_id""")
def _(spark, sf):
    d, b = _paired(spark, sf)
    g = lambda c: T.ngrams(T.tokens_lexical(F.col(c)), 2)
    return d.join(b, "item_id").select("doc_id", r6(T.containment(g("other"), g("text"))).alias("containment"))


def _paired(spark, sf):
    b = read_table(spark, sf, "benchmark")
    n = b.select(F.count("*")).scalar()
    d = docs(spark, sf).select("doc_id", "text", (F.col("doc_id") % n).alias("item_id"))
    return d, b.select("item_id", F.col("text").alias("other"))


@check("exact_duplicates", f"SELECT substr(sha256({strip('text')}), 1, 12) AS tag, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return O.exact_duplicates(docs(spark, sf))


@check("window_distinct", f"WITH RECURSIVE {passages_sql('a', 'documents', 60, 60)} SELECT md5(passage) AS key, count(*) AS copies, count(DISTINCT doc_id) AS holders FROM a GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    p = G.explode_passages(docs(spark, sf), stride=60).select(O.text_key(F.col("passage")).alias("key"), "doc_id")
    per_doc = p.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("key").agg(F.sum("n").alias("copies"), F.count("*").alias("holders")).filter("copies > 1")


# --- pages fetched per document -----------------------------------------------------

PAGE_SQL = """pn AS (SELECT count(*) AS n FROM benchmark),
ext AS (SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN 'wikipedia' ELSE 'arxiv' END AS kind, 'Item ' || CAST(b.item_id AS VARCHAR) AS title, 'http://page/' || CAST(b.item_id AS VARCHAR) AS url,
  CASE WHEN d.doc_id % 3 = 0 THEN b.text || ' ' || d.text ELSE b.text END AS text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT n FROM pn))"""


def external_docs(spark, sf):
    d, b = _paired(spark, sf)
    return d.join(b, "item_id").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "wikipedia").otherwise("arxiv").alias("kind"),
        F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"),
        F.concat(F.lit("http://page/"), F.col("item_id").cast("string")).alias("url"),
        F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", "other", "text")).otherwise(F.col("other")).alias("text"),
    )


PRE_SQL = f"""{QP_DOCS}, {PAGE_SQL}, {passages_sql('ep', 'ext', 60, 60)},
qf AS (SELECT doc_id, passage_no, list_distinct(qt) AS qw, {grams('qt')} AS qg FROM (SELECT *, {lex('passage')} AS qt FROM qp)),
ef AS (SELECT doc_id, passage_no, passage, list_distinct(st) AS sw, {grams('st')} AS sg FROM (SELECT *, {lex('passage')} AS st FROM ep)),
pj AS (SELECT e.doc_id, e.passage_no AS window_no, any_value(e.passage) AS passage, max({setjac('q.qw', 'e.sw')}) AS word_share, max({contain('q.qg', 'e.sg')}) AS gram_share FROM ef e JOIN qf q ON q.doc_id = e.doc_id GROUP BY 1, 2),
kept AS (SELECT * FROM pj WHERE word_share >= 0.12 OR gram_share >= 0.05)"""


@check("external_prefilter", f"WITH RECURSIVE {PRE_SQL} SELECT doc_id, CAST(window_no AS INT) AS window_no, round(word_share, 6) AS word_share, round(gram_share, 6) AS gram_share FROM kept")
def _(spark, sf):
    return E.external_prefilter(docs(spark, sf), external_docs(spark, sf)).select(
        "doc_id", "window_no", r6("word_share").alias("word_share"), r6("gram_share").alias("gram_share")
    )


XB = f"""fx AS (SELECT passage FROM cp UNION ALL SELECT passage FROM kept),
{overlap_sql('qp', 'cp', 0).replace('found', 'inner_found')},
xd AS (SELECT md5(passage) AS key, any_value(passage) AS passage FROM fx GROUP BY 1), xn AS (SELECT count(*) AS n FROM xd),
xidf AS (SELECT term, ln(((SELECT n FROM xn) + 1.0) / (count(DISTINCT key) + 1.0)) AS idf FROM (SELECT key, unnest({lex('passage')}) AS term FROM xd) GROUP BY term),
{vectors_sql('xq', 'qd', 'xidf', 'xn')}, {vectors_sql('xe', 'xd', 'xidf', 'xn')},
xs AS (SELECT q.doc_id, q.passage_no, k.window_no, round(sum(a.w * b.w), 9) AS score FROM qq q JOIN xq a ON a.key = q.key JOIN kept k ON k.doc_id = q.doc_id JOIN xe b ON b.key = md5(k.passage) AND b.term = a.term GROUP BY 1, 2, 3),
xbest AS (SELECT doc_id, passage_no, arg_max(struct_pack(s := score, w := window_no), struct_pack(a := score, b := -window_no)) AS m FROM xs GROUP BY 1, 2),
joint AS (SELECT b.doc_id, b.passage_no, b.passage, CASE WHEN coalesce(x.m.s > b.score, FALSE) THEN x.m.s ELSE b.score END AS score,
  CASE WHEN coalesce(x.m.s > b.score, FALSE) THEN k.passage ELSE b.matched_text END AS matched_text,
  coalesce(x.m.s > b.score, FALSE) AS from_page FROM best b LEFT JOIN xbest x ON x.doc_id = b.doc_id AND x.passage_no = b.passage_no LEFT JOIN kept k ON k.doc_id = x.doc_id AND k.window_no = x.m.w),
{corroborate_sql('found', 'joint')}, {REPORT_SQL},
probes AS (SELECT doc_id, len(list_filter({sents('text')}, lambda x0: {wc('x0')} >= 9)) AS n FROM documents)"""


@check("external_overlap", f"""WITH RECURSIVE {PRE_SQL}, {CP_BENCH}, {XB}
 SELECT r.doc_id, overall_similarity, top_match, top_match_verified, note, matched_portion, possible_portion, (SELECT count(*) FROM found f WHERE f.doc_id = r.doc_id AND f.verified AND f.from_page) AS verified_from_pages,
 (SELECT count(*) FROM ext e WHERE e.doc_id = r.doc_id) AS n_pages,
 CASE WHEN p.n = 0 THEN 'too_short' WHEN NOT EXISTS (SELECT 1 FROM ext e WHERE e.doc_id = r.doc_id) THEN 'no_candidates' ELSE 'ok' END AS check_status
 FROM rep r JOIN probes p ON p.doc_id = r.doc_id""")
def _(spark, sf):
    stored = benchmark_docs(spark, sf).withColumn("tag", F.lit("b"))
    out = P.external_overlap(docs(spark, sf), external_docs(spark, sf), stored)
    return out.select("doc_id", "overall_similarity", "top_match", "top_match_verified", "note", "matched_portion", "possible_portion", "verified_from_pages", "n_pages", "check_status")


@check("source_counts", f"WITH {PAGE_SQL} SELECT kind, count(*) AS pages FROM ext GROUP BY kind")
def _(spark, sf):
    return E.source_counts(external_docs(spark, sf))


# --- supplied vectors ---------------------------------------------------------------

VEC_SQL = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"""


@check("vector_cosine_topk", f"""WITH {VEC_SQL}, s AS (SELECT a.vec_id, b.vec_id AS match_id, round(list_dot_product(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id)
 SELECT vec_id, match_id, score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, match_id) AS rn FROM s) WHERE rn <= 3""")
def _(spark, sf):
    v = read_table(spark, sf, "embeddings")
    return D.vector_cosine_topk(v, v, k=3).select("vec_id", "match_id", "score", "rank")


@check("embedding_separation", f"""WITH {VEC_SQL}, s AS (SELECT a.vec_id, a.label, round(list_dot_product(a.e, b.e), 9) AS score, b.label AS other, b.vec_id AS match_id FROM v a JOIN v b ON a.vec_id <> b.vec_id),
 t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, match_id) = 1),
 c AS (SELECT 'label ' || CAST(label AS VARCHAR) AS model, CASE WHEN label = other THEN 'copy' ELSE 'clean' END AS category, score FROM t)
 SELECT model, round(min(score) FILTER (category = 'copy'), 6) AS weakest_copy, round(max(score) FILTER (category = 'clean'), 6) AS strongest_clean,
 round(min(score) FILTER (category = 'copy') - max(score) FILTER (category = 'clean'), 6) AS margin, round(avg(CASE WHEN score >= 0.45 THEN 1.0 ELSE 0.0 END), 6) AS share_at_threshold FROM c GROUP BY model""")
def _(spark, sf):
    v = read_table(spark, sf, "embeddings")
    lab = v.select("vec_id", "label")
    near = D.vector_cosine_topk(v, v, k=1).join(lab, "vec_id").join(
        lab.select(F.col("vec_id").alias("match_id"), F.col("label").alias("other")), "match_id"
    )
    s = near.select(
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("model"),
        F.when(F.col("label") == F.col("other"), "copy").otherwise("clean").alias("category"), "score",
    )
    out = D.embedding_separation(s)
    return out.select("model", *[r6(c).alias(c) for c in ("weakest_copy", "strongest_clean", "margin", "share_at_threshold")])


# --- rewriting ----------------------------------------------------------------------

EXC_SQL = """tm AS (SELECT doc_id, passage, row_number() OVER (PARTITION BY doc_id ORDER BY verified DESC, round(score * 100, 1) DESC, passage_no) AS rank, verified FROM found WHERE score >= 0.45),
exc AS (SELECT doc_id, list(passage) AS excerpts FROM tm WHERE verified GROUP BY 1)"""
TOUCH_SQL = f"""{EXC_SQL}, ts AS (SELECT d.doc_id, {sents('d.text')} AS ss, e.excerpts FROM documents d JOIN exc e ON e.doc_id = d.doc_id),
tr AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sent_no, excerpts FROM ts),
touch AS (SELECT doc_id, sent_no, sentence, len(list_filter(excerpts, lambda e0: contains(e0, sentence))) > 0 AS touched FROM tr)"""


@check("touched_sentences", f"{BENCH_FULL}, {TOUCH_SQL} SELECT doc_id, CAST(sent_no AS INT) AS sent_no, touched FROM touch")
def _(spark, sf):
    ex = W.verified_excerpts(bench_matches(spark, sf, 0.45))
    return W.touched_sentences(docs(spark, sf), ex).select("doc_id", "sent_no", "touched")


@check("contiguous_runs", f"""{BENCH_FULL}, {TOUCH_SQL}, g AS (SELECT doc_id, sent_no, sent_no - row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) AS k FROM touch WHERE touched),
 r AS (SELECT doc_id, min(sent_no) AS s, max(sent_no) + 1 AS e FROM g GROUP BY doc_id, k)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) AS INT) AS run_no, CAST(s AS INT) AS start_no, CAST(e AS INT) AS end_no FROM r""")
def _(spark, sf):
    ex = W.verified_excerpts(bench_matches(spark, sf, 0.45))
    return W.contiguous_runs(materialize(W.touched_sentences(docs(spark, sf), ex), "touched"))


@check("targeted_excerpts", f"""{BENCH_FULL}, {EXC_SQL}, x AS (SELECT doc_id, unnest(excerpts) AS p FROM exc)
 SELECT doc_id, string_agg(p, ' # ' ORDER BY -len(p), p) AS targets FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -len(p), p) AS rn FROM x) WHERE rn <= 5 GROUP BY 1""")
def _(spark, sf):
    ex = W.verified_excerpts(bench_matches(spark, sf, 0.45))
    return W.targeted_excerpts(ex).select("doc_id", F.array_join("targets", " # ").alias("targets"))


CANDS = (
    "CASE i WHEN 1 THEN text || ' Honestly.' WHEN 2 THEN replace(replace(text, ' the ', ' q' || chr(122) || 'x '), ' of ', ' vv ') "
    "WHEN 3 THEN 'as an ai I cannot' ELSE substr(text, 1, CAST(floor(length(text) * 0.55) AS INT)) END"
)


@check("select_best_candidate", f"""WITH RECURSIVE c0 AS (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS i, text FROM documents),
 c1 AS (SELECT doc_id, i, text AS original, CASE WHEN i = 0 THEN text ELSE {CANDS} END AS cand FROM c0),
 c2 AS (SELECT doc_id, i, original, CASE WHEN i = 0 THEN cand ELSE {strip('cand')} END AS text FROM c1 WHERE i = 0 OR (i <> 3 AND {strip('cand')} <> '' AND NOT starts_with(lower({strip('cand')}), 'as an ai') AND len({strip('cand')}) / greatest(len(original), 1) BETWEEN 0.5 AND 2.0)),
 cs AS (SELECT doc_id * 10 + i AS doc_id, text FROM c2), {passages_sql('qp0', 'cs', 60, 30)}, qp AS (SELECT *, CAST(doc_id // 10 AS VARCHAR) AS tag, 0 AS seq FROM qp0), {CP_BENCH}, {overlap_sql('qp', 'cp', 0)}, {REPORT_SQL},
 sc AS (SELECT c2.doc_id, c2.i, coalesce(r.matched_portion, 0.0) AS mp, coalesce(r.top_match, 0.0) AS tp FROM c2 LEFT JOIN rep r ON r.doc_id = c2.doc_id * 10 + c2.i),
 bs AS (SELECT doc_id, arg_min(struct_pack(i := i, mp := mp), struct_pack(a := mp, b := tp, c := i)) AS b, max(mp) FILTER (i = 0) AS o, count(*) - 1 AS tried FROM sc GROUP BY 1)
 SELECT doc_id, tried AS candidates_tried, o AS before, CASE WHEN b.mp < o THEN b.mp ELSE o END AS after, b.mp < o AS improved, CASE WHEN b.mp < o THEN b.i ELSE 0 END AS candidate_no FROM bs""")
def _(spark, sf):
    d = docs(spark, sf)
    c = d.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(4)))).select(
        "doc_id", F.col("i").alias("candidate_no"), F.lit("supplied").alias("source"), F.expr(CANDS).alias("text")
    )
    stored = benchmark_docs(spark, sf).withColumn("tag", F.lit("b"))
    return P.select_best_candidate(d.select("doc_id", "text"), c, stored).select(
        "doc_id", "candidates_tried", "before", "after", "improved", "candidate_no"
    )


@check("reduce_overlap")
def _(spark, sf):
    stored = benchmark_docs(spark, sf).withColumn("tag", F.lit("b"))
    return P.reduce_overlap(docs(spark, sf).select("doc_id", "text"), stored).drop("rewritten_text")


@check("rewrite_by_rules")
def _(spark, sf):
    marked = docs(spark, sf).withColumn(
        "text", F.concat(F.lit("Furthermore, it is important to note that we are here to utilize "), "text")
    )
    return P.rewrite_by_rules(marked).select("doc_id", F.md5("rewritten").alias("rewritten_md5"), "changed")


CLAUSE = "CASE WHEN sent_no % 3 = 0 THEN 'When ' || t || ', it works.' WHEN sent_no % 3 = 1 THEN t || ', because it works' ELSE 'As well as that, ' || t END"
UP = lambda x: f"CASE WHEN substr({x}, 1, 1) = 'ß' THEN 'SS' ELSE upper(substr({x}, 1, 1)) END || substr({x}, 2)"
LOW = lambda x: f"lower(substr({x}, 1, 1)) || substr({x}, 2)"
FRONT = lambda i: f"regexp_extract(t, {q(W.R.FRONT_CLAUSE)}, {i})"
MID = lambda i: f"regexp_extract(t, {q(W.R.MID_CLAUSE)}, {i})"


@check("clause_swap", f"""WITH s0 AS (SELECT doc_id, {sents('text')} AS ss FROM documents), s1 AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS sent_no, translate(unnest(ss), '.!?', '') AS t FROM s0),
 s2 AS (SELECT doc_id, sent_no, {strip(CLAUSE)} AS t FROM s1),
 s3 AS (SELECT *, {FRONT(1)} AS f1, {strip(FRONT(2))} AS f2, {strip(FRONT(3))} AS f3, {FRONT(4)} AS f4, rtrim({MID(1)}, '. ') AS m1, {MID(2)} AS m2, {MID(3)} AS m4, rtrim({MID(3)}, '. ') AS m3 FROM s2)
 SELECT doc_id, CAST(sent_no AS INT) AS sent_no, CASE WHEN f1 <> '' AND f2 <> '' AND f3 <> '' AND NOT (lower(f1) = 'as' AND starts_with(lower(f2), 'well'))
  THEN {UP('f3')} || ', ' || lower(f1) || ' ' || {LOW('f2')} || CASE WHEN f4 = '' THEN '.' ELSE f4 END
  WHEN m2 <> '' AND m1 <> '' AND m3 <> '' AND NOT (lower(m2) = 'as' AND starts_with(lower({strip('m4')}), 'well')) THEN {UP('m3')} || ', ' || m2 || ' ' || {LOW('m1')} || '.' ELSE t END AS swapped FROM s3""")
def _(spark, sf):
    """Sentences with a clause in front, with one behind a connector, and with an idiom that stays."""
    s = G.explode_sentences(docs(spark, sf)).withColumn("t", F.translate("sentence", ".!?", ""))
    return s.select("doc_id", "sent_no", W.clause_swap(F.expr(CLAUSE)).alias("swapped"))


# --- ingestion ----------------------------------------------------------------------

# Weights of every passage under the counts before its document (seq is doc_id).
ARRIVAL_SQL = f"""{passages_sql('qp', 'documents', 60, 30)}, {passages_sql('cp', 'documents', 60, 60)},
ent AS (SELECT md5(passage) AS key, min(doc_id) AS seq, min(doc_id * 2147483648 + passage_no) AS chunk_id, any_value(passage) AS passage FROM cp GROUP BY 1),
ask AS (SELECT DISTINCT md5(passage) AS key, doc_id AS seq, passage FROM qp),
et AS (SELECT key, seq, term, count(*) AS tf FROM (SELECT key, seq, unnest({lex('passage')}) AS term FROM ent) GROUP BY ALL),
qt AS (SELECT key, seq, term, count(*) AS tf FROM (SELECT key, seq, unnest({lex('passage')}) AS term FROM ask) GROUP BY ALL),
dfs AS (SELECT term, seq, sum(count(*)) OVER (PARTITION BY term ORDER BY seq) AS df FROM et GROUP BY 1, 2),
ns AS (SELECT 0 AS k, seq, sum(count(*)) OVER (ORDER BY seq) AS n FROM ent GROUP BY 2),
ev AS (SELECT x.key, x.seq, x.term, x.tf, coalesce(d.df, 0) AS df FROM et x ASOF LEFT JOIN dfs d ON d.term = x.term AND x.seq > d.seq),
qv AS (SELECT x.key, x.seq, x.term, x.tf, coalesce(d.df, 0) AS df FROM qt x ASOF LEFT JOIN dfs d ON d.term = x.term AND x.seq > d.seq),
ew AS (SELECT e.key, e.seq, e.term, e.tf * (1 + ln((coalesce(n.n, 0) + 1.0) / (e.df + 1.0))) AS raw FROM (SELECT *, 0 AS k FROM ev) e ASOF LEFT JOIN ns n ON n.k = e.k AND e.seq > n.seq),
qw AS (SELECT e.key, e.seq, e.term, e.tf * (1 + ln((coalesce(n.n, 0) + 1.0) / (e.df + 1.0))) AS raw FROM (SELECT *, 0 AS k FROM qv) e ASOF LEFT JOIN ns n ON n.k = e.k AND e.seq > n.seq),
eu AS (SELECT key, seq, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)) AS w FROM ew),
qu AS (SELECT key, seq, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY key, seq)) AS w FROM qw),
sim AS (SELECT a.key, a.seq, b.key AS ckey, round(sum(a.w * b.w), 9) AS score FROM qu a JOIN eu b ON a.term = b.term AND b.seq < a.seq GROUP BY 1, 2, 3),
top AS (SELECT s.key, s.seq, arg_max(struct_pack(score := s.score, chunk_id := e.chunk_id, passage := e.passage), struct_pack(a := s.score, b := -e.chunk_id)) AS m FROM sim s JOIN ent e ON e.key = s.ckey WHERE s.score > 0 GROUP BY 1, 2),
best AS (SELECT q.doc_id, q.passage_no, q.passage, coalesce(t.m.score, 0.0) AS score, t.m.chunk_id AS chunk_id, t.m.passage AS matched_text
  FROM qp q LEFT JOIN top t ON t.key = md5(q.passage) AND t.seq = q.doc_id)"""


@check("ingest_compare_then_store", f"WITH RECURSIVE {ARRIVAL_SQL}, {corroborate_sql('found', 'best')}, {REPORT_SQL} SELECT {REPORT_COLS} FROM rep")
def _(spark, sf):
    """Documents in three arrivals; the SQL knows none of their borders."""
    base = scratch_dir(spark, "ingest")
    src = read_table(spark, sf, "documents").select("doc_id", "text", F.col("doc_id").alias("seq"))
    edges = src.select(F.percentile_approx("seq", F.array(F.lit(0.2), F.lit(0.6)))).first()[0]
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = src if low is None else src.filter(F.col("seq") > low)
        (part if high is None else part.filter(F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    I.ingest_compare_then_store(stream, f"{base}/corpus", f"{base}/reports", f"{base}/ck").awaitTermination()
    return spark.read.parquet(f"{base}/reports").select(*REPORT_COLS.split(", "))
