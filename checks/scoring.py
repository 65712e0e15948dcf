"""Language model, signals, document scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import lexicon as L
from inkstone.functions import scores as B
from inkstone.functions import text as T
from inkstone.operators import lm as M
from inkstone.operators import scoring as R
from inkstone.operators import segment as G
from inkstone.plans import scoring as P
from inkstone.sources.readers import read_table

from .kit import check, docs, q, r6, sents, strip, wc
from .texts import ALPHA, BLOCK_SQL, FLAT, GATE_SQL, MIXED_SRC, RUN_SQL, TOK_SQL, mixed_source

TXT = lambda: F.col("text")
FOLD = lambda: F.pmod(F.col("doc_id"), F.lit(2)).cast("int")
MODEL_TOK = lambda x: rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}'']+')"

# Bigrams of every document, with the sentence they end in.
BI_SQL = f"""ls AS (SELECT doc_id, {sents('text')} AS ss FROM documents),
l1 AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sent_no FROM ls),
l2 AS (SELECT doc_id, sent_no, {wc('sentence')} AS n_words, {MODEL_TOK('sentence')} AS tk FROM l1),
l3 AS (SELECT doc_id, sent_no, n_words, unnest(tk) AS term, generate_subscripts(tk, 1) AS i FROM l2),
l4 AS (SELECT *, lag(term) OVER o AS prev, lag(sent_no) OVER o AS psent FROM l3 WINDOW o AS (PARTITION BY doc_id ORDER BY sent_no, i)),
bg AS (SELECT doc_id, doc_id % 2 AS fold, sent_no, n_words, prev, term, psent <> sent_no AS crosses FROM l4 WHERE prev IS NOT NULL),
uni AS (SELECT 1 - doc_id % 2 AS fold, term, count(*) AS n FROM l3 GROUP BY 1, 2),
bi AS (SELECT 1 - fold AS fold, prev, term, count(*) AS n FROM bg GROUP BY 1, 2, 3),
tot AS (SELECT fold, sum(n) AS tokens, count(*) AS vocab FROM uni GROUP BY 1),
nl AS (SELECT b.*, -ln(0.7 * coalesce(p.n / c.n, 0.0) + 0.3 * (coalesce(u.n, 0) + 1.0) / (t.tokens + t.vocab)) AS nll FROM bg b
  LEFT JOIN bi p ON p.fold = b.fold AND p.prev = b.prev AND p.term = b.term LEFT JOIN uni u ON u.fold = b.fold AND u.term = b.term
  LEFT JOIN uni c ON c.fold = b.fold AND c.term = b.prev JOIN tot t ON t.fold = b.fold),
sp AS (SELECT doc_id, sent_no, round(exp(avg(nll)), 2) AS perplexity FROM nl WHERE NOT crosses AND n_words >= 3 GROUP BY 1, 2)"""


def _surprise(spark, sf):
    d = docs(spark, sf)
    return M.sentence_surprise(d, ["doc_id"], M.ngram_lm_fit(d, fold=1 - FOLD()), fold=FOLD())


@check("ngram_lm_fit", f"WITH {BI_SQL} SELECT CAST(fold AS INT) AS fold, prev, term, n FROM bi")
def _(spark, sf):
    return M.ngram_lm_fit(docs(spark, sf), fold=1 - FOLD()).bi


@check("ngram_lm_unigrams", f"WITH {BI_SQL} SELECT CAST(fold AS INT) AS fold, term, n FROM uni")
def _(spark, sf):
    return M.ngram_lm_fit(docs(spark, sf), fold=1 - FOLD()).uni


@check("perplexity", f"WITH {BI_SQL} SELECT doc_id, round(ln(exp(avg(nll))), 6) AS log_perplexity FROM nl GROUP BY 1")
def _(spark, sf):
    return M.perplexity(_surprise(spark, sf), ["doc_id"]).select("doc_id", r6(F.log("perplexity")).alias("log_perplexity"))


@check("sentence_perplexity", f"WITH {BI_SQL} SELECT doc_id, CAST(sent_no AS INT) AS sent_no, perplexity FROM sp")
def _(spark, sf):
    return M.sentence_perplexity(_surprise(spark, sf), ["doc_id"])


@check("burstiness_mad", f"WITH {BI_SQL} SELECT doc_id, round(CASE WHEN count(*) >= 2 THEN mad(perplexity) END, 6) AS burstiness, count(*) AS sentences FROM sp GROUP BY 1")
def _(spark, sf):
    out = M.burstiness_mad(M.sentence_perplexity(_surprise(spark, sf), ["doc_id"]), ["doc_id"])
    return out.select("doc_id", r6("burstiness").alias("burstiness"), "sentences")


@check("calibrate_band", f"WITH {BI_SQL} SELECT round(quantile_cont(perplexity, 0.1), 6) AS low, round(quantile_cont(perplexity, 0.9), 6) AS high FROM sp")
def _(spark, sf):
    b = M.calibrate_band(M.sentence_perplexity(_surprise(spark, sf), ["doc_id"]), "perplexity")
    return b.select(r6("low").alias("low"), r6("high").alias("high"))


@check("lowest_perplexity_half", f"""WITH {BI_SQL}, j AS (SELECT l.doc_id, l.sent_no, coalesce(s.perplexity, 'Infinity'::DOUBLE) AS p FROM l1 l LEFT JOIN sp s ON s.doc_id = l.doc_id AND s.sent_no = l.sent_no)
 SELECT doc_id, CAST(sent_no AS INT) AS sent_no, row_number() OVER (PARTITION BY doc_id ORDER BY p, sent_no) <= greatest(1, floor(count(*) OVER (PARTITION BY doc_id) / 2)) AS chosen FROM j""")
def _(spark, sf):
    from inkstone.operators.rewrite import lowest_perplexity_half

    s = G.explode_sentences(docs(spark, sf)).join(M.sentence_perplexity(_surprise(spark, sf), ["doc_id"]), ["doc_id", "sent_no"], "left")
    return lowest_perplexity_half(s).select("doc_id", "sent_no", "chosen")


@check("sentence_perplexity_lookup", f"""WITH {BI_SQL} SELECT l.doc_id, count(*) AS sentences, count(s.perplexity) AS scored, round(min(s.perplexity), 6) AS lowest FROM l1 l LEFT JOIN sp s ON s.doc_id = l.doc_id AND s.sent_no = l.sent_no GROUP BY 1""")
def _(spark, sf):
    s = G.explode_sentences(docs(spark, sf)).join(M.sentence_perplexity(_surprise(spark, sf), ["doc_id"]), ["doc_id", "sent_no"], "left")
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count("perplexity").alias("scored"), r6(F.min("perplexity")).alias("lowest"))


@check("two_model_ratio", f"""WITH {BI_SQL}, obs AS (SELECT prev, term, count(*) AS n FROM bg WHERE fold = 0 GROUP BY 1, 2), ouni AS (SELECT term, count(*) AS n FROM l3 WHERE doc_id % 2 = 0 GROUP BY 1), ot AS (SELECT sum(n) AS tokens, count(*) AS vocab FROM ouni),
 per AS (SELECT prev, term, count(*) AS n FROM bg WHERE fold = 1 GROUP BY 1, 2), pc AS (SELECT prev, sum(n) AS n FROM per GROUP BY 1),
 pr AS (SELECT DISTINCT prev, term FROM bg),
 s1 AS (SELECT r.prev, r.term, -ln(0.7 * coalesce(o.n / c.n, 0.0) + 0.3 * (coalesce(u.n, 0) + 1.0) / (t.tokens + t.vocab)) AS nll FROM pr r LEFT JOIN obs o ON o.prev = r.prev AND o.term = r.term
   LEFT JOIN ouni u ON u.term = r.term LEFT JOIN ouni c ON c.term = r.prev, ot t),
 h AS (SELECT p.prev, sum(p.n / pc.n * s1.nll) AS h FROM per p JOIN pc ON pc.prev = p.prev JOIN s1 ON s1.prev = p.prev AND s1.term = p.term GROUP BY 1)
, t2 AS (SELECT b.doc_id, avg(s1.nll) AS lp, avg(h.h) AS ce, avg(s1.nll) / nullif(avg(h.h), 0) AS q, count(*) AS n FROM bg b JOIN s1 ON s1.prev = b.prev AND s1.term = b.term LEFT JOIN h ON h.prev = b.prev GROUP BY 1)
 SELECT doc_id, round(lp, 6) AS log_perplexity, round(ce, 6) AS cross_entropy, round(q, 6) AS ratio,
  round(CASE WHEN q IS NULL THEN 50.0 WHEN q <= 0.92 THEN least(100.0, 75.0 + (0.92 - q) / 0.92 * 200.0) WHEN q >= 0.935 THEN greatest(0.0, 25.0 - (q - 0.935) / 0.935 * 200.0) ELSE 75.0 - (q - 0.92) / 0.015 * 50.0 END, 1) AS score,
  CASE WHEN n < 120 THEN 'low' WHEN least(abs(q - 0.92), abs(q - 0.935)) > 0.12 THEN 'high' WHEN least(abs(q - 0.92), abs(q - 0.935)) > 0.05 THEN 'medium' ELSE 'low' END AS confidence FROM t2""")
def _(spark, sf):
    d = docs(spark, sf)
    one, two = (M.ngram_lm_fit(d.filter(F.col("doc_id") % 2 == i)) for i in (0, 1))
    return M.two_model_ratio(d, ["doc_id"], one, two).select(
        "doc_id", r6("log_perplexity").alias("log_perplexity"), r6("cross_entropy").alias("cross_entropy"), r6("ratio").alias("ratio"), "score", "confidence"
    )


UNIF = f"""ul AS (SELECT doc_id, list_filter(list_transform({sents('text')}, lambda x0: {wc('x0')}), lambda x1: x1 >= 3) AS a FROM documents),
un AS (SELECT doc_id, CASE WHEN len(a) < 2 THEN 0.5 ELSE greatest(0.0, least(1.0, 1.0 - list_stddev_pop(a) / (list_avg(a) + 1e-8) / 0.5)) END AS u FROM ul)"""
COMMON = ["the", "and", "of", "in the", "of the", "furthermore", "it is important to note"]
MARK = lambda keys: (
    rf"mw AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x0: regexp_full_match(x0, '[a-z]+')), lambda x1: x1) AS w FROM documents), "
    "mt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM mw), "
    "mg AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM mt), "
    f"mk AS (SELECT doc_id, least(1.0, (count(*) FILTER (list_contains({keys}, t)) + count(*) FILTER (list_contains({keys}, t || ' ' || nx))) / any_value(n) * 30) AS m FROM mg GROUP BY 1)"
)
ARR = lambda v: "[" + ", ".join(q(x) for x in v) + "]"


@check("sentence_uniformity", f"WITH {UNIF} SELECT doc_id, round(u, 6) AS uniformity FROM un")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", r6(B.sentence_uniformity(TXT())).alias("uniformity"))


@check("marker_density", f"WITH {MARK(ARR(COMMON))} SELECT d.doc_id, round(coalesce(m.m, 0.0), 6) AS density FROM documents d LEFT JOIN mk m ON m.doc_id = d.doc_id")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", r6(B.marker_density(TXT(), COMMON)).alias("density"))


@check("ai_signal", f"WITH {BI_SQL} SELECT doc_id, CAST(sent_no AS INT) AS sent_no, round(1.0 - greatest(0.0, least(1.0, (perplexity - 100.0) / 4900.0)), 6) AS signal FROM sp")
def _(spark, sf):
    s = M.sentence_perplexity(_surprise(spark, sf), ["doc_id"])
    return s.select("doc_id", "sent_no", r6(B.ai_signal(F.col("perplexity"), 100.0, 5000.0)).alias("signal"))


@check("ai_likelihood", f"""WITH {UNIF}, {MARK(ARR(COMMON))} SELECT u.doc_id, round(greatest(0.0, least(100.0, (0.45 * u.u + 0.15 * 0.5 + 0.15 * coalesce(m.m, 0.0) + 0.25 * u.u) / 1.0 * 100)), 1) AS score FROM un u LEFT JOIN mk m ON m.doc_id = u.doc_id""")
def _(spark, sf):
    u = B.sentence_uniformity(TXT())
    return docs(spark, sf).select("doc_id", B.ai_likelihood(u, F.lit(0.5), B.marker_density(TXT(), COMMON), u).alias("score"))


CHUNK_SQL = f"""{GATE_SQL}, {BLOCK_SQL('documents')}, {UNIF}, {MARK(ARR(L.MARKERS))}, {BI_SQL},
dp AS (SELECT doc_id, exp(avg(nll)) AS p FROM nl GROUP BY 1), db AS (SELECT doc_id, CASE WHEN count(*) >= 2 THEN mad(perplexity) END AS b FROM sp GROUP BY 1),
me AS (SELECT g.doc_id, g.status, g.word_count AS words, dp.p, db.b, coalesce(m.m, 0.0) AS m, u.u FROM gate g JOIN blk k ON k.doc_id = g.doc_id LEFT JOIN dp ON dp.doc_id = g.doc_id
  LEFT JOIN db ON db.doc_id = g.doc_id LEFT JOIN mk m ON m.doc_id = g.doc_id JOIN un u ON u.doc_id = g.doc_id WHERE k.kind IN ('prose', 'mixed')),
bd AS (SELECT quantile_cont(p, 0.1) AS pl, quantile_cont(p, 0.9) AS ph, quantile_cont(b, 0.1) AS bl, quantile_cont(b, 0.9) AS bh FROM me WHERE status = 'ok'),
sg AS (SELECT me.*, CASE WHEN p IS NULL THEN 0.5 ELSE 1 - greatest(0.0, least(1.0, (p - pl) / (ph - pl))) END AS ps, CASE WHEN b IS NULL THEN 0.5 ELSE 1 - greatest(0.0, least(1.0, (b - bl) / (bh - bl))) END AS bs FROM me, bd),
sc AS (SELECT *, round(greatest(0.0, least(100.0, (0.45 * ps + 0.15 * bs + 0.15 * m + 0.25 * u) * 100)), 1) AS score FROM sg)"""


@check("score_documents", f"""WITH {CHUNK_SQL} SELECT doc_id, CASE WHEN status = 'ok' THEN score END AS score, CASE WHEN status = 'ok' THEN round(ps, 3) END AS perplexity_signal, CASE WHEN status = 'ok' THEN round(u, 3) END AS uniformity_signal,
 CASE WHEN status <> 'ok' THEN NULL WHEN score >= 60 THEN 'likely_ai' WHEN score <= 40 THEN 'likely_human' ELSE 'uncertain' END AS verdict, words FROM sc""")
def _(spark, sf):
    return P.score_documents(docs(spark, sf)).select("doc_id", "score", "perplexity_signal", "uniformity_signal", "verdict", "words")


@check("weighted_score", """WITH c AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber = 4 THEN 'insufficient' ELSE 'ok' END AS status, CAST(l_quantity AS BIGINT) AS words, l_discount * 1000 AS score,
  CASE WHEN l_linenumber <> 2 THEN l_tax * 100 END AS b FROM lineitem)
 SELECT doc_id, round(sum(score * words) FILTER (status = 'ok') / sum(words) FILTER (status = 'ok'), 6) AS score, round(sum(b * words) FILTER (status = 'ok') / sum(words) FILTER (status = 'ok' AND b IS NOT NULL), 6) AS burstiness,
 count(*) FILTER (status = 'ok') AS chunks_analyzed, count(*) FILTER (status <> 'ok') AS chunks_skipped, CAST(coalesce(sum(words) FILTER (status <> 'ok'), 0) AS BIGINT) AS words_skipped FROM c GROUP BY 1""")
def _(spark, sf):
    li = read_table(spark, sf, "lineitem")
    c = li.select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") == 4, "insufficient").otherwise("ok").alias("status"),
        F.col("l_quantity").cast("long").alias("words"), (F.col("l_discount") * 1000).alias("score"),
        F.when(F.col("l_linenumber") != 2, F.col("l_tax") * 100).alias("burstiness"),
        *[F.lit(0.5).alias(x) for x in ("perplexity", "perplexity_signal", "burstiness_signal", "marker_signal", "uniformity_signal")],
    )
    out = R.weighted_score(c, ["doc_id"], digits=6)
    return out.select("doc_id", "score", "burstiness", "chunks_analyzed", "chunks_skipped", "words_skipped")


@check("document_class", f"""WITH {MIXED_SRC}, {BLOCK_SQL('src')}, w AS (SELECT s.doc_id % 1000000000 AS doc_id, b.kind, CASE WHEN b.kind = 'code' THEN len(CASE WHEN s.text = '' THEN [] ELSE string_split(regexp_replace(s.text, '\\n\\z', ''), chr(10)) END) ELSE {wc('s.text')} END AS weight FROM src s JOIN blk b ON b.doc_id = s.doc_id),
 a AS (SELECT doc_id, sum(weight) FILTER (kind <> 'empty') AS t, coalesce(sum(CASE kind WHEN 'code' THEN weight WHEN 'mixed' THEN weight * 0.5 ELSE 0 END), 0) AS c FROM w GROUP BY 1)
 SELECT doc_id, CASE WHEN coalesce(t, 0) = 0 THEN 'PROSE_DOMINANT' WHEN c / t >= 0.7 THEN 'CODE_DOMINANT' WHEN c / t <= 0.3 THEN 'PROSE_DOMINANT' ELSE 'MIXED' END AS document_class FROM a""")
def _(spark, sf):
    from inkstone.functions import quality as Q

    u = mixed_source(spark, sf).select((F.col("doc_id") % 1000000000).alias("doc_id"), "text", Q.classify_block(TXT()).alias("kind"))
    u = u.select("doc_id", "kind", Q.block_weight(TXT(), F.col("kind")).alias("weight"))
    return R.document_class(u, ["doc_id"]).select("doc_id", "document_class")


@check("analyse_documents")
def _(spark, sf):
    return P.analyse_documents(docs(spark, sf).select("doc_id", "text"))
