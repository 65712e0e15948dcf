"""One small test for each mended finding of round 3."""

from pyspark.sql import functions as F


def test_report_percent_has_no_thousands_separator(spark):
    from inkstone.plans.records import report_rows, result_struct

    raw = '{"similarity": {"overall_similarity": 1209.5}, "heuristic": {"ai_likelihood_score": 51.25}}'
    h = spark.createDataFrame([(1, "f", "t", raw)], "id long, file_name string, created_at string, raw string")
    rows = report_rows(h.withColumn("result", result_struct(F.col("raw")))).collect()
    values = {r["label"]: r["value"] for r in rows}
    assert values["Overall similarity"] == "1209.5%"
    assert values["Local heuristic (writing-pattern signals)"] == "51.2%"


def test_table_total_is_exact_in_any_order(spark):
    from inkstone.plans.summaries import table_insights

    # in doubles each small value is lost where it meets the large one
    values = ["9007199254740.91"] + [f"0.{600 + i:06d}" for i in range(280)]
    cells = spark.createDataFrame([(i, 0, "a", v) for i, v in enumerate(values)], "row_no long, pos int, column string, value string")
    said = [r["insight"] for r in table_insights(cells, [], limit=None).orderBy("insight_no").collect()]
    assert said[1].startswith('"a": Total = 9,007,199,254,741.12 | ')
    many = spark.createDataFrame([(i, 0, "a", str(0.1 + i)) for i in range(10)] + [(10, 0, "a", "1e300")], cells.schema)
    assert "Total = 1,000,000,000" in [r["insight"] for r in table_insights(many, [], limit=None).orderBy("insight_no").collect()][1]


def _shuffled_records(spark):
    jvm = spark.sparkContext._gateway
    empty = jvm.jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(empty(), False, False, jvm.new_array(jvm.jvm.double, 0), empty())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _plain_surprise(texts, fit, folds):
    """{(id, sentence): (nll, n)} by counting in plain Python."""
    import math
    import re
    from collections import Counter

    uni, bi, out = {}, {}, {}
    cut = {i: [(s, w) for s, part in enumerate(re.split(r"(?<=[.!?])\s+", t)) for w in re.findall(r"[a-z]+", part.lower())] for i, t in texts.items()}
    for i, toks in cut.items():
        u, b = uni.setdefault(fit[i], Counter()), bi.setdefault(fit[i], Counter())
        u.update(w for _, w in toks)
        b.update((x[1], y[1]) for x, y in zip(toks, toks[1:], strict=False))
    for i, toks in cut.items():
        u, b = uni.get(folds[i], Counter()), bi.get(folds[i], Counter())
        size = sum(u.values()) + len(u)
        for (_, x), (s, y) in zip(toks, toks[1:], strict=False):
            p = b[x, y] / u[x] if u[x] else 0.0
            nll, n = out.get((i, s), (0.0, 0))
            out[i, s] = (nll - math.log(0.7 * p + 0.3 * (u[y] + 1.0) / size), n + 1)
    return out


def test_surprise_shuffles_no_single_occurrence_and_equals_a_plain_count(spark):
    from inkstone.operators import lm as M

    texts = {i: f"the cat sat on mat{'abc'[i % 3]}. it saw the dog there. " * 40 for i in range(30)}
    rows = [(i, t) for i, t in texts.items()] + [(100, None), (101, ""), (102, "one")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fold = F.pmod(F.col("doc_id"), F.lit(2)).cast("int")
    want = _plain_surprise({i: t.strip() for i, t in texts.items()} | {102: "one"}, {i: 1 - i % 2 for i, _ in rows}, {i: i % 2 for i, _ in rows})
    before = _shuffled_records(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = M.sentence_surprise(d, ["doc_id"], M.ngram_lm_fit(d, fold=1 - fold), fold=fold).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert _shuffled_records(spark) - before < sum(n for _, n in want.values()) / 4
    assert {(r["doc_id"], r["sent_no"]) for r in got} == set(want)
    assert all(abs(r["nll"] - want[r["doc_id"], r["sent_no"]][0]) < 1e-9 and r["n"] == want[r["doc_id"], r["sent_no"]][1] for r in got)
    # the same with the model given as a table, and with one counted on other rows of the same texts
    lm = M.ngram_lm_fit(d, fold=1 - fold)
    for model in (lm._replace(fitted=None), M.ngram_lm_fit(d.select("*"), fold=1 - fold)):
        again = M.sentence_surprise(d, ["doc_id"], model, fold=fold).collect()
        assert {(r["doc_id"], r["sent_no"]): round(r["nll"], 9) for r in again} == {(r["doc_id"], r["sent_no"]): round(r["nll"], 9) for r in got}


def test_bands_are_numbers(spark):
    from unittest import mock

    from inkstone.plans import scoring as P

    d = spark.createDataFrame([(i, f"The quick brown fox number {i} jumps over lazy dogs. " * 12) for i in range(8)], "doc_id long, text string")
    with mock.patch.object(P, "score_chunks", wraps=P.score_chunks) as seen:
        out = P.score_documents(d)
    assert "subquery" not in out._jdf.queryExecution().toString().lower() and seen.called
    assert out.count() == 8


def test_small_corpus_is_searched_without_a_shuffle_and_equals_the_general_search(spark):
    import random
    from unittest import mock

    from inkstone.operators import overlap as O
    from inkstone.operators import small_corpus as S

    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(words, k=12))
    stored = [text() for _ in range(40)]
    stored += [" ".join(reversed(stored[0].split())), stored[1], stored[2], "all all all"]
    corpus = spark.createDataFrame([(100 - i, t, f"t{i % 5}", i % 7) for i, t in enumerate(stored)], "chunk_id long, passage string, tag string, seq long")
    asked = [text() for _ in range(60)] + stored[:6] + ["", "nothing known here", "w1"]
    queries = spark.createDataFrame(
        [(i, 0, t, f"t{i % 6}", i % 8) for i, t in enumerate(asked)], "doc_id long, passage_no int, passage string, tag string, seq long"
    ).repartition(3)
    for floor, own, early in ((0.0, False, False), (0.3, True, False), (0.0, False, True), (0.0, True, True)):
        before = _shuffled_records(spark)
        found = O.best_match_per_passage(queries, corpus, floor, own, early).collect()
        assert floor or _shuffled_records(spark) - before < 4 * len(stored) * 15
        with mock.patch.object(S, "SMALL_CORPUS_CHARS", -1):
            general = O.best_match_per_passage(queries, corpus, floor, own, early).collect()
        assert sorted(map(str, found)) == sorted(map(str, general)) and len(found) == len(asked)
    pairs = sorted(map(str, O.similar_pairs(queries, corpus, 0.2).collect()))
    with mock.patch.object(S, "SMALL_CORPUS_CHARS", -1):
        assert pairs == sorted(map(str, O.similar_pairs(queries, corpus, 0.2).collect())) and len(pairs) > 100
    none = O.best_match_per_passage(queries, corpus.limit(0)).collect()
    assert len(none) == len(asked) and all(r["score"] == 0 and r["chunk_id"] is None for r in none)


def test_gram_counts_leave_a_task_some_texts_at_a_time():
    from collections import Counter

    import numpy as np
    import pandas as pd

    from inkstone.llm import language_id as L
    from inkstone.llm.grams import hashed_grams

    texts = [f"Ein kurzer Text {i} und noch ein Text" for i in range(53)] + ["x", "\u00e9\u00e9 " * 9]
    frame = pd.DataFrame({"lang": ["de"] * len(texts), "place": range(len(texts)), "text": texts})
    out = list(L._gram_counts(iter([frame])))
    assert len(out) > 1 and max(map(len, out)) <= L.COUNTED_AT_ONCE
    rows = [r for f in out for r in f.itertuples()]
    assert [r.place for r in rows] == list(range(len(texts)))
    for r, text in zip(rows, texts, strict=True):
        want = Counter(b for w in text.lower().split() for b in hashed_grams([w], L.LOW, L.HIGH, L.BITS)[0].tolist())
        assert dict(zip(np.frombuffer(r.buckets, "<i4").tolist(), np.frombuffer(r.counts, "<i4").tolist(), strict=True)) == want


def test_nearest_vectors_meet_without_rows_of_many_vectors(spark):
    from unittest import mock

    import numpy as np

    from inkstone.operators import dense as D

    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[40:70] = m[40]  # copies: ties go to the smaller id
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = spark.createDataFrame([(i * 7 % 300, m[i * 7 % 300].tolist()) for i in range(300)], "vec_id long, embedding array<float>").repartition(5)
    s = np.round(m.astype(np.float64) @ m.T.astype(np.float64), D.DIGITS)
    np.fill_diagonal(s, -np.inf)
    want = {(i, r + 1): (j, s[i, j]) for i in range(300) for r, j in enumerate(np.lexsort((np.arange(300), -s[i]))[:3].tolist())}
    with mock.patch.object(D, "SCORES_AT_ONCE", 100), mock.patch.object(D, "TARGETS_AT_ONCE", 50):
        near = D.vector_cosine_topk(v, v, k=3, cells=6, block_rows=16)
        assert "collect_list" not in near._jdf.queryExecution().toString()
        got = {(r["vec_id"], r["rank"]): (r["match_id"], r["score"]) for r in near.collect()}
    assert got == want
    few = D.vector_cosine_topk(v.filter("vec_id < 2"), v.filter("vec_id < 3"), k=5).collect()
    assert sorted((r["vec_id"], r["match_id"]) for r in few) == [(0, 1), (0, 2), (1, 0), (1, 2)]


def test_sentences_are_scored_in_their_row(spark):
    from inkstone.operators import summary as S

    a = "Profit margin profit grew again this year. The gross profit of the firm fell. Revenue and the Profit margin rose for nine whole quarters here."
    d = spark.createDataFrame([(1, a), (2, None), (3, ""), (None, a), (4, "A B. C d e f g h i j k l m n o p q r."), (5, "Nothing but words in the only sentence.")], "doc_id long, text string")
    before = _shuffled_records(spark)
    rows = {(r["doc_id"], r["pos"]): (r["sentence"], r["score"]) for r in S.sentence_scores(d).collect()}
    assert _shuffled_records(spark) == before
    assert set(rows) == {(1, 0), (1, 1), (1, 2), (5, 0)} and rows[5, 0][0] == "Nothing but words in the only sentence."
    from collections import Counter

    from inkstone.functions import lexicon as L

    words = lambda t: [w for w in __import__("re").findall(r"\b[a-z]{3,}\b", t.lower()) if w not in set(L.STOPWORDS)]
    n, kind = Counter(words(a)), spark.createDataFrame([(a,)], "t string")
    from inkstone.functions import values as V

    focus = set(kind.select(V.focus_words(V.doc_type(F.col("t")))).first()[0])
    for pos in range(3):
        w = words(rows[1, pos][0])
        tf = sum(n[x] / max(n.values()) for x in w) / len(w)
        want = (tf + (0.2 if pos in (0, 2) else 0.0) + 0.15 * sum(x in focus for x in w) / len(w)) * min(len(w) / 10, 1)
        assert abs(rows[1, pos][1] - want) < 1e-12


def test_a_text_is_folded_once_for_all_its_quotes(spark):
    import __spark_entry__ as entry
    from inkstone.functions import values as V

    d = spark.createDataFrame([("A  b\nC. x", ["a b", " ", "b c. X", "zq", None]), (None, ["a"])], "t string, q array<string>")
    got = [r[0] for r in d.select(V.quotes_grounded(F.col("t"), F.col("q"))).collect()]
    assert got == [[True, False, True, False, None], [None]]
    plan = entry.queries()["grounded_quotes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.index("generate") < plan.index("contains(")  # judged before the sentences become rows


def test_rules_are_looked_for_at_word_borders_only(spark):
    import re

    from inkstone.functions import rewording as R
    from inkstone.operators import rewrite as W

    for rules in (R.REPLACEMENTS, R.CONTRACTIONS):
        patterns = [p for p, _ in rules]
        one = W.any_of(patterns)
        assert one.count(r"\b") == 1 + sum(p.count(r"\b") - 1 for p in patterns) and one.startswith(r"\b(?:")
        said = [re.sub(r"\\b|[()?:]", "", p).split("|")[0] for p in patterns]
        rows = [(x,) for w in said for x in (w, w.upper(), f"so {w}, then", f"re{w}", f"{w}x", f"é{w}", w[1:], "")] + [(None,)]
        d = spark.createDataFrame(rows, "s string")
        found = d.select("s", F.col("s").rlike("|".join(patterns)).alias("a"), F.col("s").rlike(one).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in found) and {r["a"] for r in found} == {True, False, None}
    # a list that begins otherwise, or has a choice outside groups, stays as it is
    assert W.any_of([r"\ba", "b"]) == r"\ba|b" and W.any_of([r"\ba|b"]) == r"\ba|b"


def test_small_corpus_opens_common_terms_to_a_table(spark):
    from unittest import mock

    import numpy as np
    import pyarrow as pa

    from inkstone.operators import small_corpus as S

    rng = np.random.default_rng(3)
    n, terms = 7, 40
    dense = np.where(rng.random((terms, n)) < np.linspace(0.1, 0.9, terms)[:, None], rng.random((terms, n)), 0.0)
    t, c = np.nonzero(dense)
    corpus = {"ids": np.arange(terms, dtype=np.uint64) * 3, "idf": rng.random(terms) + 0.1, "n": n, "starts": np.searchsorted(t, np.arange(terms + 1)), "c": c, "w": dense[t, c]}
    words = pa.array([[int(x) for x in rng.integers(0, 3 * terms, size=k)] for k in (0, 1, 30, 5, 80)], pa.list_(pa.int64()))
    want = np.zeros((5, n))
    row, term, w = S._weighed(words, corpus)
    for i, k, x in zip(row, term, w, strict=True):
        want[i] += x * dense[k]
    for entries in (0, 10 * n, 1000 * n):  # no table, some of the terms, all of them
        with mock.patch.object(S, "TABLE", entries), mock.patch.object(S, "AT_ONCE", 60):
            known = S.opened(corpus)
            got = {a + i: r for a, sums in S._scores(words, known) for i, r in enumerate(sums)}
        assert len(known["table"]) == min(entries // n, int((dense > 0).any(axis=1).sum()))
        assert sorted(got) == list(range(5)) and all(np.allclose(got[i], want[i], atol=1e-12) for i in got)


def test_two_model_ratio_shuffles_no_single_occurrence_and_equals_a_plain_count(spark):
    import math
    import re
    from collections import Counter

    from inkstone.operators import lm as M

    texts = {i: f"the cat sat on mat{'abc'[i % 3]}. it saw the dog there. " * 40 for i in range(30)}
    rows = [*texts.items(), (None, "the cat saw it. new words here."), (100, None), (101, ""), (102, "one")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    even, odd = (M.ngram_lm_fit(d.filter(F.col("doc_id") % 2 == i)) for i in (0, 1))
    cut = {i: re.findall(r"[a-z]+", t or "") for i, t in rows}
    uni, bi, per = Counter(), Counter(), Counter()
    for i, toks in cut.items():
        if i is not None:
            (bi if i % 2 == 0 else per).update(zip(toks, toks[1:], strict=False))
            uni.update(toks if i % 2 == 0 else [])
    size = sum(uni.values()) + len(uni)
    nll = lambda x, y: -math.log(0.7 * (bi[x, y] / uni[x] if uni[x] else 0.0) + 0.3 * (uni[y] + 1.0) / size)
    ctx, h = Counter(), Counter()
    for (x, _), n in per.items():
        ctx[x] += n
    for (x, y), n in per.items():
        h[x] += n / ctx[x] * nll(x, y)
    before = _shuffled_records(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r for r in M.two_model_ratio(d, ["doc_id"], even, odd).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    pairs = {i: list(zip(t, t[1:], strict=False)) for i, t in cut.items() if len(t) > 1}
    assert _shuffled_records(spark) - before < sum(map(len, pairs.values())) / 4
    assert set(got) == set(pairs)
    for i, some in pairs.items():
        known = [h[x] for x, _ in some if x in ctx]
        lp, ce = sum(nll(x, y) for x, y in some) / len(some), sum(known) / len(known)
        r = got[i]
        assert r["n_words"] == len(some) and all(abs(r[c] - v) < 1e-9 for c, v in (("log_perplexity", lp), ("cross_entropy", ce), ("ratio", lp / ce)))


def test_page_filter_shuffles_no_tokens(spark):
    from inkstone.operators.external import external_prefilter

    long = lambda seed, n: " ".join(" ".join(f"w{(seed * 31 + k * 7 + j * j) % 400}" for j in range(11)) + f" x{k}." for k in range(n))
    docs = spark.createDataFrame([(i, long(i, 200)) for i in range(12)], "doc_id long, text string")
    pages = spark.createDataFrame([(i, "arxiv", "t", "u", long(i + 1, 60) + " " + long(i, 60)) for i in range(12)], "doc_id long, kind string, title string, url string, text string")
    before = _shuffled_records(spark)
    got = external_prefilter(docs, pages).collect()
    assert len(got) > 12 and max(r["word_share"] for r in got) > 0.9
    assert _shuffled_records(spark) - before < 5 * 12 * 220
