"""Windows and chunks inside a row against plain loops, and their cost in a very long row."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from inkstone.functions import lexicon as L
from inkstone.functions import text as T
from inkstone.operators import segment as G
from inkstone.operators import overlap as O
from inkstone.plans import overlap as P
from test_overlap import windows


def plain_pack(units, limit):
    out, held = [], 0
    for i, (index, text) in enumerate(units):
        n = len(text.split())
        if not out or index != units[i - 1][0] + 1 or (held > 0 and held + n > limit):
            out.append([])
            held = 0
        out[-1].append((index, text))
        held += n
    return [(k, "\n\n".join(t for _, t in c), [i for i, _ in c]) for k, c in enumerate(out)]


def test_units_of_a_row_are_packed_as_by_a_loop(spark):
    rng = random.Random(3)
    rows = [[]]
    for n in (1, 2, 30, 255, 256, 257, 700):
        index = 0
        units = []
        for _ in range(n):
            index += rng.choice([1, 1, 1, 1, 2])
            units.append((index, " ".join(["w"] * rng.choice([1, 5, 60, 200, 400]))))
        rows.append(units)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "id int, u array<struct<unit_index:int,text:string>>")
    got = {r["id"]: [(c["chunk_no"], c["text"], c["unit_indices"]) for c in r["c"]] for r in df.select("id", G.pack_row_units(F.col("u"), False).alias("c")).collect()}
    assert got == {i: plain_pack(u, L.PROSE_CHUNK_WORDS) for i, u in enumerate(rows)}


def test_windows_of_long_rows_are_those_of_a_loop(spark):
    rng = random.Random(4)
    texts = [" ".join(" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([1, 3, 12, 70]))) + "." for _ in range(n)) for n in (0, 1, 40, 600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for stride in (30, 60):
        got = {r["id"]: r["p"] for r in df.select("id", T.passages(F.col("t"), 60, stride).alias("p")).collect()}
        assert got == {i: windows(t, 60, stride) for i, t in enumerate(texts)}


def test_cost_of_a_unit_does_not_grow_with_the_row(spark):
    def seconds(n, rows):
        df = spark.range(rows).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.alias("unit_index"), F.lit("a b c d " * 50).alias("text"))).alias("u"))
        job = df.select(F.size(G.pack_row_units(F.col("u"), False)).alias("n")).agg(F.sum("n"))
        job.collect()
        t = time.time()
        assert job.first()[0] == n * rows
        return time.time() - t

    assert seconds(40_000, 1) < 8 * max(seconds(400, 100), 0.5)


def test_sizes_of_the_compared_corpus(spark):
    rows = [(1, "One two three. " * 30, "a", 1), (2, "Four five six. " * 50, "b", 2), (3, "", "c", 3), (4, "Seven eight. " * 90, "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string, seq long")
    stored = {d: len(windows(t, 60, 60)) for d, t, _, _ in rows}
    for own in (False, True):
        for early in (False, True):
            got = {r[0]: r[1] for r in P.corpus_sizes(docs, P.corpus_passages(docs), own, early).collect()}
            assert got == {d: sum(n for (e, _, u, s2), n in zip(rows, stored.values(), strict=True) if (not own or u != tag) and (not early or s2 < s)) for d, _, tag, s in rows}
    rep = {r["doc_id"]: r for r in P.find_overlap(docs, docs.limit(0)).collect()}
    assert rep[1]["note"] == O.NOTE_NO_CORPUS and rep[3]["note"] == O.NOTE_EMPTY and rep[1]["corpus_size"] == 0 == rep[1]["chunks_compared"]


def test_page_passages_are_judged_by_joins(spark, monkeypatch):
    from inkstone.operators import external as E

    rng = random.Random(12)
    words = [f"w{i}" for i in range(160)]
    make = lambda n: " ".join(" ".join(rng.choices(words, k=12)).capitalize() + "." for _ in range(n))
    docs = [(i, make(12)) for i in range(5)] + [(9, "")]
    pages = [(i, "wikipedia", f"t{k}", f"u{k}", make(10) + (" " + docs[i][1][:400] if k == 1 else "")) for i in range(5) for k in range(3)]
    pages += [(0, "arxiv", "copy", "u9", pages[0][4]), (77, "arxiv", "x", "y", make(6)), (1, "arxiv", "x", "y", None)]
    formed = []
    real = E.share_pairs
    monkeypatch.setattr(E, "share_pairs", lambda *a: formed.append((a[3], real(*a))) or formed[-1][1])
    d = spark.createDataFrame(docs, "doc_id long, text string")
    x = spark.createDataFrame(pages, "doc_id long, kind string, title string, url string, text string")
    got = {(r["doc_id"], r["title"], r["window_no"]): (r["word_share"], r["gram_share"]) for r in E.external_prefilter(d, x).collect()}
    tok = lambda s: re.findall(r"[a-z0-9']+", s.lower())
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    want, pairs = {}, set()
    for doc, _, title, _, text in pages:
        own = [tok(p) for p in windows(dict(docs).get(doc, ""), 60, 30)]
        for k, p in enumerate(windows(text or "", 60, 60)):
            t = tok(p)
            pairs |= {(doc, p, i) for i in range(len(own))}
            word = max((len(set(t) & set(q)) / len(set(t) | set(q)) for q in own), default=0.0)
            gram = max((len(grams(t) & grams(q)) / len(grams(q)) for q in own if grams(q)), default=0.0)
            if word >= L.PREFILTER_WORD or gram >= L.PREFILTER_NGRAM:
                want[doc, title, k] = (word, gram)
    assert got == {k: (pytest.approx(a), pytest.approx(b)) for k, (a, b) in want.items()} and len(want) > 20
    assert [f for f, _ in formed] == [0.5, L.PREFILTER_WORD, 0.5, L.PREFILTER_NGRAM, 0.0, 0.0] and formed[0][1].count() < len(pairs)
