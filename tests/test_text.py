"""Admission, segmentation and packing against plain restatements."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from inkstone.functions import quality as Q
from inkstone.functions import scores as B
from inkstone.functions import text as T
from inkstone.operators import dense as D
from inkstone.operators import segment as G

PARAGRAPH = "The garden behind the house is quiet in the morning, and my sister likes to read there with a cup of tea."


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("text,status", [
    ("xkcdbrtgh wrtpsdfgh", "unanalyzable"), ("asdfghjkl qwertyuiop", "unanalyzable"), ("hello there", "insufficient"),
    ("1234 5678 !!! ???", "unanalyzable"), ("aaaaaaaaaa", "unanalyzable"), ("", "insufficient"), (PARAGRAPH, "ok"),
])
def test_quality_gate(spark, text, status):
    assert one(spark, text, Q.quality_gate(F.col("text")))["status"] == status


@pytest.mark.parametrize("text,kind", [
    ("def add(a, b):\n    return (a + b)\n\nclass A:\n    def f(self): return [1]", "code"),
    ("public int Add(int a, int b) {\n    return (a + b);\n}", "code"),
    ("They return every summer. " + PARAGRAPH, "prose"), ("  \n ", "empty"),
])
def test_classify_block(spark, text, kind):
    assert one(spark, text, Q.classify_block(F.col("text"))) == kind


def test_keyboard_coverage_counts_overlaps_once(spark):
    for token, want in [("qwertrewq", 1.0), ("qwertyx", 6 / 7), ("abcdefg", 0.0), ("asdfgzxcvb", 1.0), ("xqwertx", 5 / 7)]:
        assert one(spark, token, Q.keyboard_coverage(F.col("text"))) == pytest.approx(want)


def plain_windows(lens, size, stride):
    out, i = [], 0
    while i < len(lens):
        total, e = 0, i
        while e < len(lens) and total < size:
            total += lens[e]
            e += 1
        out.append((i, e))
        if e >= len(lens):
            break
        walked, j = 0, i
        while j < e and walked < stride:
            walked += lens[j]
            j += 1
        i = max(j, i + 1)
    return out


@pytest.mark.parametrize("size,stride", [(60, 30), (60, 60), (10, 3)])
def test_window_bounds(spark, size, stride):
    rng = random.Random(3)
    data = [(i, [rng.choice([1, 2, 5, 10, 20, 40, 70]) for _ in range(rng.randint(0, 60))]) for i in range(500)]
    rows = spark.createDataFrame(data, "i int, l array<int>").select("i", T.window_bounds(F.col("l"), size, stride).alias("w"))
    for r in rows.collect():
        assert [(x.s, x.e) for x in r.w] == plain_windows(data[r.i][1], size, stride)


def plain_pack(rows, limit=350):
    out = {}
    for doc, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        chunks, cur, size, last = [], [], 0, None
        for _, i, t in group:
            n = len(t.split())
            if cur and (i != last + 1 or size + n > limit):
                chunks.append(cur)
                cur, size = [], 0
            cur.append(i)
            size, last = size + n, i
        chunks.append(cur)
        out[doc] = chunks
    return out


@pytest.mark.parametrize("block", [4096, 7, 50])
def test_pack_units_in_blocks(spark, block):
    """Chunks do not depend on how a document is cut into blocks."""
    rng, rows = random.Random(5), []
    for doc in range(20):
        i = 0
        for _ in range(rng.randint(1, 150)):
            i += 1 if rng.random() < 0.9 else 2
            rows.append((doc, i, " ".join(["w"] * rng.choice([1, 5, 30, 60, 100, 349, 350, 351, 800]))))
    df = spark.createDataFrame(rows, "doc_id long, unit_index int, text string")
    got = {}
    for r in G.pack_units(df, block=block).collect():
        got.setdefault(r.doc_id, {})[r.chunk_no] = list(r.unit_indices)
        assert sum(len(t.split()) for d, i, t in rows if d == r.doc_id and i in r.unit_indices) == len(r.text.split())
    want = plain_pack(rows)
    assert {d: [c[k] for k in sorted(c)] for d, c in got.items()} == want


def test_null_stays_null_in_bands(spark):
    df = spark.createDataFrame([(None,), (70.0,)], "s double")
    got = [(r.c, r.v) for r in df.select(B.clamp(F.col("s"), 0, 50).alias("c"), B.verdict_band(F.col("s")).alias("v")).collect()]
    assert got == [(None, None), (50.0, "likely_ai")]


def test_dense_topk_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 16))
    m = centres[rng.integers(0, 5, 400)] + 0.3 * rng.normal(size=(400, 16))
    m[:140] = centres[0] + 0.01 * rng.normal(size=(140, 16))  # one crowded cell
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r["rank"]): r.match_id for r in D.vector_cosine_topk(df, df, k=3, cells=8, block_rows=37).collect()}
    s = np.round(m.astype("float64") @ m.astype("float64").T, 9)
    np.fill_diagonal(s, -9)
    for i in range(len(m)):
        want = sorted(range(len(m)), key=lambda j: (-s[i, j], j))[:3]
        assert [got[(i, k + 1)] for k in range(3)] == want
