"""Substring dedup, n-gram join, components and nearest neighbours against brute force."""

import hashlib
import random
import re

import numpy as np

from inkstone.llm import hilbert_search as H
from inkstone.llm import ngram_join as J
from inkstone.llm import substring_dedup as D
from inkstone.llm.components import components
from inkstone.llm.word_hashes import gram_hashes, word_hashes
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_removal(rows, window):
    first, out = {}, []
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[p : p + window])] < doc_id:
                gone[p : p + window] = [True] * window
        out.append((doc_id, len(w), " ".join(x for x, g in zip(w, gone, strict=True) if not g), sum(gone)))
    return out


def corpus():
    rng = random.Random(4)
    shared = [prose(100 + i, 70) for i in range(4)]
    rows = [(i, prose(i, rng.randrange(0, 120))) for i in range(40)]
    rows += [(50 + i, prose(i, 30) + " " + rng.choice(shared) + "\n" + prose(i + 300, 20)) for i in range(60)]
    rows += [(120 + i, shared[0]) for i in range(30)] + [(160 + i, " ".join(["same"] * (48 + i))) for i in range(6)]
    rows += [(200, shared[1] + " " + shared[1]), (201, "x " + shared[2] + " y " + shared[2]), (55, "another text " + shared[3]), (50, rows[40][1])]
    rng.shuffle(rows)
    return rows


def test_substring_dedup_equals_brute_force(spark, awkward, nothing):
    rows = corpus() + [(r["doc_id"], r["text"]) for r in awkward.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    facts, cut = D.find_repeats(docs)
    want = plain_removal(rows, 50)
    losing = {(r["doc_id"], r["digest"]): (r["kept_text"], r["n_removed"]) for r in cut.collect()}
    got = []
    for r in facts.collect():
        kept = ("", r["n_words"]) if r["copy"] else losing.get((r["doc_id"], r["digest"]))
        got.append((r["doc_id"], r["n_words"], r["digest"] if kept is None else hashlib.sha256(kept[0].encode()).hexdigest(), kept[1] if kept else 0))
    digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=order) == sorted([(a, n, digest(t), g) for a, n, t, g in want], key=order)
    assert sum(g for *_, g in want) > 3000
    changed = D.remove_repeats(awkward)
    assert changed.columns == awkward.columns and changed.count() == awkward.count() and {r["_kept"] for r in changed.collect()} == {"own"}
    assert D.remove_repeats(nothing).count() == 0


def test_nodes_are_stitched_across_groups(spark):
    """Many groups and few distinct suffixes: nodes cross several borders."""
    rows = [(i, prose(500, 55)) for i in range(40)] + [(100 + i, "lead " * (i % 7 + 1) + prose(500, 55)) for i in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        _, cut = D.find_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
        got = {(r["doc_id"], r["n_removed"]) for r in cut.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # (later documents with the words of 100 to 106 are copies)
    assert got == {(d, g) for d, _, _, g in plain_removal(rows, 50) if g and 100 <= d < 107}


def test_hashes_do_not_depend_on_what_stands_around(monkeypatch):
    words = word_hashes(b"a bb  ccc\ta")
    assert words[0] == words[3] and len(set(words.tolist())) == 3 and words[1] == word_hashes(b"bb")[0]
    for n in (1, 2, 3, 5, 50):
        long = word_hashes(prose(1, 200).encode())
        assert gram_hashes(long, n)[7] == gram_hashes(long[7:], n)[0] and len(gram_hashes(long, n)) == 201 - n
    monkeypatch.setattr("inkstone.llm.word_hashes.PIECE_BYTES", 100)
    assert (word_hashes(prose(1, 200).encode()) == long).all()


def plain_links(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(text or "")
        m = min(5, len(w))
        sets.append({tuple(w[p : p + m]) for p in range(len(w) - m + 1)} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [(d, rows[top(i)][0], links[i]) for i, (d, _) in enumerate(rows)]


def variants(seed, n, edits):
    rng = random.Random(seed)
    base = prose(seed, n).split()
    out = []
    for _ in range(edits):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(n)] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_ngram_join_equals_brute_force(spark, awkward, nothing):
    texts = [prose(i, 60 + i) for i in range(30)] + variants(1, 150, 60) + variants(2, 400, 25) + [prose(3, 100)] * 12 + ["", None, "a b", "a b", "a  b\n", "a c"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(plain_links(rows))
    for block in (8, 192):
        got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in J.similar_documents(docs, block=block).collect())
        assert got == want
    out = J.similar_documents(awkward).collect()
    assert len(out) == awkward.count() and {r["class_id"] for r in out if r["doc_id"] in (1, 2)} == {1}
    assert all(r["class_id"] is None and r["n_links"] == 0 for r in out if r["doc_id"] is None)
    assert J.similar_documents(nothing).count() == 0


def test_band_plan_reaches_its_recall():
    for threshold, recall in ((0.8, 0.9995), (0.5, 0.95), (0.9, 0.99)):
        bands, rows = J.band_plan(threshold, recall, 256)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 256


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (0, 5, 80, 200, 250)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]
    assert J.shared_counts(sets[:3], sets, columns=17).astype(int).tolist() == want


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


def test_components_of_long_ascending_chains(spark):
    edges = [(i, i + 1) for i in range(3000)] + [(10_000 + 7 * i, 10_007 + 7 * i) for i in range(1500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 0 if x < 10_000 else 10_000 for e in edges for x in e}


def test_nearest_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    x[100:160] = 3 * x[100]
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0] * 3), (5080, [None] + [1.0] * 15), (None, [1.0] * 16), (20, rows[20][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in H.nearest(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"), block=128).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21)) and np.allclose([v for *_, v in found], s[[i for _, i, _ in found]])
        hit += len({i for _, i, _ in found} & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
    assert hit >= 0.9 * 20 * len(got)
    assert got[100][0][1] == 101
    copies = [i for _, i, _ in got[100] if 100 <= i < 160]
    assert copies == list(range(101, 101 + len(copies)))  # ties to smaller ids
    assert H.nearest(vectors.limit(0), vectors.select("vec_id")).count() == 0
    few = H.nearest(vectors.where("vec_id < 4"), vectors.where("vec_id = 0").select("vec_id")).collect()
    assert len(few) == 3


def test_hilbert_neighbours_are_adjacent_cells():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = H.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
