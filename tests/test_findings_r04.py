"""What FINDINGS_r04.md names: each test fails on the code before its change."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.operators import overlap as O
from inkstone.operators import strips as B
from inkstone.plans import overlap as P
from inkstone.streaming import ingest as I
from test_overlap import brute, corpus

MODES = {"any": lambda t, d, ct, cd: True, "own": lambda t, d, ct, cd: t != ct, "early": lambda t, d, ct, cd: cd < d}


def _refuse(*_):
    raise AssertionError("pairs are shuffled")


@pytest.mark.parametrize("mode,floor,high", [("any", 0.0, 0.5), ("own", 0.0, 0.5), ("own", 0.0, 0.0), ("own", 0.45, 0.2), ("early", 0.0, 0.3)])
def test_f1_f5_strips_equal_brute_force_without_shuffled_pairs(spark, monkeypatch, mode, floor, high):
    rows = corpus(random.Random(11), 16)
    for name, value in (("STRIPS_FROM", 0), ("open_pairs", _refuse), ("verify_pairs", _refuse)):
        monkeypatch.setattr(O, name, value)
    monkeypatch.setattr(O.S, "SMALL_CORPUS_CHARS", 0)
    for name, value in (("STRIP", 12), ("GROUP", 2), ("HIGH", high), ("AT_ONCE", 50), ("LOOKED_UP", 40), ("CELLS", 30), ("PAIRS", 3)):
        monkeypatch.setattr(B, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string").withColumn("seq", F.col("doc_id"))
    got = O.best_match_per_passage(P.query_passages(df), P.corpus_passages(df), floor, exclude_own_tag=mode == "own", earlier_only=mode == "early").collect()
    want = brute(rows, rows, floor, MODES[mode])
    assert {(r.doc_id, r.passage_no): (pytest.approx(r.score, abs=2e-9), None if r.chunk_id is None else int(r.chunk_id)) for r in got} == want


@pytest.mark.parametrize("high,floor", [(0.5, 0.0), (0.0, 0.0), (0.5, 0.4), (2.0, 0.0)])
def test_f1_matches_of_a_strip_are_exact_with_ties(high, floor, monkeypatch):
    import pyarrow as pa

    for name, value in (("HIGH", high), ("AT_ONCE", 300), ("CELLS", 5000), ("OFTEN", 0.02)):
        monkeypatch.setattr(B, name, value)
    rng = np.random.default_rng(5)

    def vectors(n):
        out = []
        for _ in range(n):
            t = np.unique((rng.zipf(1.4, rng.integers(1, 40)) - 1) % 300)[::-1]
            w = rng.random(len(t)) * np.log(2 + t)
            w /= np.sqrt((w * w).sum())
            out.append((t, w, np.sqrt(np.cumsum((w * w)[::-1])[::-1])))
        return out

    def table(x, name, tag):
        cells = [pa.array([list(map(kind, v[i])) for v in x], pa.list_(of)) for i, kind, of in ((0, int, pa.int64()), (1, float, pa.float64()), (2, float, pa.float32()))]
        return pa.table([pa.array(np.arange(len(x))), pa.array(tag), *cells], names=[name, "tag", "tids", "ws", "rests"])

    asked, held = vectors(150), vectors(200)
    held[9] = held[30] = held[170] = asked[4]
    tags = rng.integers(0, 4, 150), rng.integers(4, 5, 200)
    tags[1][:60] = rng.integers(0, 4, 60)
    dense = lambda x: np.array([np.bincount(t, w, 300) for t, w, _ in x])
    scores = np.where(tags[0][:, None] != tags[1][None, :], np.round(dense(asked) @ dense(held).T, 9), -1)
    q, found = B.Queries(table(asked, "u", tags[0]), floor, ["tag"]), {}
    for part in (np.arange(90), np.arange(90, 200)):
        strip = B.unpacked(B.packed_strip(table(held, "c", tags[1]).take(pa.array(part))))
        for r, c, s in zip(*B.matches(q, strip, lambda q, c: c["tag"] != q["tag"], floor), strict=True):
            found.setdefault(r, []).append((s, part[c]))
    for i, row in enumerate(scores):
        best = max((s for s, _ in found.get(i, [])), default=-1)
        top = row.max() if row.max() > 0 and row.max() >= floor else -1
        assert best == pytest.approx(top, abs=2e-9)
        assert {c for s, c in found.get(i, []) if s == best} == (set(np.flatnonzero(row == row.max())) if top > 0 else set())


@pytest.mark.parametrize("cap", [None, 7])
def test_f3_arrivals_in_strips_equal_the_posting_search(spark, monkeypatch, tmp_path, cap):
    rows = corpus(random.Random(3), 12)
    reports = []
    for k, few in enumerate((10**9, 0)):
        monkeypatch.setattr(O, "STRIPS_FROM", few)
        if not few:
            for name, value in (("open_pairs", _refuse), ("verify_pairs", _refuse)):
                monkeypatch.setattr(O, name, value)
            for name, value in (("STRIP", 9), ("GROUP", 2)):
                monkeypatch.setattr(B, name, value)
        for i in range(2):
            part = spark.createDataFrame([(d, t, d) for d, t, _ in rows[i * 6 : i * 6 + 6]], "doc_id long, text string, seq long")
            I.compare_then_store(part, i, f"{tmp_path}/corpus{k}", f"{tmp_path}/rep{k}", cap)
        reports.append(sorted(map(tuple, spark.read.parquet(f"{tmp_path}/rep{k}").collect())))
    assert reports[0] == reports[1] and len(reports[0]) == len(rows)


class _Listed:
    """A list state that counts how often it is written."""

    def __init__(self):
        self.rows, self.writes = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.writes = list(rows), self.writes + 1

    def appendList(self, rows):  # noqa: N802
        self.put(self.rows + list(rows))

    def clear(self):
        self.put([])


def test_f2_stream_state_is_touched_once_for_a_bucket_and_batch(spark):
    import datetime as dt
    from types import SimpleNamespace

    import pandas as pd

    from inkstone.streaming import repeats as R

    schema = spark.createDataFrame([], "tag string, ts timestamp, n long, _t long").schema
    states, timers = {}, []
    handle = SimpleNamespace(getListState=lambda name, _: states.setdefault(name, _Listed()), registerTimer=timers.append)
    day, start = 86_400, dt.datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", start + dt.timedelta(seconds=600 * i), None if i % 7 else i, int((start - dt.datetime(1970, 1, 1)).total_seconds() + 600 * i) * 10**6) for i in range(500)]
    job = R.FirstOfHorizon("tag", schema.names, schema, day * 10**6)
    job.init(handle)
    assert not list(job.handleInputRows((1,), iter([pd.DataFrame(rows[:300], columns=schema.names), pd.DataFrame(rows[250:], columns=schema.names)]), None))
    assert len(timers) == 1 and states["waiting"].writes == 1 and len(states["waiting"].rows) == len(rows)
    passed = rows[450][3] // 1000 + 1
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: passed)
    out = pd.concat(list(job.handleExpiredTimer((1,), now, None)))
    assert not list(job.handleExpiredTimer((1,), now, None)) and states["waiting"].writes == 2
    want = set()
    for tag in ("k0", "k1", "k2"):
        last = None
        for r in rows[:451]:
            if r[0] == tag and (last is None or r[3] >= last + day * 10**6):
                want.add(r[:2])
                last = r[3]
    assert {(r.tag, r.ts.to_pydatetime()) for r in out.itertuples()} == want and list(out.columns) == ["tag", "ts", "n"]
    assert len(states["waiting"].rows) == 49 and len(states["last"].rows) == 3 and len(timers) == 2


@pytest.mark.parametrize("block", [1, 3, 64])
def test_f4_page_matches_equal_brute_force_without_rows_of_terms(spark, monkeypatch, block):
    import math
    import re
    from collections import Counter

    from inkstone.operators import external as E

    monkeypatch.setattr(E, "OWN_BLOCK", block)
    monkeypatch.setattr(E, "PAGE_BLOCK", block)
    monkeypatch.delattr(O, "tfidf_vectors")
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["the", "of"] * 5 + [f"w{i}" for i in range(40)]) for _ in range(rng.randint(1, 14)))
    queries = [(d, k, text()) for d in range(6) for k in range(rng.randint(1, 6))] + [(7, 0, "???"), (8, 0, "nothing shared")]
    kept = [(d, kind, t, f"http://{t}", k, text()) for d in (0, 1, 2, 4, 7, 8) for kind, t in (("arxiv", "A"), ("wikipedia", "B")) for k in range(4)]
    kept += [(2, "arxiv", "C", "http://C", 0, queries[-3][2]), (2, "arxiv", "D", "http://D", 0, queries[-3][2]), (9, "arxiv", "A", "http://A", 0, "alone")]
    stored = [text() for _ in range(5)]
    tok = lambda s: re.findall(r"[a-z0-9']+", s.lower())
    fit = {*stored, *(k[5] for k in kept)}
    df = Counter(w for t in fit for w in set(tok(t)))

    def vector(t):
        v = {w: n * math.log((len(fit) + 1) / (df[w] + 1)) for w, n in Counter(tok(t)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items() if x > 0} if size else {}

    want = {}
    for d, k, p in queries:
        near = [(-round(sum(x * vector(e[5]).get(w, 0) for w, x in vector(p).items()), 9), e[1], e[2], e[4], e[5]) for e in kept if e[0] == d]
        if near and min(near)[0] < 0:
            want[d, k] = (pytest.approx(-min(near)[0], abs=2e-9), *min(near)[4:])
    got = E.best_external_match(
        spark.createDataFrame(queries, "doc_id long, passage_no int, passage string"),
        spark.createDataFrame(kept, "doc_id long, kind string, title string, url string, window_no int, passage string"),
        spark.createDataFrame([(t,) for t in stored], "passage string"),
    ).collect()
    assert {(r.doc_id, r.passage_no): (r.score, r.matched_text) for r in got} == want


def test_f11_keys_of_one_task_are_folded_there_and_a_piece_may_keep_nothing(spark):
    import datetime as dt

    from inkstone.streaming import repeats as R

    start, rng = dt.datetime(2024, 1, 1), random.Random(9)
    rows = [(k, start + dt.timedelta(minutes=rng.randint(0, 60_000)), f"k{k % 40}") for k in range(3000)]
    # one key over all tasks, with pieces that lie within a day of the last kept row
    rows += [(9000 + k, start + dt.timedelta(seconds=k), "a") for k in range(3000)]
    want = set()
    for tag in {r[2] for r in rows}:
        last = None
        for t in sorted({r[1] for r in rows if r[2] == tag}):
            if last is None or t >= last + dt.timedelta(days=1):
                want.add((min(r[0] for r in rows if r[1] == t and r[2] == tag), t, tag))
                last = t
    df = spark.createDataFrame(rows, "n long, ts timestamp, tag string")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    for on in ("true", "false"):
        spark.conf.set(coalesce, on)
        try:
            assert {tuple(r) for r in R.first_of_horizon(df, "ts", "tag", "1 day").collect()} == want
        finally:
            spark.conf.set(coalesce, "true")

    starts, times = np.array([0, 5, 6, *range(9, 60)]), np.concatenate([np.arange(5) * 3, [4], [1, 2, 9], np.zeros(50), [7]]).astype(np.int64)
    ends = [*starts[1:], len(times)]
    one = np.concatenate([R._kept(times[a:b], 4, R.NEVER) for a, b in zip(starts, ends, strict=True)])
    assert (R._marks_of_groups(starts, times, 4) == one).all()
