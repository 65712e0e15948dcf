"""Arrivals, retention and repeats: batches, streams and plain folds give the same rows."""

import datetime as dt
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstone.operators import ordered as S
from inkstone.streaming import arrivals as A
from inkstone.streaming import ingest as I
from inkstone.streaming import repeats as R
from inkstone.streaming.retention import Retained

from test_overlap import corpus, windows


def tokens(s):
    return re.findall(r"[a-z0-9']+", s.lower())


def plain_arrivals(docs, cap=None):
    """(doc_id, passage_no) -> best score and the passage it was found in, one document at a time."""
    placed, df, n, out, known = [], Counter(), 0, {}, {}

    def vector(p, df, n):
        v = {w: k * (1 + math.log((n + 1) / (df[w] + 1))) for w, k in Counter(tokens(p)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    for d, text, _ in docs:
        low = 0 if cap is None else len(placed) - cap
        seen = [(i, c) for i, c in enumerate(placed) if i >= low]
        for k, p in enumerate(windows(text, 60, 30)):
            q = vector(p, df, n)
            scored = [(round(sum(x * c[1].get(w, 0.0) for w, x in q.items()), 9), c[0]) for _, c in seen]
            out[d, k] = max(scored, default=(0.0, None), key=lambda x: x[0])
        new = []
        at_df, at_n = df.copy(), n
        for j, p in enumerate(windows(text, 60, 60)):
            block = 0 if cap is None else (len(placed) + j) // cap
            if (p, block) not in known:
                known[p, block] = vector(p, at_df, at_n)
                df.update(set(tokens(p)))
                n += 1
            new.append((p, known[p, block]))
        placed += new
    return out


def run_batches(spark, docs, n, base, cap=None):
    size = -(-len(docs) // n)
    for i in range(n):
        part = spark.createDataFrame(docs[i * size : (i + 1) * size], "doc_id long, text string, seq long")
        A.compare_then_store(part, i, f"{base}/corpus", f"{base}/rep", cap)
    return sorted(map(tuple, spark.read.parquet(f"{base}/rep").drop("batch_id").collect()))


@pytest.fixture(scope="module")
def docs():
    return [(i, t, i) for i, t, _ in corpus(random.Random(11), 15)]


def test_reports_do_not_depend_on_batch_borders(spark, docs, tmp_path):
    rows = [run_batches(spark, docs, n, tmp_path / str(n)) for n in (1, 5)]
    assert rows[0] == rows[1]
    want = plain_arrivals(docs)
    by_doc = {}
    for (d, _), (score, _) in want.items():
        by_doc.setdefault(d, []).append(score)
    for r in rows[0]:
        assert r[1] == pytest.approx(100 * sum(by_doc[r[0]]) / len(by_doc[r[0]]), abs=0.051)
        assert r[2] == pytest.approx(100 * max(by_doc[r[0]]), abs=0.051)
    runs = A.Runs(spark, f"{tmp_path}/5/corpus").listed()
    assert runs == [(0, 3), (4, 4)]
    # a batch that is run again finds what it found and writes the same rows
    A.compare_then_store(spark.createDataFrame(docs[12:], "doc_id long, text string, seq long"), 4, f"{tmp_path}/5/corpus", f"{tmp_path}/5/rep")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/5/rep").drop("batch_id").collect())) == rows[0]
    chunks = A.stored_chunks(spark, f"{tmp_path}/5/corpus")
    assert chunks.count() == sum(len(windows(t, 60, 60)) for _, t, _ in docs) == chunks.select("place").distinct().count()
    assert A.stored_chunks(spark, f"{tmp_path}/none").count() == 0


def test_a_cap_limits_what_an_arrival_sees(spark, docs, tmp_path):
    cap = 9
    rows = [run_batches(spark, docs, n, tmp_path / str(n), cap) for n in (1, 3)]
    assert rows[0] == rows[1]
    best = {}
    for (d, _), (score, _) in plain_arrivals(docs, cap).items():
        best[d] = max(best.get(d, 0.0), score)
    assert {r[0]: r[2] for r in rows[0]} == {d: pytest.approx(100 * s, abs=0.051) for d, s in best.items()}
    newest = A.stored_chunks(spark, f"{tmp_path}/3/corpus", cap=cap).select("place").collect()
    total = sum(len(windows(t, 60, 60)) for _, t, _ in docs)
    assert sorted(r[0] for r in newest) == list(range(total - cap, total))


def fold(times, horizon):
    kept = []
    for t in sorted(times):
        if not kept or t >= kept[-1] + horizon:
            kept.append(t)
    return kept


def test_step_maps_chain_to_the_fold():
    rng = random.Random(2)
    for _ in range(300):
        times = sorted({rng.randint(0, 60) for _ in range(rng.randint(1, 40))})
        horizon, cuts = rng.randint(1, 15), sorted(rng.sample(range(1, len(times)), min(len(times) - 1, rng.randint(0, 4)))) if len(times) > 1 else []
        pieces = [times[a:b] for a, b in zip([0, *cuts], [*cuts, len(times)], strict=True)]
        kept, got = R.NEVER, []
        for p in pieces:
            arr = R.np.array(p)
            got += arr[R._kept(arr, horizon, kept)].tolist()
            uptos, ends = R._step_map(arr, horizon)
            kept = int(ends[0]) if kept == R.NEVER else R._after(uptos, ends, horizon, kept)
            assert kept == got[-1]
        assert got == fold(times, horizon)


@pytest.fixture(scope="module")
def events():
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=rng.randint(0, 40 * 86_400)), f"k{rng.choice([0, 0, 0, 1, 2, 3])}") for k in range(700)]
    return [*rows, (700, start + dt.timedelta(days=3), "k0"), (701, start + dt.timedelta(days=3), "k0"), *rows[:5]]


def plain_kept(events):
    kept = set()
    for tag in {e[2] for e in events}:
        times = fold({e[1] for e in events if e[2] == tag}, dt.timedelta(days=2))
        kept |= {(min(e[0] for e in events if e[1] == t and e[2] == tag), t, tag) for t in times}
    return kept


def test_batch_keeps_the_first_of_each_horizon(spark, events):
    df = spark.createDataFrame([*events, (900, None, "k0"), (901, events[0][1], None)], "n long, ts timestamp, tag string")
    got = I.dedupe_arrivals(df.repartition(6), horizon="2 days")
    assert {tuple(r) for r in got.collect()} == plain_kept(events) and got.count() == len(plain_kept(events))
    assert I.dedupe_arrivals(df.limit(0), horizon="2 days").count() == 0


def test_stream_keeps_the_same_rows_as_the_batch(spark, events, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "n long, ts timestamp, tag string"
    rows, rng = sorted(events, key=lambda e: e[1]), random.Random(8)
    late = (950, rows[0][1], "k9")  # arrives when the watermark has long passed it
    for i in range(3):  # out of order inside a file, later files begin before earlier ones end
        part = rows[i * 236 : (i + 1) * 236 + 40]
        part = part + [late] if i == 2 else part
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    I.dedupe_arrivals(stream, horizon="2 days").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").format("parquet").option(
        "path", f"{tmp_path}/out").start().awaitTermination()
    end = max(e[1] for e in events) - dt.timedelta(days=2)
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()
    assert {tuple(r) for r in got} == {k for k in plain_kept(events) if k[1] <= end} and len(got) == len({tuple(r) for r in got})


def test_retention_writes_only_new_rows_and_forgets_old_files(spark, tmp_path):
    path, rng = str(tmp_path / "t"), random.Random(6)
    ids = list(range(400))
    for i in range(5):
        part = ids[i * 80 : (i + 1) * 80]
        rng.shuffle(part)
        kept = Retained(spark, path, "id")
        kept.append(spark.createDataFrame([(x, "v") for x in part], "id long, v string").repartition(2), i)
        kept.append(spark.createDataFrame([(x, "v") for x in part], "id long, v string").repartition(2), i)  # run again
        kept.forget(100, before=i)
    assert sorted(r["id"] for r in Retained(spark, path, "id").newest(100).collect()) == ids[-100:]
    left = {r["batch_id"] for r in spark.read.parquet(f"{path}/stats").select("batch_id").distinct().collect()}
    assert left == {2, 3, 4}
    assert Retained(spark, path, "id").newest(1000).count() == 240


def test_percentiles_and_ranks_at_any_scale(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([rng.random(), 0.5, 1e9 * rng.random()])) for g in "aab" for _ in range(700)] + [("c", None), ("d", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in S.percentiles(df, "x", {"p10": 0.1, "p50": 0.5, "p100": 1.0}, ["g"]).collect()}
    want = {r["g"]: r for r in df.filter("x is not null").groupBy("g").agg(*[F.percentile("x", f).alias(n) for n, f in (("p10", 0.1), ("p50", 0.5), ("p100", 1.0))], F.count("*").alias("total")).collect()}
    assert {g: tuple(r)[1:] for g, r in got.items()} == {g: pytest.approx(tuple(r)[1:]) for g, r in want.items()}
    assert S.percentiles(df.filter("x is null"), "x", {"p": 0.5}).first()["p"] is None
    values = sorted((x for _, x in rows if x is not None), reverse=True)
    assert [S.nth_greatest(df, "x", k) for k in (1, 77, 5000)] == [values[0], values[76], values[-1]]
