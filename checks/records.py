"""History, overview, report rows, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import values as V
from inkstone.operators import history as H
from inkstone.plans import records as R
from inkstone.plans import scoring as P
from inkstone.session import scratch_dir
from inkstone.sources.readers import read_corpus, read_table
from inkstone.sources.writers import chunk_rows
from inkstone.streaming import ingest as I
from inkstone.streaming.retention import Retained

from .kit import HISTORY_SQL, NOW, check, docs, history, passages_sql, q, r6, strip

NOW_SQL = f"TIMESTAMP '{NOW}'"
now = lambda: F.lit(NOW).cast("timestamp_ntz")
STATS = """count(*) AS total_analyses, count(*) FILTER (analysis_type = 'text') AS text_analyses, count(*) FILTER (analysis_type = 'image') AS image_analyses, count(*) FILTER (ai_probability >= 60) AS ai_flagged,
 coalesce(round(avg(similarity_score), 1), 0.0) AS average_similarity, coalesce(round(avg(ai_probability), 1), 0.0) AS average_ai_probability"""
CUR, PREV = f"created_at >= {NOW_SQL} - INTERVAL 7 DAY", f"created_at >= {NOW_SQL} - INTERVAL 14 DAY AND created_at < {NOW_SQL} - INTERVAL 7 DAY"
WEEKS = ", ".join([
    f"count(*) FILTER ({CUR}) AS scans_this_week", f"count(*) FILTER ({PREV}) AS scans_prev_week",
    *[f"round(avg({c}) FILTER ({w}), 1) AS avg_{n}_{s}_week" for c, n in (("ai_probability", "ai"), ("similarity_score", "similarity")) for w, s in ((CUR, "this"), (PREV, "prev"))],
])
DELTAS = "round(avg_ai_this_week - avg_ai_prev_week, 1) AS ai_delta, round(avg_similarity_this_week - avg_similarity_prev_week, 1) AS similarity_delta"
TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"
stamp = lambda: F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created")


@check("filter_history", f"WITH {HISTORY_SQL} SELECT id, analysis_type FROM hist WHERE analysis_type = 'image'")
def _(spark, sf):
    return H.filter_history(history(spark, sf), "image").select("id", "analysis_type")


@check("get_history", f"WITH {HISTORY_SQL} SELECT id, file_name, {TS} AS created FROM hist WHERE id = 77")
def _(spark, sf):
    return H.get_history(history(spark, sf), 77).select("id", "file_name", stamp())


@check("history_sorted", f"WITH {HISTORY_SQL} SELECT id, {TS} AS created FROM hist ORDER BY created_at DESC, id DESC")
def _(spark, sf):
    return H.history_sorted(history(spark, sf)).select("id", stamp())


@check("recent_history", f"WITH {HISTORY_SQL} SELECT id, {TS} AS created FROM hist ORDER BY created_at DESC, id DESC LIMIT 4")
def _(spark, sf):
    return H.recent_history(history(spark, sf)).select("id", stamp())


@check("dashboard_stats", f"WITH {HISTORY_SQL} SELECT {STATS} FROM hist")
def _(spark, sf):
    return H.dashboard_stats(history(spark, sf))


@check("weekly_delta", f"WITH {HISTORY_SQL}, w AS (SELECT {WEEKS} FROM hist) SELECT *, {DELTAS} FROM w")
def _(spark, sf):
    return H.weekly_delta(history(spark, sf), now())


@check("history_overview", f"WITH {HISTORY_SQL}, w AS (SELECT {STATS}, {WEEKS} FROM hist) SELECT *, {DELTAS} FROM w")
def _(spark, sf):
    return H.history_overview(history(spark, sf), now())


CHUNKS_SQL = f"{passages_sql('pc', 'documents', 60, 60)}, ck AS (SELECT doc_id AS history_id, passage_no AS chunk_index, passage AS chunk_text FROM pc)"


def chunks(spark, sf):
    c = chunk_rows(docs(spark, sf).select("doc_id", "text"), F.col("doc_id").cast("string"))
    return c.withColumnRenamed("doc_id", "history_id")


@check("chunk_history_join", f"WITH RECURSIVE {HISTORY_SQL}, {CHUNKS_SQL} SELECT history_id, CAST(chunk_index AS INT) AS chunk_index, file_name AS display_name FROM ck JOIN hist ON hist.id = ck.history_id")
def _(spark, sf):
    return H.chunk_history_join(chunks(spark, sf), history(spark, sf)).select("history_id", "chunk_index", "display_name")


@check("read_corpus", f"WITH RECURSIVE {HISTORY_SQL}, {CHUNKS_SQL} SELECT history_id, CAST(chunk_index AS INT) AS chunk_index, md5(chunk_text) AS text_md5, 'submission' AS kind, strftime(created_at, '%Y-%m-%d') AS submitted FROM ck JOIN hist ON hist.id = ck.history_id")
def _(spark, sf):
    return read_corpus(chunks(spark, sf), history(spark, sf)).select(
        "history_id", "chunk_index", F.md5("chunk_text").alias("text_md5"), "kind", F.date_format("submitted_at", "yyyy-MM-dd").alias("submitted")
    )


@check("delete_history", f"WITH RECURSIVE {HISTORY_SQL}, {CHUNKS_SQL} SELECT (SELECT count(*) FROM hist WHERE id % 10 <> 3) AS records, (SELECT count(*) FROM ck WHERE history_id % 10 <> 3) AS chunks")
def _(spark, sf):
    h = history(spark, sf)
    kept, left = H.delete_history(h, chunks(spark, sf), h.filter("id % 10 = 3").select("id"))
    return kept.agg(F.count("*").alias("records")).select("records", left.select(F.count("*")).scalar().alias("chunks"))


@check("corpus_cap", f"WITH {HISTORY_SQL} SELECT id FROM hist ORDER BY id DESC LIMIT 700")
def _(spark, sf):
    return H.corpus_cap(history(spark, sf).select("id"), 700, "id")


@check("latest_detail", f"WITH {HISTORY_SQL}, l AS (SELECT id FROM hist WHERE analysis_type = 'text' ORDER BY created_at DESC, id DESC LIMIT 1), m AS (SELECT id AS history_id, CAST(floor(similarity_score) AS INT) AS score, k AS passage_no FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS k FROM hist)) SELECT history_id, score, CAST(passage_no AS INT) AS passage_no FROM m WHERE history_id = (SELECT id FROM l) ORDER BY score DESC, passage_no LIMIT 3")
def _(spark, sf):
    h = history(spark, sf)
    m = h.select(F.col("id").alias("history_id"), F.floor("similarity_score").cast("int").alias("score"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("passage_no"))
    return H.latest_detail(h, m)


@check("relative_time", f"""WITH {HISTORY_SQL}, s AS (SELECT id, created_at, epoch(date_trunc('second', {NOW_SQL})) - epoch(date_trunc('second', created_at)) AS s FROM hist)
 SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(CAST(floor(s / 60) AS INT) AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(CAST(floor(s / 3600) AS INT) AS VARCHAR) || 'h ago' WHEN s < 604800 THEN CAST(CAST(floor(s / 86400) AS INT) AS VARCHAR) || 'd ago' ELSE strftime(created_at, '%b %-d, %Y') END AS shown FROM s""")
def _(spark, sf):
    h = history(spark, sf).select("id", F.col("created_at").cast("timestamp").alias("t"))
    return h.select("id", V.relative_time(F.col("t"), F.lit(NOW).cast("timestamp")).alias("shown"))


ISO = "CASE id % 6 WHEN 0 THEN substr(t, 1, 10) WHEN 1 THEN replace(t, ' ', 'T') || '.25' WHEN 2 THEN replace(t, ' ', 'T') || 'Z' WHEN 3 THEN t || '+05:30' WHEN 4 THEN t ELSE 'on ' || t END"


@check("parse_time", f"""WITH {HISTORY_SQL}, s AS (SELECT id, {TS} AS t FROM hist)
 SELECT id, CASE id % 6 WHEN 0 THEN epoch_us(CAST(substr(t, 1, 10) AS TIMESTAMP)) WHEN 1 THEN epoch_us(CAST(t AS TIMESTAMP)) + 250000 WHEN 3 THEN epoch_us(CAST(t AS TIMESTAMP)) - 19800000000 WHEN 5 THEN -1 ELSE epoch_us(CAST(t AS TIMESTAMP)) END AS micros FROM s""")
def _(spark, sf):
    """Times of the history as ISO texts of five forms, and one that is none."""
    s = history(spark, sf).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("t"))
    return s.select("id", F.coalesce(F.unix_micros(V.parse_time(F.expr(ISO))), F.lit(-1)).alias("micros"))


@check("structure_label", f"WITH {HISTORY_SQL}, n AS (SELECT id, file_name || CASE id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pptx' WHEN 2 THEN '.ppt' ELSE '.txt' END AS f FROM hist) SELECT id, CASE WHEN ends_with(lower(f), '.pdf') THEN 'pdf_pages' WHEN ends_with(lower(f), '.pptx') OR ends_with(lower(f), '.ppt') THEN 'pptx_slides' ELSE 'flat' END AS structure FROM n")
def _(spark, sf):
    f = F.concat("file_name", F.expr("CASE id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pptx' WHEN 2 THEN '.ppt' ELSE '.txt' END"))
    return history(spark, sf).select("id", P.structure_label(f).alias("structure"))


RESULT = (
    "'{\"similarity\": {\"overall_similarity\": ' || CAST(user_id AS STRING) || '.5, \"corpus_size\": ' || CAST(event_id AS STRING) || ', \"matches\": [{\"matched_text\": \"m' || event_type || '\", \"source_name\": \"s\", \"score\": 51.25}]}, "
    "\"heuristic\": {\"ai_likelihood_score\": 12.5, \"verdict\": \"Likely Human\"}, \"final_verdict\": \"Uncertain\"}'"
)


def stored_results(spark, sf):
    e = read_table(spark, sf, "events").withColumn("raw", F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.expr(RESULT)))
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("file_"), F.col("user_id").cast("string")).alias("file_name"), F.col("ts").alias("created_at"), R.result_struct(F.col("raw")).alias("result"))


@check("json_path_fields", """SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN user_id + 0.5::DOUBLE END AS overall, CASE WHEN event_id % 9 <> 0 THEN event_id ELSE -1 END AS corpus_size, CASE WHEN event_id % 9 <> 0 THEN 'm' || event_type END AS first_match FROM events""")
def _(spark, sf):
    r = stored_results(spark, sf)
    return r.select("id", F.col("result.similarity.overall_similarity").alias("overall"), F.coalesce("result.similarity.corpus_size", F.lit(-1)).alias("corpus_size"),
                    F.get("result.similarity.matches", F.lit(0))["matched_text"].alias("first_match"))


@check("result_round_trip", "SELECT event_id AS id, event_id % 9 <> 0 AS kept FROM events")
def _(spark, sf):
    r = stored_results(spark, sf)
    again = R.result_struct(F.to_json("result"))
    return r.select("id", (again["similarity"].isNotNull() & (F.to_json(again) == F.to_json("result"))).alias("kept"))


@check("report_rows", """WITH e AS (SELECT event_id AS id, user_id, event_type FROM events), g AS (SELECT * FROM e WHERE id % 9 <> 0)
 SELECT id, 'record' AS section, CAST(0 AS INT) AS row_no, 'File' AS label, 'file_' || CAST(user_id AS VARCHAR) AS value FROM e
 UNION ALL SELECT id, 'ai', 1, 'Local heuristic (writing-pattern signals)', '12.5%' FROM g UNION ALL SELECT id, 'similarity', 0, 'Overall similarity', CAST(user_id AS VARCHAR) || '.5%' FROM g
 UNION ALL SELECT id, 'similarity', 1, 'Matched sections', '1' FROM g UNION ALL SELECT id, 'similarity', 2, 'Corpus size compared against', CAST(id AS VARCHAR) || ' chunk(s)' FROM g
 UNION ALL SELECT id, 'summary', 0, 'Overall verdict', 'Uncertain' FROM g UNION ALL SELECT id, 'match', 0, '51.2% s', 'm' || event_type FROM g""")
def _(spark, sf):
    return R.report_rows(stored_results(spark, sf)).filter("NOT (section = 'record' AND row_no = 1)")


WEEK_SQL = "SELECT CAST(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS VARCHAR) AS week_start, count(*) AS n, round(avg(value), 6) AS mean FROM events"


@check("weekly_rollup", f"{WEEK_SQL} GROUP BY 1")
def _(spark, sf):
    e = read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return I.weekly_rollup(e).select(F.date_format("week_start", "yyyy-MM-dd HH:mm:ss").alias("week_start"), "n", r6("mean").alias("mean"))


@check("weekly_rollup_stream", f"{WEEK_SQL} WHERE time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1")
def _(spark, sf):
    base = scratch_dir(spark, "weeks")
    e = read_table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    e.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{base}/in")
    I.weekly_rollup_stream(stream, f"{base}/out", f"{base}/ck").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.date_format("week_start", "yyyy-MM-dd HH:mm:ss").alias("week_start"), "n", r6("mean").alias("mean"))


@check("corpus_cap_stream", f"WITH {HISTORY_SQL} SELECT id FROM hist ORDER BY id DESC LIMIT 500")
def _(spark, sf):
    base = scratch_dir(spark, "cap")
    h = history(spark, sf).select("id")
    for i in range(3):  # three files, three batches
        h.filter(F.col("id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in").withColumnRenamed("id", "chunk_id")
    I.corpus_cap_stream(stream, f"{base}/out", f"{base}/ck", 500).awaitTermination()
    return Retained(spark, f"{base}/out", "chunk_id").newest(500).select(F.col("chunk_id").alias("id"))


KEPT_SQL = """ev AS (SELECT DISTINCT event_type || '/' || user_id AS tag, ts FROM events),
kept AS (SELECT tag, min(ts) AS ts FROM ev GROUP BY 1 UNION ALL
  SELECT tag, ts FROM (SELECT k.tag, (SELECT min(e.ts) FROM ev e WHERE e.tag = k.tag AND e.ts >= k.ts + INTERVAL 1 DAY) AS ts FROM kept k) WHERE ts IS NOT NULL),
firsts AS (SELECT k.tag, k.ts, min(e.event_id) AS event_id FROM kept k JOIN events e ON e.ts = k.ts AND e.event_type || '/' || e.user_id = k.tag GROUP BY 1, 2)"""


def arrivals(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("tag"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


@check("dedupe_arrivals", f"WITH RECURSIVE {KEPT_SQL} SELECT tag, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_id FROM firsts")
def _(spark, sf):
    return I.dedupe_arrivals(arrivals(spark, sf), horizon="1 day").select("tag", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_id")


@check("dedupe_arrivals_stream", f"WITH RECURSIVE {KEPT_SQL} SELECT tag, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_id FROM firsts WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def _(spark, sf):
    """The same rows from a stream of three files, as far as the watermark has settled them."""
    base, name = scratch_dir(spark, "repeats"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    src = arrivals(spark, sf)
    edges = src.select(F.percentile_approx(F.unix_micros("ts"), F.array(F.lit(0.3), F.lit(0.6)))).first()[0]
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = src if low is None else src.filter(F.unix_micros("ts") > low)
        (part if high is None else part.filter(F.unix_micros("ts") <= high)).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = I.dedupe_arrivals(stream, horizon="1 day").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/ck")
        query.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    out = spark.read.schema(src.schema).parquet(f"{base}/out")
    return out.select("tag", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_id")
