"""Sources and sinks: what is written to the shared folder is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.session import scratch_dir
from inkstone.sources import readers as R
from inkstone.sources import writers as W

from .kit import HISTORY_SQL, check, docs, history
from .records import CHUNKS_SQL


@check("read_text_files", "SELECT lang, count(*) AS n_lines FROM documents GROUP BY 1")
def _(spark, sf):
    path = scratch_dir(spark, "texts")
    d = docs(spark, sf).select("lang", F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.col("source")).alias("value"))
    d.repartition("lang").write.partitionBy("lang").text(path)
    files = R.read_text_files(spark, path).filter(F.col("file_name").endswith(".txt"))
    n = F.regexp_count("text", F.lit("\n"))
    return files.groupBy(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang")).agg(F.sum(n).alias("n_lines"))


@check("read_delimited", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderpriority = '' THEN NULL ELSE o_orderpriority END AS o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def _(spark, sf):
    path = scratch_dir(spark, "tsv")
    R.read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey").write.option("sep", "\t").csv(path, header=True)
    return R.read_delimited(spark, path)


@check("read_samples", "SELECT d.lang AS \"group\", count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang IN ('en', 'fr') GROUP BY 1")
def _(spark, sf):
    path = scratch_dir(spark, "samples")
    lab = R.read_table(spark, sf, "labels")
    s = docs(spark, sf).join(lab, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.when(F.col("quality") == 1, "human").otherwise("ai").alias("label"),
        F.col("lang").alias("group"), "source",
    )
    W.write_jsonl(s, path)
    return R.read_samples(spark, path, ["en", "fr"]).groupBy("group").agg(F.count("*").alias("n"))


@check("union_labelled_sets", "SELECT 'docs#' || CAST(doc_id AS VARCHAR) AS id, 'human' AS label, 'prose' AS \"group\" FROM documents UNION ALL SELECT 'bench#' || CAST(item_id AS VARCHAR), 'ai', 'items' FROM benchmark")
def _(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("pos"), F.col("text").alias("document"))
    b = R.read_table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("document"))
    return R.union_labelled_sets([(d, "docs", "human", "prose"), (b, "bench", "ai", "items")], "tables").select("id", "label", "group")


TURNS = "turns AS (SELECT conv_id, turn, role, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x0: x0 <> '')) AS n FROM conversations)"


@check("explode_answers", f"WITH {TURNS}, c AS (SELECT CAST(conv_id AS VARCHAR) AS id, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' END AS label, turn FROM turns WHERE n >= 20 AND role IN ('user', 'assistant')) SELECT id || '/' || label AS id, label, CAST(min(turn) AS BIGINT) AS first_turn FROM c GROUP BY id, label")
def _(spark, sf):
    c = R.read_table(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant"))
    say = lambda r: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "text")))),
        lambda x: F.concat(x["text"], F.lit(" t"), x["turn"].cast("string")),
    )
    q = c.groupBy(F.col("conv_id").cast("string").alias("id")).agg(say("user").alias("human_answers"), say("assistant").alias("machine_answers"))
    out = R.explode_answers(q, min_words=21)
    return out.select("id", "label", F.regexp_extract("text", r" t(\d+)$", 1).cast("long").alias("first_turn"))


@check("admit_files", "SELECT 'txt' AS extension, '' AS reason, (SELECT count(DISTINCT lang) FROM documents) AS n UNION ALL SELECT 'json', 'unsupported type', (SELECT count(DISTINCT lang) FROM documents)")
def _(spark, sf):
    path = scratch_dir(spark, "uploads")
    d = docs(spark, sf)
    d.select("lang", "source").repartition("lang").write.partitionBy("lang").text(f"{path}/a")
    d.select("lang", "doc_id").repartition("lang").write.partitionBy("lang").json(f"{path}/b")
    return R.admit_files(spark, path).filter("extension IN ('txt', 'json')").groupBy("extension", "reason").agg(F.count("*").alias("n"))


@check("audit_images", """WITH f AS (SELECT doc_id, doc_id % 5 AS k FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' END AS mime,
 CASE WHEN k < 3 THEN '' WHEN k = 3 THEN 'not a JPEG, PNG or WEBP' ELSE 'empty' END AS reason FROM f""")
def _(spark, sf):
    head = F.expr(
        "unhex(CASE doc_id % 5 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '524946460000000057454250' WHEN 3 THEN '4749463839' END)"
    )
    body = F.when(F.col("doc_id") % 5 == 4, F.lit("").cast("binary")).otherwise(F.concat(head, F.col("text").cast("binary")))
    return R.audit_images(docs(spark, sf).select("doc_id", body.alias("content"))).select("doc_id", "mime", "reason")


@check("append_history", f"WITH {HISTORY_SQL} SELECT analysis_type, count(*) AS n, count(DISTINCT id) AS ids FROM hist GROUP BY 1")
def _(spark, sf):
    path = scratch_dir(spark, "history")
    h = history(spark, sf).select(
        "file_name", "file_type", "analysis_type", "ai_probability", "similarity_score", F.lit("low").alias("confidence"), "status",
        F.struct(F.col("id").alias("n")).alias("result"),
    )
    for kind in ("text", "image"):
        W.append_history(h.filter(F.col("analysis_type") == kind), path)
    return spark.read.parquet(path).groupBy("analysis_type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@check("append_chunks", f"WITH RECURSIVE {CHUNKS_SQL} SELECT history_id AS doc_id, count(*) AS chunks, md5(string_agg(chunk_text, '|' ORDER BY chunk_index)) AS all_md5 FROM ck GROUP BY 1")
def _(spark, sf):
    path = scratch_dir(spark, "chunks")
    d = docs(spark, sf).select("doc_id", "text")
    for i in range(2):
        W.append_chunks(d.filter(F.col("doc_id") % 2 == i), path, F.col("doc_id").cast("string"))
    c = spark.read.parquet(path).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("chunks"), F.md5(F.array_join(F.transform("c", lambda x: x["chunk_text"]), "|")).alias("all_md5"))


@check("write_report", "SELECT lang AS \"group\", count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    path = scratch_dir(spark, "report")
    g = docs(spark, sf).groupBy(F.col("lang").alias("group")).agg(F.count("*").alias("n"), F.array(F.max("doc_id")).alias("scores"))
    W.write_report(g, path)
    return spark.read.json(path)


@check("write_jsonl", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def _(spark, sf):
    path = scratch_dir(spark, "jsonl")
    W.write_jsonl(docs(spark, sf).select("doc_id", "text"), path)
    return spark.read.json(path).select("doc_id", F.md5("text").alias("text_md5"))
