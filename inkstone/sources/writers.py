"""Writers: history and corpus appends, reports, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import segment as G

HISTORY_COLUMNS = [
    "id", "file_name", "file_type", "analysis_type", "ai_probability", "similarity_score",
    "confidence", "status", "created_at", "report_path", "result",
]


def record_id(*parts: Column) -> Column:
    """Id from the content: an append that is retried writes the same ids, and no
    task has to number rows one after the other."""
    return F.xxhash64(*parts)


def append_history(rows: DataFrame, path: str, now: Column | None = None, batch: str = "") -> None:
    """Append analysed records. A record's id comes from its content and ``batch``, the
    name of the append: the same append tried again writes the same ids, whenever it runs."""
    stamped = rows.withColumn("created_at", now if now is not None else F.current_timestamp())
    if "id" not in rows.columns:
        stamped = stamped.withColumn("id", record_id(F.lit(batch), F.col("file_name"), F.col("analysis_type"), F.to_json("result")))
    if "report_path" not in stamped.columns:
        stamped = stamped.withColumn("report_path", F.lit(None).cast("string"))
    stamped.select(*HISTORY_COLUMNS).write.mode("append").parquet(path)


def chunk_rows(docs: DataFrame, tag: Column) -> DataFrame:
    """Stored passages (no overlap) of documents: doc_id, tag, chunk_index, chunk_text."""
    p = G.explode_passages(docs.withColumn("tag", tag), keep=("tag",), stride=L.STORE_STRIDE)
    return p.select("doc_id", "tag", F.col("passage_no").alias("chunk_index"), F.col("passage").alias("chunk_text"))


def append_chunks(docs: DataFrame, path: str, tag: Column) -> None:
    chunk_rows(docs, tag).write.mode("append").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """An evaluation report without raw scores."""
    report.drop("scores").write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
