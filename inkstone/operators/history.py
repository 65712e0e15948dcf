"""The analysis history: filters, totals, weekly trend, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L


def filter_history(history: DataFrame, kind: str = "all") -> DataFrame:
    return history if kind == "all" else history.filter(F.col("analysis_type") == kind)


def get_history(history: DataFrame, history_id: int) -> DataFrame:
    return history.filter(F.col("id") == history_id)


def history_sorted(history: DataFrame, newest: bool = True) -> DataFrame:
    order = [F.desc("created_at"), F.desc("id")] if newest else [F.asc("created_at"), F.asc("id")]
    return history.orderBy(*order)


def recent_history(history: DataFrame, k: int = 4) -> DataFrame:
    """Top-k without a full sort: each partition keeps its own k first."""
    return history_sorted(history).limit(k)


def _totals() -> list[Column]:
    kind, ai = F.col("analysis_type"), F.col("ai_probability")
    return [
        F.count("*").alias("total_analyses"),
        F.count_if(kind == "text").alias("text_analyses"), F.count_if(kind == "image").alias("image_analyses"),
        F.count_if(ai >= L.AI_AT).alias("ai_flagged"),
        F.coalesce(F.round(F.avg("similarity_score"), 1), F.lit(0.0)).alias("average_similarity"),
        F.coalesce(F.round(F.avg(ai), 1), F.lit(0.0)).alias("average_ai_probability"),
    ]


def _weeks(now: Column) -> list[Column]:
    ts, week = F.col("created_at"), F.expr("INTERVAL 7 DAYS")
    cur, prev = ts >= now - week, (ts >= now - week - week) & (ts < now - week)
    avg = lambda c, when: F.round(F.avg(F.when(when, F.col(c))), 1)
    return [
        F.count_if(cur).alias("scans_this_week"), F.count_if(prev).alias("scans_prev_week"),
        avg("ai_probability", cur).alias("avg_ai_this_week"), avg("ai_probability", prev).alias("avg_ai_prev_week"),
        avg("similarity_score", cur).alias("avg_similarity_this_week"),
        avg("similarity_score", prev).alias("avg_similarity_prev_week"),
    ]


def _with_deltas(out: DataFrame) -> DataFrame:
    """A delta is null where either week has no value."""
    return out.select(
        "*",
        F.round(F.col("avg_ai_this_week") - F.col("avg_ai_prev_week"), 1).alias("ai_delta"),
        F.round(F.col("avg_similarity_this_week") - F.col("avg_similarity_prev_week"), 1).alias("similarity_delta"),
    )


def dashboard_stats(history: DataFrame) -> DataFrame:
    """All counts and averages in one pass."""
    return history.agg(*_totals())


def weekly_delta(history: DataFrame, now: Column) -> DataFrame:
    """The last seven days against the seven before them."""
    return _with_deltas(history.agg(*_weeks(now)))


def history_overview(history: DataFrame, now: Column) -> DataFrame:
    """Totals and weekly trend from one scan, in one row."""
    return _with_deltas(history.agg(*_totals(), *_weeks(now)))


def delete_history(history: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given ids: chunks go with their record."""
    return (
        history.join(ids.select("id"), "id", "left_anti"),
        chunks.join(ids.select(F.col("id").alias("history_id")), "history_id", "left_anti"),
    )


def chunk_history_join(chunks: DataFrame, history: DataFrame) -> DataFrame:
    h = history.select(F.col("id").alias("history_id"), F.col("file_name").alias("display_name"),
                       F.col("created_at").alias("submitted_at"))
    return chunks.join(h, "history_id")


def corpus_cap(chunks: DataFrame, cap: int, order: str = "chunk_id") -> DataFrame:
    """The newest ``cap`` chunks, as a boundary value instead of a global sort.

    Each partition offers its newest ``cap`` ids; only the lowest id that
    stays is looked up, and the table is then filtered in parallel.
    """
    edge = chunks.select(order).orderBy(F.desc(order)).limit(cap).agg(F.min(order)).scalar()
    return chunks.filter(F.col(order) >= edge)


def latest_detail(history: DataFrame, matches: DataFrame, kind: str = "text", k: int = 3) -> DataFrame:
    """The closest matches of the newest record of a kind."""
    last = filter_history(history, kind).agg(F.max_by("id", F.struct("created_at", "id")).alias("history_id"))
    return (
        matches.join(last, "history_id")
        .orderBy(F.desc("score"), "passage_no").limit(k)
    )
