"""Figures derived from chart points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def share_of_total(points: DataFrame, chart: str = "chart", value: str = "value") -> DataFrame:
    """Each value over the sum of its chart; the sums are joined back, one row per chart."""
    total = points.groupBy(chart).agg(F.sum(value).alias("total"))
    return points.join(total, chart).withColumn("share", F.col(value) / F.nullif(F.col("total"), F.lit(0.0))).drop("total")
