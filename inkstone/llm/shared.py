"""Helpers that several corpus operators use."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters that are neither blank nor tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def running_starts(sizes: Column, block: int = 256) -> Column:
    """Sum of the elements before each one, for an array of numbers.

    Two levels of blocks, so that the cost per element does not grow with the array.
    """

    def grow(acc: Column, x: Column) -> Column:
        return F.array_append(acc, F.element_at(acc, -1) + x)

    def from_offsets(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
        offsets = F.aggregate(totals, F.array(F.lit(0).cast("long")), grow)
        return F.flatten(
            F.zip_with(
                blocks, F.slice(offsets, F.lit(1), F.size(blocks)),
                lambda b, o: F.slice(F.aggregate(b, F.array(o), grow), F.lit(1), F.size(b)),
            )
        )

    longs = F.transform(sizes, lambda x: x.cast("long"))
    last = F.floor((F.size(sizes) - 1) / F.lit(block)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(longs, i * block + 1, F.lit(block)))
    return F.when(F.size(sizes) == 0, F.array().cast("array<long>")).otherwise(bind(blocks, from_offsets))


def bounded_sample(rows: DataFrame, group: str, keys: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows of each value of ``group``, by the hash of ``keys``, numbered by ``place`` from 1.

    Counts by value come first (``group`` must have few values); then only rows
    with a small hash, about twice as many as wanted, are ranked.
    """
    rank = F.xxhash64(*keys).bitwiseAND(F.lit(2**63 - 1))
    share = F.lit(2**63 - 1)
    for found in rows.groupBy(group).count().collect():
        if found["count"] > 2 * limit + 1000:
            share = F.when(F.col(group) == found[group], F.lit(int((2 * limit + 1000) / found["count"] * (2**63 - 1)))).otherwise(share)
    place = F.row_number().over(Window.partitionBy(group).orderBy(rank, *keys))
    return rows.where(rank <= share).withColumn("place", place).where(F.col("place") <= limit)


def kept_in_process(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gave the first time in this Python process.

    Functions travel to tasks by value, so a global of theirs ends with the task;
    a module in ``sys.modules`` lasts as long as the reused worker.
    """
    store = sys.modules.setdefault("_inkstone_kept", types.ModuleType("_inkstone_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def drop_kept() -> None:
    """Forget what other tasks have kept in this reused worker (``kept_in_process``), and give its memory back."""
    if sys.modules.pop("_inkstone_kept", None) is not None:
        gc.collect()
        release_memory()


def release_memory() -> None:
    """Give memory that a batch has freed back to the system, Arrow's too; reused workers would keep it. Without glibc only Arrow's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return
