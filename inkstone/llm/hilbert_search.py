"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are put in order along several Hilbert curves, each over another rotation
and shift of their projection, by a range-partitioned sort. The order is cut into
blocks of fixed size; a query is compared with the blocks up to ``reach`` places
around its own on every curve, and the results are merged and ranked. The reach is
set by measurement: how far the true neighbours of a bounded sample of queries
(found by comparing these with all rows) lie from them. Copies of a vector are
searched once. Blocks bound the memory of a task; nothing grows on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.llm.shared import table
from inkstone.session import materialize

CURVES, DIMS, BITS = 4, 10, 6
BLOCK = 8192
TARGET = 0.97
MEASURED_QUERIES = 256


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of small integers (points x dimensions)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Curves:
    """Projections of the vectors (with one more coordinate that makes inner product a distance) for each curve."""

    longest: float
    centre: np.ndarray
    axes: np.ndarray
    shifts: np.ndarray

    def keys(self, vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Curves x vectors. Queries are scaled to the longest vector's length, which does not change their ranking."""
        norm = np.linalg.norm(vectors, axis=1)
        scaled = vectors * np.where(queries, self.longest / norm, 1.0)[:, None]
        rest = np.where(queries, 0.0, np.sqrt(np.maximum(self.longest**2 - norm**2, 0)))
        points = np.column_stack([scaled, rest]) - self.centre
        out = []
        for axes, shift in zip(self.axes, self.shifts, strict=True):
            unit = 1 / (1 + np.exp(-1.702 * np.clip(points @ axes, -8, 8)))
            cells = np.floor((unit + shift) / 2 * (1 << BITS)).astype(np.int64)
            out.append(hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS))
        return np.stack(out)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _moments(rows: DataFrame, d: int, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all points, from sums per task that Spark adds up."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 2, d + 2))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
                y = np.column_stack([np.ones(len(x)), x, rest])
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

    got = rows.select("vector").mapInArrow(sums, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((d + 2) ** 2)
    for r in got:
        total[r["place"]] = r["value"]
    total = total.reshape(d + 2, d + 2) / max(total[0], 1)
    mean = total[0, 1:]
    return mean, total[1:, 1:] - np.outer(mean, mean)


def fit_curves(rows: DataFrame, d: int, longest: float, seed: int = 5) -> Curves:
    """Principal axes of all points, rotated anew for each curve and scaled to unit spread."""
    rng = np.random.default_rng(seed)
    mean, spread = _moments(rows, d, longest)
    values, vectors = np.linalg.eigh(spread)
    order = np.argsort(-values)
    vectors, values = vectors[:, order], np.maximum(values[order], 0)
    used = max(1, int((values > 1e-12 * max(values[0], 1e-300)).sum()))
    axes = []
    for _ in range(CURVES):
        turn = np.linalg.qr(rng.normal(size=(used, used)))[0][:, :DIMS]
        # neighbours matter in proportion to the spread of an axis, so axes are mixed unscaled
        mixed = vectors[:, :used] @ turn
        deviation = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", mixed, spread, mixed), 1e-24))
        axes.append(mixed / deviation)
    return Curves(longest, mean, np.array(axes), rng.random((CURVES, min(DIMS, used))))


def _usable(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    ).where(F.coalesce(fine, F.lit(False)))
    widths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = widths[0]["d"] if widths else 0
    return rows.where(F.size("vector") == d), d


def _ordered(points: DataFrame, curves: Curves) -> DataFrame:
    """curve, part, kind, node, rank: the number of candidates before a point in its part of a curve. No vector is sorted."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = curves.keys(_matrix(batch.column(2)), batch.column(0).to_numpy() == 1)
                for c in range(len(keys)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(batch.num_rows, c, dtype=np.int32)), pa.array(keys[c]), batch.column(0), batch.column(1)],
                        names=["curve", "key", "kind", "node"],
                    )

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve, candidate = batch.column(0).to_numpy(), (batch.column(2).to_numpy() == 0).astype(np.int64)
            rank = np.zeros(len(curve), dtype=np.int64)
            for c in np.unique(curve):
                mine = np.flatnonzero(curve == c)
                count = np.cumsum(candidate[mine])
                rank[mine] = seen.get(int(c), 0) + count - candidate[mine]
                seen[int(c)] = seen.get(int(c), 0) + int(count[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(curve), part, dtype=np.int32)), batch.column(2), batch.column(3), pa.array(rank)],
                names=["curve", "part", "kind", "node", "rank"],
            )

    spread = points.select("kind", "node", "vector").mapInArrow(keyed, "curve int, key bigint, kind int, node bigint")
    in_order = spread.repartitionByRange("curve", "key", "node", "kind").sortWithinPartitions("curve", "key", "node", "kind")
    return in_order.mapInArrow(ranked, "curve int, part int, kind int, node bigint, rank bigint")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k largest scores of a row, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _compared(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    queries, points = frame[frame["kind"] == 1], frame[frame["kind"] == 0]
    if not len(queries) or not len(points):
        return pd.DataFrame({"query": [], "node": [], "score": []}).astype({"query": "int64", "node": "int64", "score": "float64"})
    x = np.stack(points["vector"].to_numpy()).astype(np.float64)
    ids = points["node"].to_numpy()
    out = []
    for at in range(0, len(queries), 256):
        part = queries.iloc[at : at + 256]
        scores = np.stack(part["vector"].to_numpy()).astype(np.float64) @ x.T
        for q, row in zip(part["node"].to_numpy(), scores, strict=True):
            best = _best(row, ids, k)
            out.append(pd.DataFrame({"query": q, "node": ids[best], "score": row[best]}))
    return pd.concat(out, ignore_index=True)


def _exact(points: DataFrame, queries: list, k: int) -> DataFrame:
    """query, node, score: the true k best of a few queries among all points, best of each task merged."""
    q_ids = np.array([r["node"] for r in queries], dtype=np.int64)
    q = np.array([r["vector"] for r in queries], dtype=np.float64)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores, ids = q @ _matrix(batch.column(1)).T, batch.column(0).to_numpy()
                best = [_best(row, ids, k) for row in scores]
                sizes = [len(b) for b in best]
                flat = np.concatenate(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, sizes)), pa.array(ids[flat]), pa.array(scores[np.repeat(np.arange(len(q)), sizes), flat])],
                    names=["query", "node", "score"],
                )

    found = points.select("node", "vector").mapInArrow(compared, "query bigint, node bigint, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _needed_reach(blocks: DataFrame, truth: DataFrame, target: float) -> int:
    """The number of blocks to each side within which ``target`` of the true neighbours lie on some curve."""
    q = blocks.where("kind = 1").select(F.col("node").alias("query"), "curve", F.col("block").alias("q_block"))
    c = blocks.where("kind = 0").select("node", "curve", "block")
    apart = truth.join(q, "query").join(c, ["node", "curve"]).groupBy("query", "node").agg(F.min(F.abs(F.col("block") - F.col("q_block"))).alias("r"))
    counts = sorted((r["r"], r["count"]) for r in apart.groupBy("r").count().collect())
    total, so_far = sum(n for _, n in counts), 0
    for r, n in counts:
        so_far += n
        if so_far >= target * total:
            return int(r)
    return 0


def nearest(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 20, block: int = BLOCK, target: float = TARGET,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by largest inner product.

    ``queries`` holds the ids (column ``key``) of rows of ``vectors``; a query's own
    row is no candidate. Vectors that are null, zero, hold null or non-finite
    components, or have another length than most, take no part. Ties go to the
    smaller id; repeated ids count once. No usable vector, no rows.
    """
    rows, d = _usable(vectors, key, column)
    copies = Window.partitionBy("vector").orderBy("vec_id")
    members = materialize(
        rows.dropDuplicates(["vec_id"]).withColumn("n", F.row_number().over(copies)).withColumn("node", F.first("vec_id").over(copies)), "members"
    )
    points = members.where("n = 1").select(F.lit(0).alias("kind"), "node", "vector")
    wanted = members.join(queries.select(F.col(key).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").select("vec_id", "node")
    asked = points.join(wanted.select("node").distinct(), "node", "left_semi").select(F.lit(1).alias("kind"), "node", "vector")
    longest = points.agg(F.max(F.aggregate("vector", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x)).alias("m")).first()["m"]
    if longest is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    curves = fit_curves(points, d, math.sqrt(longest))
    placed = materialize(_ordered(points.union(asked), curves), "curves")
    # parts are few: offsets of each part within a curve
    sizes = placed.groupBy("curve", "part").agg(F.sum(1 - F.col("kind")).alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    blocks = materialize(
        placed.join(offsets, ["curve", "part"]).select("curve", "kind", "node", F.expr(f"(offset + rank) div {block}").alias("block")), "blocks"
    )
    few = asked.orderBy(F.xxhash64("node"), "node").limit(MEASURED_QUERIES).collect()
    reach = _needed_reach(blocks, _exact(points, few, k + 1).select("query", "node"), target) if few else 0
    last = blocks.where("kind = 0").groupBy("curve").agg(F.max("block").alias("last"))
    around = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("block") - reach), F.least(F.col("last"), F.col("block") + reach)))
    asking = blocks.where("kind = 1").join(last, "curve").withColumn("block", F.least("block", "last"))
    placed_all = blocks.where("kind = 0").unionByName(asking.select("curve", "kind", "node", around.alias("block")))
    found = placed_all.join(points.select("node", "vector"), "node").select("curve", "block", "kind", "node", "vector").groupBy("curve", "block").applyInPandas(
        lambda frame: _compared(frame, k + 1), "query bigint, node bigint, score double"
    )
    merged = found.groupBy("query", "node").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    short = merged.withColumn("place", place).where(F.col("place") <= k + 1).select("query", "node", "score")
    # back from vectors to rows: the first copies of each vector, without the query itself
    some = members.where(F.col("n") <= k + 1).select("node", "vec_id")
    asks = wanted.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    pairs = asks.join(short, "query").join(some, "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.select("vec_id").where(F.col("vec_id") % 20 == 0))


QUERIES = {"op5_hilbert_search": op5_hilbert_search}
