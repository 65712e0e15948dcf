"""Hard negatives for contrastive training, from exact inner products by subset-sum tables.

Components become whole numbers. A candidate is kept as bit planes: for every bit of
its components (two's complement) and every group of eight dimensions, one byte with
that bit of the eight components. For an anchor and a group of eight dimensions a
table holds the sum of the anchor's components over each of the 256 subsets; a
candidate's byte picks the sum of the components whose bit is set. Looked-up sums are
added over the groups and shifted over the planes into the full inner product.

Anchors and candidates are cut into blocks, and a task scores one block of anchors
against one of candidates: first rows of the anchor's own label, whose best are its
positives, then rows of other labels inside the window of each positive. Only the few
best rows of a pair of blocks leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.llm.shared import table
from inkstone.session import materialize

SCALE = 256
GROUP = 8
#: Bounds of a block, which bound the memory of a task and do not change results.
ANCHORS, CANDIDATES, LEAST_CANDIDATES = 4096, 65_536, 1024
#: Anchors and candidates of one step inside a task: tables and sums stay in the processor's cache.
STEP_ANCHORS, STEP_CANDIDATES = 64, 4096


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Groups x 256 x anchors: the sum over each subset of every eight components, each from a smaller subset's."""
    n, d = anchors.shape
    eight = np.zeros((n, -(-d // GROUP) * GROUP), dtype=anchors.dtype)
    eight[:, :d] = anchors
    parts = eight.reshape(n, -1, GROUP)
    sums = np.zeros((parts.shape[1], 1 << GROUP, n), dtype=anchors.dtype)
    for bit in range(GROUP):
        sums[:, 1 << bit : 2 << bit] = sums[:, : 1 << bit] + parts[:, :, bit].T[:, None, :]
    return sums


def bit_planes(vectors: np.ndarray, planes: int) -> np.ndarray:
    """Rows x planes x groups of bytes, lowest bit first; the last plane is the sign."""
    n, d = vectors.shape
    bits = (vectors[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").reshape(n, planes, -(-d // GROUP))


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Candidates x anchors: exact inner products, from the sign plane down, each plane shifting what is above it."""
    total = np.zeros((len(planes), sums.shape[2]), dtype=sums.dtype)
    found = np.empty_like(total)
    sign = planes.shape[1] - 1
    for plane in range(sign, -1, -1):
        total <<= 1
        for group in range(planes.shape[2]):
            np.take(sums[group], planes[:, plane, group], axis=0, out=found, mode="clip")
            (np.subtract if plane == sign else np.add)(total, found, out=total)
    return total


def _scored(anchors: np.ndarray, planes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First anchor of a step, and the step's anchors x all candidates."""
    for at in range(0, len(anchors), STEP_ANCHORS):
        sums = subset_sums(anchors[at : at + STEP_ANCHORS])
        parts = [scores(sums, planes[a : a + STEP_CANDIDATES]) for a in range(0, len(planes), STEP_CANDIDATES)]
        yield at, np.ascontiguousarray(np.concatenate(parts).T)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _bytes(column: pa.ChunkedArray, dtype: str, width: int) -> np.ndarray:
    values = b"".join(column.to_pylist())
    return np.frombuffer(values, dtype=dtype).reshape(len(column), width)


def _cut(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """``rows`` dealt evenly to numbered blocks; equal rows are dealt like all others."""
    return rows.repartition(blocks).withColumn(name, F.spark_partition_id().cast("long"))


def _table(found: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate([x[k] for x in found]) if found else np.zeros(0) for k in range(len(names))]
    return pa.table({name: pa.array(column.astype(np.int64)) for name, column in zip(names, columns, strict=True)})


def whole_vectors(vectors: DataFrame, key: str, column: str, label: Column, anchors: Column) -> tuple[DataFrame, int, int]:
    """vec_id, label, anchor, vector (array of long) of the rows that take part, their dimensions, and the bits of a component."""
    exact = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = F.forall(exact, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(fine & F.col(key).isNotNull() & label.isNotNull(), F.lit(False))).select(
        F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.transform(exact, lambda x: F.floor(x * SCALE)).alias("vector"), F.array_max(F.transform(exact, lambda x: F.abs(x))).alias("largest"),
    )
    widths = rows.where("size(vector) > 0").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = widths[0]["d"] if widths else 0
    # products of two components, summed over all dimensions, fit 63 bits
    rows = rows.where((F.size("vector") == d) & (F.col("largest") < 2.0 ** ((62 - d.bit_length()) // 2) / SCALE)).drop("largest")
    ends = rows.agg(F.min(F.array_min("vector")).alias("least"), F.max(F.array_max("vector")).alias("most")).first()
    size = max((x if x >= 0 else -x - 1 for x in ends if x is not None), default=0)
    return rows, d, size.bit_length() + 1


def _packed(rows: DataFrame, d: int, bits: int) -> DataFrame:
    """vec_id, label, anchor, row (a number of its own), planes, and for anchors vector, both as bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            whole = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, d)
            planes = [x.tobytes() for x in bit_planes(whole, bits)]
            own = [x.tobytes() if asks else None for x, asks in zip(whole, batch.column(2).to_pylist(), strict=True)]
            row = pa.array(np.arange(at, at + len(whole)))
            at += len(whole)
            columns = [batch.column(0), batch.column(1), batch.column(2), row, pa.array(planes, pa.binary()), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "anchor", "row", "planes", "vector"])

    schema = "vec_id long, label long, anchor boolean, row long, planes binary, vector binary"
    return rows.select("vec_id", "label", "anchor", "vector").mapInArrow(packed, schema)


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column, key: str = "vec_id", column: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on ``vectors`` that picks the anchors, ``label`` the
    label of a row. An anchor's positives are its best other rows of its label; for
    each, the best rows of other labels whose score is from ``low`` to ``high``
    percent of the positive's are returned, ties to smaller ids. A pair without such
    rows has no result, which holds for all pairs with a negative positive score.

    Rows without an id or label, without a vector, or with a null, NaN or infinite
    component take no part, nor do vectors that are empty or of another length than
    most, or whose products might not fit 64 bits (for 64 dimensions, components of
    about 500,000). Rows that share an id are rows of their own, each an anchor if the
    condition holds. Empty tables give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, d, bits = whole_vectors(vectors, key, column, label, anchors)
    if not d:
        return spark.createDataFrame([], out)
    groups = -(-d // GROUP)
    packed = materialize(_packed(rows, d, bits), "planes")
    n, n_anchors = packed.agg(F.count("*"), F.count("vector")).first()
    if not n_anchors:
        return spark.createDataFrame([], out)
    cores = spark.sparkContext.defaultParallelism
    n_blocks = max(-(-n // CANDIDATES), min(2 * cores, -(-n // LEAST_CANDIDATES)))
    blocks = -(-n_anchors // ANCHORS)
    candidates = materialize(_cut(packed.select("vec_id", "label", "row", "planes"), n_blocks, "block"), "candidates")
    asked = materialize(_cut(packed.where("anchor").select("vec_id", "label", "row", "vector"), blocks, "part"), "anchors")
    largest = 8 * groups * (1 << 2 * bits)
    kind = np.int32 if largest < 2**31 else np.int64
    everywhere = candidates.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    all_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))

    def pairs(asking: DataFrame, work, schema: str) -> DataFrame:  # noqa: ANN001
        both = asking.withColumn("block", all_blocks).groupBy("part", "block").cogroup(everywhere.groupBy("part", "block"))
        return both.applyInArrow(work, schema)

    def unpacked(left: pa.Table, right: pa.Table):  # noqa: ANN202
        a = _bytes(left["vector"], "<i8", d).astype(kind)
        planes = _bytes(right["planes"], "u1", bits * groups).reshape(-1, bits, groups)
        return a, left["label"].to_numpy(), left["row"].to_numpy(), planes, right["label"].to_numpy(), right["row"].to_numpy(), right["vec_id"].to_numpy()

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            a, a_label, a_row, planes, label_, row, ids = unpacked(left, right)
            for value in np.unique(a_label):
                mine, own = np.flatnonzero(a_label == value), np.flatnonzero(label_ == value)
                if not len(own):
                    continue
                for at, part in _scored(a[mine], planes[own]):
                    for i, score in enumerate(part):
                        anchor = mine[at + i]
                        best = _first(score, ids[own], positives + 1)
                        best = best[row[own[best]] != a_row[anchor]][:positives]
                        found.append((np.full(len(best), a_row[anchor]), ids[own[best]], row[own[best]], score[best]))
        return _table(found, ["anchor", "vec_id", "row", "score"])

    def other_labels(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            a, a_label, a_row, planes, label_, _, ids = unpacked(left, right)
            wanted = left["scores"].to_pylist()
            for at, part in _scored(a, planes):
                for i, score in enumerate(part):
                    anchor = at + i
                    tops = wanted[anchor]
                    # windows of whole numbers: low * top <= 100 * score <= high * top
                    edges = [(-(-low * t // 100), high * t // 100) for t in tops]
                    some = np.flatnonzero((score >= min(e[0] for e in edges)) & (score <= max(e[1] for e in edges)) & (label_ != a_label[anchor]))
                    if not len(some):
                        continue
                    some = some[np.lexsort((ids[some], -score[some].astype(np.int64)))]
                    falling = -score[some].astype(np.int64)
                    for top, (least, most) in zip(tops, edges, strict=True):
                        lo, hi = np.searchsorted(falling, -most), np.searchsorted(falling, -least, side="right")
                        best = some[lo : min(hi, lo + negatives)]
                        if len(best):
                            found.append((np.full(len(best), a_row[anchor]), np.full(len(best), top), ids[best], score[best]))
        return _table(found, ["anchor", "positive_score", "vec_id", "score"])

    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row"))
    near = pairs(asked, same_label, "anchor long, vec_id long, row long, score long").withColumn("place", place).where(F.col("place") <= positives)
    near = materialize(near.drop("place"), "positives")
    tops = near.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_set("score")).alias("scores"))
    asking = asked.join(tops, "row")
    place = F.row_number().over(Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "vec_id"))
    far = pairs(asking, other_labels, "anchor long, positive_score long, vec_id long, score long").withColumn("rank", place).where(F.col("rank") <= negatives)
    named = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    found = named.join(far.select("anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "positive_score"])
    return found.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}

ORACLE_SQL = {
    "op12_hard_negatives": """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label AS own, b.r, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT * FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id, n.r)::INT AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor = p.anchor AND n.label <> n.own AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
""",
}
