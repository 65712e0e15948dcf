"""Supplied dense vectors: best match and separation of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SLACK = 1e-6
DIGITS = 9
#: Scores of a block that exist at once; rows (query, block) that a task hands on at once.
SCORES_AT_ONCE, TARGETS_AT_ONCE = 1_000_000, 20_000


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def _angles(vectors, pivots):
    import numpy as np

    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def _to_cells(df: DataFrame, pivots) -> DataFrame:
    """Nearest pivot of every vector and the angle to it."""

    def run(batches):
        for b in batches:
            if len(b):
                a = _angles(b["embedding"], pivots)
                yield b.assign(cell=a.argmin(axis=1).astype("int32"), angle=a.min(axis=1))

    return df.select("vec_id", "embedding").mapInPandas(
        run, "vec_id long, embedding array<float>, cell int, angle double"
    )


def _best_of_block(q_ids, q, c_ids, c, k: int, skip_self: bool):
    """(query row, candidate row, score) of the best ``k`` of each query; ``c_ids`` ascend, so ties go to the smaller id."""
    import numpy as np

    s = np.round(q @ c.T, DIGITS)
    if skip_self:
        s[q_ids[:, None] == c_ids[None, :]] = -np.inf
    if k < s.shape[1]:
        kth = np.partition(s, -k, axis=1)[:, -k][:, None]
        above, tie = s > kth, s == kth
        keep = above | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - above.sum(axis=1)[:, None]))
    else:
        keep = np.ones(s.shape, bool)
    row, col = np.nonzero(keep & np.isfinite(s))
    return row, col, s[row, col]


def _scan(targets: DataFrame, members: DataFrame, k: int, batch_rows: int, n_queries: int, n_blocks: int, skip_self: bool) -> DataFrame:
    """Best ``k`` of each (query, block) in ``targets``: vec_id, embedding, cell, salt.

    ``members``: the same columns of the corpus. Rows come sorted by block, candidates
    first: a task holds one block and multiplies the queries with it some at a time, so
    neither a table of pairs nor a row of many vectors exists. Queries of one block are
    dealt to parts where there are many.
    """
    cores = targets.sparkSession.sparkContext.defaultParallelism
    n_parts = max(1, -(-n_queries // (16 * batch_rows)), -(-2 * cores // max(1, n_blocks)))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(n_parts)).cast("int").alias("part")
    q = targets.select("cell", "salt", part, F.lit(1).alias("kind"), "vec_id", "embedding")
    c = members.select("cell", "salt", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), F.lit(0).alias("kind"), "vec_id", "embedding")
    place = ["cell", "salt", "part"]
    dealt = q.unionByName(c).repartition(max(cores, min(n_blocks * n_parts, 16 * cores)), *place).sortWithinPartitions(*place, "kind")

    def nearest(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at, held, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            where = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            kind, ids = b.column(3).to_numpy(), b.column(4).to_numpy()
            vectors = pc.list_flatten(b.column(5)).to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1) | (kind[1:] != kind[:-1])) + 1).tolist(), len(ids)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if at != tuple(where[x]):
                    at, held, block = tuple(where[x]), [], None
                if kind[x] == 0:
                    held.append((ids[x:y], vectors[x:y].astype(np.float64)))
                    continue
                if not held:
                    continue
                if block is None:
                    own, m = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    order = np.argsort(own, kind="stable")
                    block = own[order], m[order]
                step = max(1, SCORES_AT_ONCE // len(block[0]))
                for i in range(x, y, step):
                    j = min(i + step, y)
                    row, col, score = _best_of_block(ids[i:j], vectors[i:j].astype(np.float64), *block, k, skip_self)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row]), pa.array(block[0][col]), pa.array(score)], names=["vec_id", "match_id", "score"])

    return dealt.mapInArrow(nearest, "vec_id long, match_id long, score double")


def vector_cosine_topk(
    queries: DataFrame, corpus: DataFrame, k: int = 1, exclude_same_id: bool = True,
    cells: int = 64, block_rows: int = 4096,
) -> DataFrame:
    """The ``k`` nearest corpus vectors of every query vector, exact.

    Both sides: vec_id, embedding (unit length). A fixed number of corpus
    vectors serve as pivots. By the triangle inequality no member of a cell
    can have a cosine above cos(angle to its pivot - radius of the cell), so
    after a first look into its own cell a query visits only the cells that
    could still beat what it has. A cell with many vectors is split into
    blocks of bounded size.
    """
    import numpy as np

    spark = queries.sparkSession
    picked = corpus.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).select("embedding").collect()
    pivots = np.stack([np.asarray(r[0], dtype=np.float64) for r in picked])

    members = materialize(_to_cells(corpus, pivots), "cells")
    facts = members.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
    radius = np.full(len(pivots), -1.0)
    parts = np.zeros(len(pivots), dtype=int)
    for f in facts:  # at most `cells` rows
        radius[f.cell], parts[f.cell] = f.radius, max(1, -(-f.n // block_rows))
    n_parts = F.element_at(F.array(*[F.lit(int(max(p, 1))) for p in parts]), F.col("cell") + 1)
    members = members.select("vec_id", "embedding", "cell", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int").alias("salt"))
    n_blocks = int(parts.sum())
    n_queries = queries.count()

    own = _to_cells(queries, pivots).select("vec_id", "embedding", "cell", F.lit(0).alias("salt"))
    first = _scan(own, members.filter("salt = 0"), k, block_rows, n_queries, len(pivots), exclude_same_id)
    have = first.groupBy("vec_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).select(
        "vec_id", F.when(F.col("n") >= k, F.col("kth")).otherwise(-2.0).alias("have")
    )

    def promising(batches):
        import pandas as pd

        step = max(1, TARGETS_AT_ONCE // max(1, n_blocks))
        for b in (whole.iloc[i : i + step] for whole in batches for i in range(0, len(whole), step)):
            a = _angles(b["embedding"], pivots)
            bound = np.where(radius[None, :] < 0, -3.0, np.cos(np.maximum(a - radius[None, :], 0.0)))
            row, cell = np.nonzero(bound >= b["have"].to_numpy()[:, None] - SLACK)
            times = parts[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            salt = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, dtype=int)
            yield pd.DataFrame({
                "vec_id": b["vec_id"].to_numpy()[row], "embedding": b["embedding"].to_numpy()[row],
                "cell": cell.astype("int32"), "salt": salt.astype("int32"),
            })

    targets = (
        queries.select("vec_id", "embedding").join(have, "vec_id", "left")
        .withColumn("have", F.coalesce("have", F.lit(-2.0)))
        .mapInPandas(promising, "vec_id long, embedding array<float>, cell int, salt int")
    )
    near = _scan(targets, members, k, block_rows, n_queries, n_blocks, exclude_same_id)
    w = Window.partitionBy("vec_id").orderBy(F.desc("score"), "match_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def embedding_separation(scores: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Weakest copy against strongest clean pair per model.

    ``scores``: model, category ('copy' or 'clean'), score.
    """
    copy, clean = F.col("category") == "copy", F.col("category") == "clean"
    return scores.groupBy("model").agg(
        F.min(F.when(copy, F.col("score"))).alias("weakest_copy"),
        F.max(F.when(clean, F.col("score"))).alias("strongest_clean"),
        (F.min(F.when(copy, F.col("score"))) - F.max(F.when(clean, F.col("score")))).alias("margin"),
        F.avg((F.col("score") >= threshold).cast("double")).alias("share_at_threshold"),
    )
