"""Connected components of a large graph by contraction, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: bigint); root is the least node of the component.

    Each round every node points to the first of itself and its neighbours, pointers
    are followed once more, and edges are rewritten to pointers; those within one
    pointer vanish. First is, in turns, by id, which folds the stars of least nodes at
    once, and by a hash drawn anew, which folds any chain, in order of ids or not, to a
    share of its length: rounds grow with the logarithm of the number of nodes, and the
    last node of a component by the order at hand always goes, so they end. Minima are
    combined before the shuffle, so a node with very many neighbours is no burden. No
    edge list or component is collected; each round is written to the shared folder.
    """
    left = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    roots, turn = None, 0
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", _order("b", turn)).alias("m"))
        near = near.select("node", F.when(_order("m", turn) < _order("node", turn), F.col("m")).otherwise(F.col("node")).alias("p"))
        near = materialize(near, "pointers")
        further = near.select(F.col("node").alias("p"), F.col("p").alias("q"))
        point = materialize(near.join(further, "p", "left").select("node", F.coalesce("q", "p").alias("p")), "pointers")
        roots = point.select("node", F.col("p").alias("root")) if roots is None else _followed(roots, point)
        roots = materialize(roots, "roots")
        a, b = point.select(F.col("node").alias("a"), F.col("p").alias("pa")), point.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        left = materialize(
            left.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges"
        )
        turn += 1
    if roots is None:
        return edges.sparkSession.createDataFrame([], "node bigint, root bigint")
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").select("node", F.least("root", "least").alias("root"))


def _order(node: str, turn: int) -> Column:
    """By id in even turns, else by a hash of the turn and the id (of one turn, no two ids share it)."""
    return F.xxhash64(F.lit(turn), F.col(node)) if turn % 2 else F.col(node)


def _followed(roots: DataFrame, point: DataFrame) -> DataFrame:
    step = point.select(F.col("node").alias("root"), F.col("p").alias("next"))
    return roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
