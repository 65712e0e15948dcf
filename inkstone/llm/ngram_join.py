"""Join of documents whose sets of word n-grams are similar (Jaccard), by MinHash banding.

Texts with equal n-gram sets are one node with a weight. A node's bands are hashed
and shuffled; nodes that share a band hash are candidates, and each such bucket adds
only edges to its least node. Candidates that hang together are verified on their
full n-gram sets, block against block, each pair of blocks in one task of bounded
size: no pair is shuffled, and no link of a bucket is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.components import components
from inkstone.llm.shared import release_memory, table
from inkstone.llm.word_hashes import gram_hashes, mix, to_bytes, word_hashes
from inkstone.session import materialize

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 256
BLOCK = 192


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows per band: the longest rows (fewest false candidates) that still
    find a pair at the threshold with probability ``recall`` within ``max_hashes``."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def ngram_set(data: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct n-gram hashes; a text of fewer than n words is one n-gram of all its words."""
    words = word_hashes(data)
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else words


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of the set's MinHash signature, in slices of the set so that memory stays bounded."""
    k = bands * rows
    odd = (np.random.default_rng(77).integers(0, 2**63, k, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    least = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048]
        for s in range(0, k, 64):
            h = part[None, :] * odd[s : s + 64, None]
            least[s : s + 64] = np.minimum(least[s : s + 64], (h ^ (h >> np.uint64(32))).min(axis=1))
    h = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for r in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + least.reshape(bands, rows)[:, r])
    return h


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release_memory()
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                keys, sizes, hashes = [], [], []
                for text in some.column(1):
                    grams = ngram_set(to_bytes(text.as_py()), n)
                    keys.append(hashlib.md5(grams.tobytes()).hexdigest() if len(grams) else None)
                    sizes.append(len(grams))
                    hashes.append(band_hashes(grams, bands, rows).view(np.int64) if len(grams) else None)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(keys, type=pa.string()), pa.array(sizes, type=pa.int64()), pa.array(hashes, type=pa.list_(pa.int64()))],
                    names=["doc_id", "same", "n_grams", "bands"],
                )

    return docs.mapInArrow(signed, "doc_id bigint, same string, n_grams bigint, bands array<bigint>")


def _gram_rows(texts: DataFrame, n: int) -> DataFrame:
    """node, group, blocks, weight and the full n-gram set, once for each pair of blocks that the node's block is in."""
    fields = "node bigint, root bigint, low int, high int, block int, weight bigint, grams binary"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                node, root, blocks, block, weight, text = (batch.column(k)[i].as_py() for k in range(6))
                other = np.arange(blocks, dtype=np.int32)
                for at in range(0, blocks, 500):
                    part = other[at : at + 500]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([node] * len(part), pa.int64()), pa.array([root] * len(part), pa.int64()),
                            pa.array(np.minimum(part, block).astype(np.int32)), pa.array(np.maximum(part, block).astype(np.int32)), pa.array([block] * len(part), pa.int32()),
                            pa.array([weight] * len(part), pa.int64()), pa.array([ngram_set(to_bytes(text), n).tobytes()] * len(part), pa.binary()),
                        ],
                        names=["node", "root", "low", "high", "block", "weight", "grams"],
                    )

    return texts.select("node", "root", "blocks", "block", "weight", "text").mapInArrow(spread, fields)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Number of common elements of each set in ``left`` with each in ``right``, by products of slices of indicator matrices."""
    sizes = [len(x) for x in left + right]
    flat = np.concatenate(left + right) if sizes else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    distinct, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    use = often[place]
    owner, column = owner[use], number[place[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(often.sum()), columns):
        a, b = np.searchsorted(column, [at, at + columns])
        table_ = np.zeros((len(sizes), columns), dtype=np.float32)
        table_[owner[a:b], column[a:b] - at] = 1
        out += table_[: len(left)] @ table_[len(left) :].T
    return out


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """For each pair of blocks: weighted links of each node, and edges that hold the linked nodes together."""

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        frame = frame.drop_duplicates(["node", "block", "grams"]).sort_values("node", ignore_index=True)
        a, b = frame[frame["block"] == low], frame[frame["block"] == high]
        sets_a, sets_b = ([np.frombuffer(x, dtype=np.uint64) for x in f["grams"]] for f in (a, b))
        na, nb = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
        if not len(na) or not len(nb):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        common = shared_counts(sets_a, sets_b).astype(np.float64)
        union = na[:, None] + nb[None, :] - common
        linked = common >= threshold * union - 1e-9
        ids_a, ids_b = a["node"].to_numpy(), b["node"].to_numpy()
        linked &= ids_a[:, None] != ids_b[None, :]
        nodes = [ids_a] + ([ids_b] if low != high else [])
        links = [linked @ b["weight"].to_numpy()] + ([linked.T @ a["weight"].to_numpy()] if low != high else [])
        chain = _chain(linked, ids_a, ids_b)
        return pd.DataFrame(
            {
                "a": np.concatenate([*nodes, chain[:, 0]]), "b": np.concatenate([*nodes, chain[:, 1]]),
                "links": np.concatenate([*links, np.zeros(len(chain), dtype=np.int64)]),
            }
        ).astype("int64")

    return rows.groupBy("root", "low", "high").applyInPandas(verify, "a bigint, b bigint, links bigint")


def _chain(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
    """Few edges with the same connected components as ``linked``: union-find over its true cells."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in np.flatnonzero(linked.any(axis=1)):
        for j in np.flatnonzero(linked[i]):
            x, y = top(int(ids_a[i])), top(int(ids_b[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(ids_a[i]), int(ids_b[j])))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def similar_documents(
    docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, block: int = BLOCK,
) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs``.

    Two documents are linked where their sets of word n-grams have a Jaccard
    similarity of at least ``threshold``; ``class_id`` is the least doc_id among
    all that links lead to, ``n_links`` the number of other documents linked.
    Null, empty and blank texts have no n-grams, link to nothing and are their own
    class. Rows with a null doc_id have a null class and no links. Rows that share a
    doc_id are one document with several texts.

    Every pair that shares a band is verified on whole sets; a pair at the threshold
    shares one with probability ``recall``, a closer one with more.
    """
    bands, rows = band_plan(threshold, recall, max_hashes)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(_signatures(read, n, bands, rows), "signatures")
    usable = signed.where(F.col("same").isNotNull() & F.col("doc_id").isNotNull())
    same = materialize(usable.groupBy("same").agg(F.min("doc_id").alias("node"), F.count_distinct("doc_id").alias("weight")), "same")
    first = usable.join(same.select("same", F.col("node").alias("doc_id")), ["same", "doc_id"], "left_semi").dropDuplicates(["same", "doc_id"])
    banded = first.select(F.col("doc_id").alias("node"), F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    near = banded.join(buckets.select("band", "hash", "a"), ["band", "hash"]).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    # rows that share a doc_id but not a set: their sets hang together by the id
    shared_id = usable.join(same, "same").where("doc_id <> node").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    near = near.union(shared_id.select("a", F.col("z").alias("b")))
    groups = materialize(components(near), "groups")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")).select("root", F.ceil(F.col("size") / F.lit(block)).cast("int").alias("blocks"))
    placed = groups.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    weights = same.groupBy("node").agg(F.sum("weight").alias("weight"))
    wanted = materialize(placed.join(weights, "node"), "wanted")
    texts = read.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id").withColumnRenamed("doc_id", "node")
    checked = materialize(_verified(_gram_rows(texts, n), threshold), "verified")
    links = checked.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(checked.where("a <> b").select("a", "b").union(shared_id.select("a", F.col("z").alias("b"))))
    found = same.join(links, "node", "left").join(classes, "node", "left").select(
        "same", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links")
    )
    joined = signed.select("doc_id", "same").join(found, "same", "left")
    alone = F.coalesce("class_id", "doc_id")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), alone).alias("class_id"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_ngram_join": op4_ngram_join}
