"""Best-fit packing of documents into sequences of bounded length.

Documents are tokenised where they are read; only (id, piece, length, checksum)
rows are shuffled, to shards of bounded size by a hash that no key can make
uneven. Each shard is packed online by best fit with a fixed number of open bins,
kept in a bitset keyed by free space; if all are open, the fullest closes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.shared import release_memory, table, text_of
from inkstone.llm.token_cache import word_cache

CAPACITY = 4096
OPEN_BINS = 8192
SHARD_PIECES = 16_384


class OpenBins:
    """At most ``limit`` open bins; ``put`` gives the bin and the offset in it for a piece of some length."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit, self.made, self.open = capacity, limit, 0, 0
        self.spaces, self.by_space = 0, [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        found = self.by_space[space].pop()
        if not self.by_space[space]:
            self.spaces &= ~(1 << space)
        self.open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            chosen, space, self.made = self.made, self.capacity, self.made + 1
        left = space - length
        if left:
            self.by_space[left].append(chosen)
            self.spaces |= 1 << left
            self.open += 1
        return chosen, self.capacity - space


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset for each length, in the order given; pieces of full length get a bin each."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    part = np.flatnonzero(lengths < capacity)
    state = OpenBins(capacity, open_bins)
    for i, length in zip(part.tolist(), lengths[part].tolist(), strict=True):
        bins[i], offsets[i] = state.put(length)
    full = np.flatnonzero(lengths >= capacity)
    bins[full] = state.made + np.arange(len(full))
    return bins, offsets


def _piece_batch(ids: list, encoded: list[bytes], end: bytes, capacity: int) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
    for doc_id, own in zip(ids, encoded, strict=True):
        own += end
        for k, at in enumerate(range(0, len(own), 4 * capacity)):
            data = own[at : at + 4 * capacity]
            for name, value in zip(out, (doc_id, k, k * capacity, len(data) // 4, zlib.crc32(data)), strict=True):
                out[name].append(value)
    return out


def token_pieces(docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null and empty texts have one piece, the end id."""
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint"
    types = [pa.int32() if x == "piece" else pa.int64() for x in ("piece", "start", "length", "ids_crc32")]
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path, kind)
        for batch in batches:
            release_memory()
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                out = _piece_batch(some.column(0).to_pylist(), list(cache.encode(some.column(1).to_pylist())), end, capacity)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_id"], type=batch.schema.field(0).type)]
                    + [pa.array(out[n], type=t) for n, t in zip(list(out)[1:], types, strict=True)],
                    names=list(out),
                )
        batch = some = out = None
        release_memory()  # an idle worker keeps the cache alone

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, schema)


def pack_documents(
    docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS, shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; offsets in a sequence are gapless from 0.

    Only documents of more than ``capacity`` ids are cut. Shards have
    ``shard_pieces`` pieces on average (documents and characters give an upper
    bound of the pieces) and take them longest first. Repeated rows are packed as
    often as they occur; an empty table gives no rows.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    shards = max(1, math.ceil((size["n"] + (size["chars"] or 0) / capacity) / shard_pieces))
    pieces = token_pieces(docs, path, kind, end_id, capacity)
    keyed = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = pack_lengths(frame["length"].to_numpy(), capacity, open_bins)
        return frame.assign(sequence_id=frame["shard"] * (1 << 32) + bins, offset=offsets).drop(columns="shard")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return keyed.groupBy("shard").applyInPandas(packed, f"{fields}, sequence_id bigint, offset bigint")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
