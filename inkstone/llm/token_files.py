"""Token ids in binary segments, coded by Simple-8b.

Format of a segment (little-endian): ``S8B1``; uint32 documents, blocks, ids per
block; uint64 ids; int64 doc_id of each document; uint32 ids of each document;
uint32 first word of each block, and one more with the number of words; the words,
uint64. Blocks hold a fixed number of ids (the last one fewer) and no word spans
two blocks. A segment with null doc_ids starts with ``S8B2`` and has, after the
doc_ids, a bit for each document in whole bytes, set where its doc_id is null. A word's low 4 bits select how many ids of how many bits follow;
selector 0 is the escape for one id too wide to share a word.

Segments of about 400,000 ids are rows (part, seq, n_docs, n_ids, segment) of
files that Spark's own writer commits, so any store works and a lost task leaves
nothing behind; parts are ranges of doc_id and text, seq counts within a part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.llm.shared import release_memory, table, text_of
from inkstone.llm.token_cache import word_cache
from inkstone.session import scratch_dir

#: ids per word and bits per id, by selector; selector 0 is the escape.
SELECTORS = ((1, 60), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
BLOCK_IDS = 1024
SEGMENT_IDS = 400_000
MAGIC, MAGIC_NULLS = b"S8B1", b"S8B2"
#: Characters of a text that part rows of one doc_id into ranges.
RANGE_CHARS = 64


def encode_ids(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Words and the first word of each block (with the number of words at the end); all blocks advance together."""
    n = len(ids)
    ids = ids.astype(np.uint64)
    if n and int(ids.max()) >> 60:
        raise ValueError("an id of more than 60 bits")
    starts = np.arange(0, n, block)
    stops = np.minimum(starts + block, n)
    chosen = np.zeros(n, dtype=np.int8)
    room = np.repeat(stops, stops - starts) - np.arange(n)
    bits = np.zeros(n, dtype=np.int8)
    for b in range(60):
        more = ids >> np.uint64(b) != 0
        if not more.any():
            break
        bits += more
    for s in sorted(range(1, len(SELECTORS)), key=lambda s: SELECTORS[s][0]):
        count, width = SELECTORS[s]
        wide = np.concatenate([[0], np.cumsum(bits > width)])
        last = np.minimum(np.arange(n) + count, n)
        chosen[(wide[last] == wide[:-1]) & (room >= count)] = s
    takes = np.array([c for c, _ in SELECTORS])[chosen]
    at, places = starts.copy(), []
    live = np.arange(len(starts))
    while len(live):
        places.append(np.stack([live, at[live]]))
        at[live] += takes[at[live]]
        live = live[at[live] < stops[live]]
    if not places:
        return np.zeros(0, dtype="<u8"), np.zeros(1, dtype="<u4")
    both = np.concatenate(places, axis=1)
    both = both[:, np.argsort(both[1], kind="stable")]
    position, selector = both[1], chosen[both[1]]
    words = selector.astype(np.uint64)
    for s in np.unique(selector):
        count, width = SELECTORS[s]
        mine = np.flatnonzero(selector == s)
        values = ids[position[mine][:, None] + np.arange(count)]
        words[mine] |= np.bitwise_or.reduce(values << (np.uint64(4) + np.uint64(width) * np.arange(count, dtype=np.uint64)), axis=1)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(both[0], minlength=len(starts)))])
    return words.astype("<u8"), offsets.astype("<u4")


def decode_ids(words: np.ndarray) -> np.ndarray:
    """All ids of some whole blocks."""
    selector = (words & np.uint64(15)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[selector]
    start = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(start[-1]), dtype=np.uint64)
    for s in np.unique(selector):
        count, width = SELECTORS[s]
        mine = np.flatnonzero(selector == s)
        shifts = np.uint64(4) + np.uint64(width) * np.arange(count, dtype=np.uint64)
        out[start[:-1][mine][:, None] + np.arange(count)] = (words[mine][:, None] >> shifts) & np.uint64((1 << width) - 1)
    return out


def write_segment(doc_ids: list[int | None], encoded: list[bytes], block: int = BLOCK_IDS) -> bytes:
    """One segment of whole documents, given their ids as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(encoded), dtype="<u4")
    words, offsets = encode_ids(ids, block)
    absent = np.fromiter((x is None for x in doc_ids), dtype=bool, count=len(doc_ids))
    nulls = np.packbits(absent, bitorder="little").tobytes() if absent.any() else b""
    numbers = np.asarray([0 if x is None else x for x in doc_ids], dtype="<i8").tobytes()
    head = (MAGIC_NULLS if nulls else MAGIC) + struct.pack("<IIIQ", len(doc_ids), len(offsets) - 1, block, len(ids))
    sizes = np.fromiter((len(x) // 4 for x in encoded), dtype="<u4", count=len(encoded))
    return b"".join([head, numbers, nulls, sizes.tobytes(), offsets.tobytes(), words.tobytes()])


def read_segment(data: bytes, blocks: slice | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, and the ids of all blocks or of some, found by the block offsets; doc_ids are masked where null."""
    if data[:4] not in (MAGIC, MAGIC_NULLS):
        raise ValueError("not a segment of token ids")
    n_docs, n_blocks, _, n_ids = struct.unpack_from("<IIIQ", data, 4)
    at = 4 + struct.calcsize("<IIIQ")
    doc_ids = np.frombuffer(data, dtype="<i8", count=n_docs, offset=at)
    at += 8 * n_docs
    if data[:4] == MAGIC_NULLS:
        bits = np.frombuffer(data, dtype=np.uint8, count=-(-n_docs // 8), offset=at)
        doc_ids = np.ma.array(doc_ids, mask=np.unpackbits(bits, count=n_docs, bitorder="little").astype(bool))
        at += len(bits)
    sizes = np.frombuffer(data, dtype="<u4", count=n_docs, offset=at)
    offsets = np.frombuffer(data, dtype="<u4", count=n_blocks + 1, offset=at + 4 * n_docs)
    words = np.frombuffer(data, dtype="<u8", count=int(offsets[-1]), offset=at + 4 * n_docs + 4 * (n_blocks + 1))
    if blocks is not None:
        chosen = range(n_blocks)[blocks]
        return doc_ids, sizes, decode_ids(words[offsets[chosen.start] : offsets[chosen.stop]] if len(chosen) else words[:0])
    ids = decode_ids(words)
    if len(ids) != n_ids or int(sizes.astype(np.int64).sum()) != n_ids:
        raise ValueError("a segment that does not hold the ids it names")
    return doc_ids, sizes, ids


def write_token_files(docs: DataFrame, to: str, path: str, kind: str = "byte", end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode all texts, each with ``end_id`` after it, to segments below ``to`` in ascending doc_id order.

    Null doc_ids come first and stay null; null and empty texts hold the end id
    alone. Rows that share a doc_id, or have none, stand side by side, ordered by
    text, in as many parts as their number asks for. A document is never split, so segments hold at least one.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, seq = word_cache(path, kind), TaskContext.get().partitionId(), 0
        held_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            row = [[part], [seq], [len(held)], [size // 4], [write_segment(held_ids, held)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, type=t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["part", "seq", "n_docs", "n_ids", "segment"],
            )

        for batch in batches:
            release_memory()
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for doc_id, own in zip(some.column(0).to_pylist(), cache.encode(some.column(1).to_pylist()), strict=True):
                    held_ids.append(doc_id)
                    held.append(own + end)
                    size += len(own) + 4
                    if size >= 4 * segment_ids:
                        yield segment()
                        held_ids, held, size, seq = [], [], 0, seq + 1
        if held:
            yield segment()

    ordered = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).repartitionByRange("doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "1000")  # texts are long: smaller batches, less memory outside the heap
    try:
        ordered.mapInArrow(coded, "part int, seq int, n_docs bigint, n_ids bigint, segment binary").write.option("compression", "zstd").parquet(to)
    finally:
        conf.set(name, before)


def read_token_files(spark: SparkSession, at: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, and ids if asked for.

    ``start`` counts the ids of all documents before it: sums of parts, of
    segments within a part, of documents within a segment.
    """
    files = spark.read.parquet(at)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))
    segments = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("s")).join(parts, "part")
    fields = "part int, seq int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release_memory()
            for part, seq, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                doc_ids, sizes, ids = read_segment(data.as_py())
                raw = ids.astype("<u4").tobytes()
                edges = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                n = len(doc_ids)
                columns = [
                    pa.array(np.full(n, part.as_py(), dtype=np.int32)), pa.array(np.full(n, seq.as_py(), dtype=np.int32)), pa.array(np.ma.getdata(doc_ids).astype(np.int64), mask=np.ma.getmaskarray(doc_ids)),
                    pa.array(edges[:-1]), pa.array(sizes.astype(np.int64)), pa.array(crc, type=pa.int64()),
                ]
                names = ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = files.select("part", "seq", "segment").mapInArrow(decoded, fields)
    out = rows.join(segments, ["part", "seq"]).withColumn("start", F.col("p") + F.col("s") + F.col("inner"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch_dir(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), to, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, to)


QUERIES = {"op7_token_files": op7_token_files}
