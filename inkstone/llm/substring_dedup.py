"""Removal of long word passages that start in an earlier document, by prefix-partitioned suffix trees.

1. Words and sampled word n-grams (the least hash of each window, so that equal
   windows sample equally) are hashed where the texts are read. Documents with equal
   words are one class; only its first goes on.
2. A suffix can share a window with another document only if the n-gram sampled
   from the window occurs in two documents; all others are leaves and stay out.
3. The remaining suffixes, one byte per word and a fingerprint of the window, are
   range-partitioned: the range borders are prefixes of varying length, so groups
   have like sizes and even one passage in a third of all documents is split.
4. Each group is read in suffix order: neighbours whose common prefix is a whole
   window lie below one deep internal node of the suffix tree, and the node's first
   suffix belongs to the earliest document. A node that crosses a border is carried
   over by one summary row per group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.shared import WORD_GAP, release_memory, table
from inkstone.llm.word_hashes import gram_hashes, to_bytes, word_hashes
from inkstone.session import materialize

WINDOW = 50
SAMPLE = 16
FILTER_BITS = 1 << 22


def sampled_places(words: np.ndarray, window: int = WINDOW, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``sample``-grams, and for each window the place of its least hash (the first of equals)."""
    grams = gram_hashes(words, sample)
    reach, total = window - sample + 1, len(words) - window + 1
    if total <= 0:
        return grams, np.zeros(0, dtype=np.int64)
    place, size = np.arange(len(grams)), 1
    while size < reach:
        step = min(size, reach - size)
        left, right = place[:-step], place[step:]
        place = np.where(grams[left] <= grams[right], left, right)
        size += step
    return grams, place[:total]


def _sha(words: bytes) -> str:
    return hashlib.sha256(words).hexdigest()


def _version():
    """Tells texts apart that share a doc_id, in 32 bits."""
    return (F.crc32(F.col("digest").cast("binary")) - F.lit(1 << 31)).cast("int")


def _describe(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, digest of all words, and the sampled grams with their places."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release_memory()
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                sizes, digests, hashes, places = [], [], [], []
                for text in some.column(1):
                    data = to_bytes(text.as_py())
                    words = data.split()
                    sizes.append(len(words))
                    digests.append(_sha(b" ".join(words)))
                    grams, place = sampled_places(word_hashes(data), window) if len(words) >= window else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    place = np.unique(place)
                    hashes.append(grams[place].view(np.int64) if len(place) else np.zeros(0, np.int64))
                    places.append(place.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(sizes, type=pa.int64()), pa.array(digests), pa.array(hashes, type=pa.list_(pa.int64())), pa.array(places, type=pa.list_(pa.int32()))],
                    names=["doc_id", "n_words", "digest", "grams", "places"],
                )

    return docs.mapInArrow(described, "doc_id bigint, n_words bigint, digest string, grams array<bigint>, places array<int>")


def _fixed_filter(ids: DataFrame):
    """A test whether a doc_id may be among ``ids``: a bit field of fixed size, set by an aggregate of bits.

    Never wrong for those that are; it only keeps most other texts out of the exact join.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    rows = (
        ids.select(bit.alias("bit")).groupBy(F.expr("cast(bit div 64 as int)").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).collect()
    )
    field = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in rows:
        field[row["word"]] = row["bits"]

    @F.pandas_udf("boolean")
    def may_be(place):  # noqa: ANN001, ANN202
        p = place.to_numpy()
        return pd.Series((field[p // 64] >> (p % 64)) & 1 == 1)

    return may_be(bit)


def _candidate_suffixes(texts: DataFrame, window: int) -> DataFrame:
    """One row per suffix whose window has a shared sampled gram: code of its first words, fingerprint, document, place."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, version, text, places in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = word_hashes(to_bytes(text.as_py()))
                _, place = sampled_places(words, window)
                shared = np.zeros(len(words) + 1, dtype=bool)
                shared[np.asarray(places.values)] = True
                starts = np.flatnonzero(shared[place])
                codes, prints = (words >> np.uint64(56)).astype(np.uint8), gram_hashes(words, window)
                for at in range(0, len(starts), 20_000):
                    mine = starts[at : at + 20_000]
                    rows = np.lib.stride_tricks.sliding_window_view(codes, window)[mine]
                    n = len(mine)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * window).astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())]),
                            pa.array(prints[mine].view(np.int64)), pa.array(np.full(n, doc_id.as_py(), dtype=np.int64)),
                            pa.array(np.full(n, version.as_py(), dtype=np.int32)), pa.array(mine.astype(np.int32)),
                        ],
                        names=["codes", "fingerprint", "doc_id", "version", "place"],
                    )

    return texts.select("doc_id", "version", "text", "places").mapInArrow(
        suffixes, "codes binary, fingerprint bigint, doc_id bigint, version int, place int"
    )


def _nodes(suffixes: DataFrame) -> DataFrame:
    """Suffixes below a deep node with the node's first document in this group; last row: the group's border nodes."""
    order = ["codes", "fingerprint", "doc_id", "version", "place"]
    fields = "part int, doc_id bigint, version int, place int, owner bigint, first boolean, first_node binary, last_node binary"

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first_node, node, owner = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = batch.column(0)
            window = len(codes[0].as_py())
            width = np.frombuffer(codes.buffers()[2], dtype=np.uint8)[codes.offset * window :][: n * window].reshape(n, window)
            prints, ids = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            differ = width[1:] != width[:-1]
            common = np.where(differ.any(axis=1), differ.argmax(axis=1), window)
            opens = np.concatenate([[True], (common < window) | (prints[1:] != prints[:-1])])
            key = lambda i: width[i].tobytes() + int(prints[i]).to_bytes(8, "little", signed=True)  # noqa: B023, E731
            head = np.flatnonzero(opens)
            owners = ids[head]
            if node is not None and key(0) == node:
                owners[0] = owner
            elif first_node is None:
                first_node = key(0)
            group = np.cumsum(opens) - 1
            own = owners[group]
            inside_first = np.array([key(i) == first_node for i in head])[group]
            keep = np.flatnonzero((ids > own) | inside_first)
            if len(keep):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(keep), part, dtype=np.int32)), pa.array(ids[keep]), batch.column(3).take(pa.array(keep)), batch.column(4).take(pa.array(keep)),
                        pa.array(own[keep]), pa.array(inside_first[keep]), pa.nulls(len(keep), pa.binary()), pa.nulls(len(keep), pa.binary()),
                    ],
                    names=["part", "doc_id", "version", "place", "owner", "first", "first_node", "last_node"],
                )
            node, owner = key(n - 1), int(own[-1])
        if node is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([owner], pa.int64()), pa.array([None], pa.bool_()), pa.array([first_node], pa.binary()), pa.array([node], pa.binary())],
                names=["part", "doc_id", "version", "place", "owner", "first", "first_node", "last_node"],
            )

    return suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walked, fields)


def _stitched(nodes: DataFrame) -> DataFrame:
    """doc_id, version, place of every suffix below a node that an earlier document owns, across group borders."""
    carried, node, owner = [], None, None
    for row in sorted(nodes.where(F.col("last_node").isNotNull()).collect(), key=lambda r: r["part"]):
        goes_on = node is not None and row["first_node"] == node
        if goes_on:
            carried.append((row["part"], owner))
        if not goes_on or row["last_node"] != row["first_node"]:
            owner = row["owner"]
        node = row["last_node"]
    rows = nodes.where(F.col("last_node").isNull())
    if not carried:
        return rows.where(F.col("doc_id") > F.col("owner")).select("doc_id", "version", "place")
    over = nodes.sparkSession.createDataFrame(carried, "part int, carried bigint")
    best = F.when(F.col("first"), F.coalesce("carried", "owner")).otherwise(F.col("owner"))
    return rows.join(over, "part", "left").where(F.col("doc_id") > best).select("doc_id", "version", "place")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, digest, kept words (joined by a blank), number removed and the removed spans, from the removed windows' places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            for text, places in zip(batch.column(2), batch.column(3), strict=True):
                words = to_bytes(text.as_py()).split()
                at = np.asarray(places.values)
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept.append(b" ".join(compress(words, (~gone).tolist())).decode("utf-8", "surrogatepass"))
                removed.append(int(gone.sum()))
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                spans.append([{"start": a, "stop": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kept, type=pa.string()), pa.array(removed, type=pa.int64()), pa.array(spans, type=kind)],
                names=["doc_id", "digest", "kept_text", "n_removed", "spans"],
            )

    return texts.mapInArrow(cut, "doc_id bigint, digest string, kept_text string, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>")


def find_repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """What is known of each row of ``docs`` (doc_id, text), and the texts that lose some words.

    First: doc_id, n_words, digest (SHA-256 of the words joined by a blank), copy
    (a document with a smaller doc_id has the same words, at least ``window`` of
    them, so that all go). Second, for those that lose words without being copies:
    doc_id, digest, kept_text, n_removed, spans (word numbers, stop exclusive).

    Null and empty texts have no words. Rows with a null doc_id take no part and
    lose nothing. Rows that share a doc_id never count as earlier than each other.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = materialize(_describe(read, window), "described")
    long_ = known.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = long_.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    facts = known.select("doc_id", "n_words", "digest").join(first, "digest", "left").select(
        "doc_id", "n_words", "digest", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("copy")
    )
    leading = long_.join(first.select("digest", F.col("first_id").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"])
    sampled = leading.select("doc_id", "digest", F.explode(F.arrays_zip("grams", "places")).alias("x")).select(
        "doc_id", _version().alias("version"), F.col("x.grams").alias("gram"), F.col("x.places").alias("place")
    )
    shared = sampled.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("gram")
    wanted = materialize(
        sampled.join(shared, "gram", "left_semi").groupBy("doc_id", "version").agg(F.collect_list("place").alias("places")), "wanted"
    )
    candidates = read.where(_fixed_filter(wanted.select("doc_id"))).join(wanted, "doc_id")
    words_joined = F.array_join(F.array_remove(F.split(F.coalesce("text", F.lit("")), WORD_GAP), ""), " ")
    digest = F.sha2(words_joined.cast("binary"), 256)
    candidates = candidates.withColumn("digest", digest).where(_version() == F.col("version"))
    texts = materialize(candidates.dropDuplicates(["doc_id", "version"]), "texts")
    nodes = materialize(_nodes(_candidate_suffixes(texts, window)), "nodes")
    gone = _stitched(nodes).groupBy("doc_id", "version").agg(F.collect_list("place").alias("gone"))
    losing = texts.select("doc_id", "version", "digest", "text").join(gone, ["doc_id", "version"]).select("doc_id", "digest", "text", "gone")
    return facts, _cut(losing, window)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words of earlier documents' passages taken out of ``text``; one row per row.

    Texts that lose nothing stay as they are; the others become their kept words
    joined by blanks. The order of columns is that of ``docs``.
    """
    facts, cut = find_repeats(docs, window)
    copies = facts.where("copy").select("doc_id", "digest", F.lit("").alias("kept_text"))
    changed = cut.select("doc_id", "digest", "kept_text").union(copies).dropDuplicates(["doc_id", "digest"])
    # the texts are joined by id; only those that have an entry are hashed to see which one is theirs
    found = changed.groupBy(F.col("doc_id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("digest", "kept_text"))).alias("_kept"))
    words_joined = F.array_join(F.array_remove(F.split(F.coalesce("text", F.lit("")), WORD_GAP), ""), " ")
    new = F.when(found["_kept"].isNotNull(), F.try_element_at(found["_kept"], F.sha2(words_joined.cast("binary"), 256)))
    joined = docs.join(found, docs["doc_id"] == found["_id"], "left")
    return joined.select(*[F.coalesce(new, F.col("text")).alias("text") if c == "text" else docs[c] for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, cut = find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    short = cut.select("doc_id", "digest", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept"))
    joined = facts.join(short, ["doc_id", "digest"], "left")
    return joined.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
    )


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
