"""Alignment of two tokenizers over a corpus, scored by how many documents hold a pair of ids.

Both vocabularies here part a text before a single space that follows a word, so a
text falls into units (blanks and the word after them) inside which all links lie.
Each distinct unit is encoded by both libraries once per task process and aligned by
its byte offsets; a text's figures and links are those of its units.

Documents are numbered in chunks of a task. For each pair of ids a chunk holds an
inverted bitmap: a container of the documents that hold the pair (16-bit places, or
plain bits where that is shorter) and multiplicity planes, plane k having the bit of
each of these documents whose number of links has bit k. Parts of a chunk are merged
by OR; parts of one long text add up. Popcounts, summed over chunks, are a pair's
documents and links. The postings then carry the scores back: a chunk's bitmaps are
opened next to its documents, and every document gets the counts of its links.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkstone.llm.shared import kept_in_process, release_memory, table, text_of
from inkstone.llm.token_cache import BYTE_CUT, BYTE_LETTERS, MAY_BE_UNUSUAL, UNUSUAL
from inkstone.llm.word_hashes import span_hashes
from inkstone.session import materialize

#: Bounds of a chunk: documents (16-bit places) and entries of its bitmaps.
CHUNK_DOCS, CHUNK_ENTRIES = 1 << 15, 1_500_000
#: Characters that are encoded at once, and of a piece of a long text.
BATCH_CHARS = 500_000
#: A table of units is emptied when its texts and pairs take so much.
HELD_BYTES = 150_000_000
SPACE, LINE, BREAK = 0x20, 0x0A, 0xFF
PLACE_BITS = 16
FACTS = ("n_a", "n_b", "n_groups", "n_links")


def _runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class UnitTable:
    """Distinct units with what they align to; emptied at ``limit`` units."""

    SLOTS = 21

    def __init__(self, path_a: str, path_b: str, limit: int = 1_000_000) -> None:
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            told = json.load(f)
        byte_of = {letter: byte for byte, letter in BYTE_LETTERS.items()}
        names = dict(told["model"]["vocab"]) | {x["content"]: x["id"] for x in told["added_tokens"] if x["content"] not in told["model"]["vocab"]}
        self.raw_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.raw_a[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        size_b = self.b.get_piece_size()
        self.raw_b = [bytes([int(n[1:-1], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in ((i, self.b.id_to_piece(i)) for i in range(size_b))]
        self.size_a, self.size_b = (np.array([len(x) for x in raw], dtype=np.int64) for raw in (self.raw_a, self.raw_b))
        self.bits_b = size_b.bit_length()
        self.whole = any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(size_b))  # then blanks part no units
        self.limit = min(limit, (1 << self.SLOTS) // 2)
        self._empty()

    def _empty(self) -> None:
        self.n, self.used = 0, 0
        self.slot_hash = np.zeros(1 << self.SLOTS, dtype=np.uint64)
        self.slot_unit = np.full(1 << self.SLOTS, -1, dtype=np.int32)
        self.facts = np.zeros((1 << 14, len(FACTS)), dtype=np.int32)
        self.fine = np.zeros(1 << 14, dtype=bool)
        self.at, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int32)
        self.pairs, self.links = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)
        self.written: list[bytes] = []
        self.held = 0

    # -- alignment of units -------------------------------------------------------------------

    def align(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of each unit (which begins with a space): facts, whether both decode to it, its distinct pairs' number, the pairs, their links, and its groups as text.

        Every byte of a unit lies in one token of each side, and two tokens overlap in one
        stretch of bytes, so links are the stretches between any two ends of tokens.
        """
        ids_a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        ids_b = self.b.encode([u[1:] for u in units], num_threads=1)
        fine = np.fromiter(
            (b"".join([self.raw_a[i] for i in x]) == (raw := u.encode()) == b"".join([self.raw_b[i] for i in y]) for u, x, y in zip(units, ids_a, ids_b, strict=True)),
            dtype=bool, count=len(units),
        )
        ids_a = [x if ok else [] for x, ok in zip(ids_a, fine, strict=True)]
        ids_b = [x if ok else [] for x, ok in zip(ids_b, fine, strict=True)]
        n_a, n_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(units)) for x in (ids_a, ids_b))
        a, b = (np.fromiter((i for x in ids for i in x), dtype=np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(end_a, end_b)
        in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        unit_a = np.repeat(np.arange(len(units)), n_a)
        unit_of = unit_a[in_a] if len(ends) else np.zeros(0, dtype=np.int64)
        last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
        group_unit = unit_a[last_a] if len(both) else np.zeros(0, dtype=np.int64)
        n_groups, n_links = np.bincount(group_unit, minlength=len(units)), np.bincount(unit_of, minlength=len(units))
        pair = a[in_a] << self.bits_b | b[in_b]
        order = np.lexsort((pair, unit_of))
        pair, unit_of = pair[order], unit_of[order]
        first = np.ones(len(pair), dtype=bool)
        first[1:] = (pair[1:] != pair[:-1]) | (unit_of[1:] != unit_of[:-1])
        starts = np.flatnonzero(first)
        links = np.diff(np.append(starts, len(pair)))
        own = np.bincount(unit_of[starts], minlength=len(units))
        written = self._written(a, b, last_a, last_b, n_groups)
        return np.stack([n_a, n_b, n_groups, n_links], axis=1), fine, own, pair[starts], links, written

    @staticmethod
    def _written(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_groups: np.ndarray) -> list[bytes]:
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, x, y = [], 0, 0
        for i, j in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            groups.append(f"{','.join(text_a[x:i])}|{','.join(text_b[y:j])}")
            x, y = i, j
        out, at = [], 0
        for n in n_groups.tolist():
            out.append(";".join(groups[at : at + n]).encode())
            at += n
        return out

    # -- the table ------------------------------------------------------------------------------

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        left, slot = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        while len(left):
            unit = self.slot_unit[slot]
            same = (unit >= 0) & (self.slot_hash[slot] == hashes[left])
            out[left[same]] = unit[same]
            go = (unit >= 0) & ~same
            left, slot = left[go], (slot[go] + 1) & ((1 << self.SLOTS) - 1)
        return out

    def _add(self, hashes: np.ndarray, units: list[str]) -> None:
        facts, fine, own, pairs, links, written = self.align(units)
        m, total = len(units), len(pairs)
        while self.n + m > len(self.at):
            for name in ("facts", "fine", "at", "size"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while self.used + total > len(self.pairs):
            for name in ("pairs", "links"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        where = slice(self.n, self.n + m)
        self.facts[where], self.fine[where], self.size[where] = facts, fine, own
        self.at[where] = self.used + np.cumsum(own) - own
        self.pairs[self.used : self.used + total], self.links[self.used : self.used + total] = pairs, links
        self.written += written
        self.held += sum(map(len, written)) + 12 * total
        unit, slot, left = np.arange(self.n, self.n + m, dtype=np.int32), (hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64), np.arange(m)
        while len(left):
            free = self.slot_unit[slot] < 0
            self.slot_unit[slot[free]] = unit[left[free]]
            mine = self.slot_unit[slot] == unit[left]
            self.slot_hash[slot[mine]] = hashes[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & ((1 << self.SLOTS) - 1)
        self.n, self.used = self.n + m, self.used + total

    def units_of(self, texts: list[str], whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts (each with its first space), and how many each text has."""
        data = bytes([BREAK]).join([t.encode("utf-8", "replace") for t in texts])
        raw = np.frombuffer(data, dtype=np.uint8)
        stops = np.append(np.flatnonzero(raw == BREAK), len(raw))
        starts = np.append(0, stops[:-1] + 1)
        cuts = np.zeros(0, dtype=np.int64)
        if not (whole or self.whole) and len(raw) > 2:
            gap = (raw == SPACE) | (raw == LINE) | (raw == BREAK)
            cuts = np.flatnonzero((raw[1:-1] == SPACE) & ~gap[:-2] & ~gap[2:]) + 1
        start = np.sort(np.concatenate([starts, cuts]))
        stop = np.sort(np.concatenate([stops, cuts]))
        hashes = span_hashes(raw, start, stop)
        unit = self._find(hashes)
        unknown = np.flatnonzero(unit < 0)
        if len(unknown):
            fresh, first = np.unique(hashes[unknown], return_index=True)
            first = unknown[first]
            if self.n + len(fresh) > self.limit or self.held > HELD_BYTES:
                self._empty()
                fresh, first = np.unique(hashes, return_index=True)
            for at in range(0, len(fresh), 20_000):
                some = first[at : at + 20_000].tolist()
                self._add(fresh[at : at + 20_000], [data[start[i] : stop[i]].decode() for i in some])
            unit = self._find(hashes)
        return unit, np.bincount(np.searchsorted(starts, start, side="right") - 1, minlength=len(texts))


# -- postings of a chunk ------------------------------------------------------------------------


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """OR of bitmaps, each given as entries (pair << 16 | place) with their links, which add up; entries come out in order."""
    keys, links = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(first)
    return keys[starts], np.add.reduceat(links[order], starts) if len(starts) else links[:0]


def containers(keys: np.ndarray, links: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """pair, documents of each pair, their container, and the multiplicity planes, from merged entries."""
    pair, place = keys >> PLACE_BITS, (keys & ((1 << PLACE_BITS) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(starts, len(pair)))
    width = -(-n_docs // 8)
    places = place.astype("<u2").tobytes()
    # an even length is that of 16-bit places; plain bits get one more byte where theirs is even
    docs = [places[2 * a : 2 * (a + n)] for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
    for k in np.flatnonzero(2 * counts > width + 1).tolist():
        bits = np.zeros(8 * (width | 1), dtype=np.uint8)
        bits[place[starts[k] : starts[k] + counts[k]]] = 1
        docs[k] = np.packbits(bits, bitorder="little").tobytes()
    size = -(-counts // 8)
    top = np.maximum.reduceat(links, starts) if len(starts) else links[:0]
    n_planes = np.zeros(len(starts), dtype=np.int64)
    while (more := (top >> n_planes) > 0).any():
        n_planes += more
    ends = np.cumsum(size * n_planes)
    base = np.repeat(ends - size * n_planes, counts)
    rank, row = _runs(counts), np.repeat(size, counts)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(n_planes.max()) if len(n_planes) else 0):
        some = np.flatnonzero((links >> k) & 1)
        np.bitwise_or.at(data, base[some] + k * row[some] + (rank[some] >> 3), (1 << (rank[some] & 7)).astype(np.uint8))
    flat, edges = data.tobytes(), [0, *ends.tolist()]
    return pair[starts], counts, docs, [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def opened(n_docs: np.ndarray, docs: list[bytes], planes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and links of every entry of some bitmaps."""
    places = [d if len(d) % 2 == 0 else np.flatnonzero(np.unpackbits(np.frombuffer(d, dtype=np.uint8), bitorder="little")).astype("<u2").tobytes() for d in docs]
    place = np.frombuffer(b"".join(places), dtype="<u2").astype(np.int64)
    size = -(-n_docs // 8)
    lengths = np.fromiter(map(len, planes), dtype=np.int64, count=len(planes))
    n_planes = lengths // np.maximum(size, 1)
    data = np.frombuffer(b"".join(planes), dtype=np.uint8)
    rank, row = _runs(n_docs), np.repeat(np.arange(len(n_docs)), n_docs)
    at, bit = (np.cumsum(lengths) - lengths)[row] + (rank >> 3), (rank & 7).astype(np.uint8)
    links = np.zeros(len(place), dtype=np.int64)
    for k in range(int(n_planes.max()) if len(n_planes) else 0):
        some = np.flatnonzero(n_planes[row] > k)
        links[some] |= ((data[at[some] + k * size[row[some]]] >> bit[some]) & 1).astype(np.int64) << k
    return row, place, links


# -- the jobs -------------------------------------------------------------------------------------

_ROW = "chunk long, place int, key long, n_a long, n_b long, n_groups long, n_links long, groups string, pair long, n_docs long, docs binary, planes binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _pieces(text: str) -> Iterator[str]:
    """A text with its first space, in pieces that end where two units meet."""
    text, at = " " + text, 0
    while len(text) - at > BATCH_CHARS:
        cut = BYTE_CUT.search(text, at + BATCH_CHARS)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _whole(text: str) -> bool:
    """Whether the text holds white space, blanks or zeros that the libraries may take otherwise than in units."""
    return "▁" in text or "\x00" in text or UNUSUAL.search(text) is not None


class _Chunks:
    """Rows of one task: documents, and the bitmaps of each chunk when it is full."""

    def __init__(self, table_: UnitTable, task: int, written: bool) -> None:
        self.table, self.number, self.written = table_, task << 32, written
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.entries, self.docs = 0, 0

    def add(self, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        at, n = 0, len(texts)
        while at < n:
            stop, size = at, 0
            while stop < n and size < BATCH_CHARS and stop - at < CHUNK_DOCS:
                size += len(texts[stop])
                stop += 1
            yield from self._some(ids[at:stop], texts[at:stop])
            at = stop

    def _some(self, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        if self.docs and (self.docs + len(texts) > CHUNK_DOCS or self.entries > CHUNK_ENTRIES):
            yield from self.flush()
        joined = "".join(texts)
        check = MAY_BE_UNUSUAL[np.frombuffer(joined.encode("utf-8", "replace"), dtype=np.uint8)].any() or "\x00" in joined
        plain, apart, long = [], [], []
        for i, text in enumerate(texts):
            if text:
                (apart if check and _whole(text) else long if len(text) > BATCH_CHARS else plain).append(i)
        facts = np.zeros((len(texts), len(FACTS)), dtype=np.int64)
        groups: list[list[bytes]] = [[] for _ in texts]
        fine = np.ones(len(texts), dtype=bool)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(plain, [" " + texts[i] for i in plain], False)] if plain else []
        todo += [([i], [" " + texts[i]], True) for i in apart]
        for owners, some, whole in todo:
            kept += self._part(owners, some, whole, facts, fine, groups)
        for i in long:
            mine = [x for piece in _pieces(texts[i]) for x in self._part([i], [piece], False, facts, fine, groups)]
            kept += mine if fine[i] else []
        facts[~fine] = 0
        digests = [(self._text(g) if self.written else hashlib.sha256(self._text(g)).hexdigest()) if ok and g else "" for g, ok in zip(groups, fine, strict=True)]
        if kept:
            self.parts.append(merged(kept))
            self.entries += len(self.parts[-1][0])
        place = np.arange(self.docs, self.docs + len(texts), dtype=np.int32)
        self.docs += len(texts)
        yield self._batch(len(texts), place=place, key=pa.array(ids, type=pa.int64()), groups=pa.array([x if isinstance(x, str) else x.decode() for x in digests]), **{f: facts[:, k] for k, f in enumerate(FACTS)})

    @staticmethod
    def _text(parts: list[bytes]) -> bytes:
        return b";".join(parts)

    def _part(self, owners: list[int], texts: list[str], whole: bool, facts: np.ndarray, fine: np.ndarray, groups: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Adds the figures of some texts to those of their documents; gives the entries of their bitmaps."""
        t = self.table
        unit, counts = t.units_of(texts, whole)
        own = np.asarray(owners)
        doc = np.repeat(np.arange(len(owners)), counts)
        bad = np.bincount(doc[~t.fine[unit]], minlength=len(owners)) > 0
        fine[own[bad]] = False
        starts = np.cumsum(counts) - counts
        facts[own] += np.add.reduceat(t.facts[unit].astype(np.int64), starts, axis=0)
        written, numbers = t.written, unit.tolist()
        for k, (at, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
            groups[owners[k]].append(b";".join([written[u] for u in numbers[at : at + n]]))
        both, times = np.unique(doc.astype(np.int64) << 32 | unit, return_counts=True)
        doc, unit = both >> 32, both & 0xFFFFFFFF
        stay = ~bad[doc]
        doc, unit, times = doc[stay], unit[stay], times[stay]
        sizes = t.size[unit].astype(np.int64)
        entry = np.repeat(t.at[unit], sizes) + _runs(sizes)
        place = np.repeat(self.docs + own[doc], sizes)
        return [(t.pairs[entry] << PLACE_BITS | place, t.links[entry].astype(np.int64) * np.repeat(times, sizes))] if len(entry) else []

    def _batch(self, n: int, **columns) -> pa.RecordBatch:  # noqa: ANN003
        schema = {"chunk": pa.int64(), "place": pa.int32(), "groups": pa.string(), "docs": pa.binary(), "planes": pa.binary()}
        arrays = []
        for name in _NAMES:
            kind = schema.get(name, pa.int64())
            value = np.full(n, self.number) if name == "chunk" else columns.get(name)
            arrays.append(pa.nulls(n, kind) if value is None else value if isinstance(value, pa.Array) else pa.array(value, type=kind))
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, links = merged(self.parts)
            for at, stop in _slices(keys):
                pair, counts, docs, planes = containers(keys[at:stop], links[at:stop], self.docs)
                yield self._batch(len(pair), pair=pair, n_docs=counts, docs=pa.array(docs, pa.binary()), planes=pa.array(planes, pa.binary()))
        self.number, self.parts, self.entries, self.docs = self.number + 1, [], 0, 0
        release_memory()


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about 200,000 entries that end with a pair."""
    at = 0
    while at < len(keys):
        stop = min(at + 200_000, len(keys))
        if stop < len(keys):
            stop = int(np.searchsorted(keys, ((keys[stop - 1] >> PLACE_BITS) + 1) << PLACE_BITS))
        yield at, stop
        at = stop


def aligned_units(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", written: bool = False) -> DataFrame:
    """Rows of documents (``pair`` null) and of the bitmaps of their chunks, written to the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = kept_in_process(("align", path_a, path_b), lambda: UnitTable(path_a, path_b))
        chunks = _Chunks(units, TaskContext.get().partitionId(), written)
        for batch in batches:
            yield from chunks.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield from chunks.flush()

    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    return materialize(rows.mapInArrow(work, _ROW), "alignment")


def _links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, documents and links of bitmaps, by popcount."""
    for batch in batches:
        planes, n_docs = batch.column(2).to_pylist(), batch.column(1).to_numpy()
        flat = np.bitwise_count(np.frombuffer(b"".join(planes), dtype=np.uint8)).astype(np.int64)
        sizes = np.fromiter(map(len, planes), dtype=np.int64, count=len(planes))
        plane = _runs(sizes) // np.repeat(np.maximum(-(-n_docs // 8), 1), sizes)
        sums = np.concatenate([[0], np.cumsum(flat << plane)])
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums[ends] - sums[ends - sizes])], names=["pair", "n_docs", "n_links"])


def pair_counts(bitmaps: DataFrame) -> DataFrame:
    """pair, n_docs, n_links over all chunks."""
    counts = bitmaps.select("pair", "n_docs", "planes").mapInArrow(_links_of, "pair long, n_docs long, n_links long")
    return counts.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))


def token_pairs(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """a_id, b_id, n_docs, n_links: every linked pair of ids, the documents that hold it and its links in all of them."""
    bitmaps = aligned_units(docs, path_a, path_b, key, text).where("pair is not null")
    bits = _bits_of(path_b)
    return pair_counts(bitmaps).select(
        F.shiftright("pair", bits).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << bits) - 1)).alias("b_id"), "n_docs", "n_links"
    )


def _bits_of(path_b: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size().bit_length()


def align_documents(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", written: bool = False) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: one row for each row of ``docs``.

    ``path_a`` names a byte-level vocabulary, ``path_b`` a SentencePiece one. A takes
    the text after a space, B the text; byte offsets where tokens of both end cut them
    into groups, and tokens whose bytes overlap are linked. A pair's count is the
    number of rows of ``docs`` that hold it; ``n_best`` counts the links whose count is
    the highest of their A id, ``count_sum`` adds up the counts of the links.
    ``groups`` is the SHA-256 of the groups' text, or with ``written`` that text.

    Null and empty texts, and those that either vocabulary does not give back byte for
    byte, have zeros and an empty string. Null and repeated keys keep their rows, and
    repeated rows count as documents of their own; other columns are not read. Texts
    of any length are taken in pieces. Tables without rows give none.
    """
    rows = aligned_units(docs, path_a, path_b, key, text, written)
    bitmaps = rows.where("pair is not null").select("chunk", "pair", "n_docs", "docs", "planes")
    counts = materialize(pair_counts(bitmaps).withColumn("a", F.shiftright("pair", _bits_of(path_b))), "pairs")
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    scores = counts.join(highest, "a").select("pair", F.col("n_docs").alias("count"), (F.col("n_docs") == F.col("highest")).alias("best"))
    scored = bitmaps.join(scores, "pair").select("chunk", "n_docs", "docs", "planes", "count", "best")
    documents = rows.where("pair is null").select(F.col("chunk").alias("own"), "place", "key", *FACTS, "groups")

    def returned(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bitmaps of a chunk give their scores to its documents."""
        n = left.num_rows
        total, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for batch in right.combine_chunks().to_batches(max_chunksize=20_000):
            row, place, links = opened(batch["n_docs"].to_numpy(), batch["docs"].to_pylist(), batch["planes"].to_pylist())
            np.add.at(total, place, links * batch["count"].to_numpy()[row])
            leads = batch["best"].to_numpy(zero_copy_only=False)[row]
            np.add.at(best, place[leads], links[leads])
        place = left["place"].to_numpy()
        columns = {name: left[name] for name in ("key", *FACTS)}
        return pa.table(columns | {"n_best": pa.array(best[place]), "count_sum": pa.array(total[place]), "groups": left["groups"]})

    schema = f"key long, {', '.join(f'{f} long' for f in FACTS)}, n_best long, count_sum long, groups string"
    found = documents.groupBy("own").cogroup(scored.groupBy("chunk")).applyInArrow(returned, schema)
    return found.withColumnRenamed("key", key)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_documents(docs, *paths).withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op11_token_alignment": op11_token_alignment}
