"""Encoding to and decoding from a public SentencePiece BPE vocabulary, with seeded merge-dropout.

A text's units (blanks and the word after them) merge independently, as no piece
goes on from a word into a blank. Candidate merges wait in an agenda, best score
first, then leftmost; each is skipped for good if a hash of the seed, the document,
the unit's place there and the merge's own place falls below the dropout rate, so
every occurrence of a unit is drawn by itself, and repeatably. What an occurrence
gives depends only on which of the unit's spans that are pieces are skipped: results
are kept by unit and set of skipped spans, and new ones merged many at a time in numpy.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.shared import kept_in_process, release_memory, table, text_of
from inkstone.llm.word_hashes import mix

BLANK = "▁"
UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
#: Finer units, for vocabularies that have no piece with a newline or with a letter beside a mark: lines are
#: parted, and the marks at the end of a word stand alone.
FINE_UNIT = re.compile(f"{BLANK}*[^{BLANK}\n]*[{LETTERS}](?=[{MARKS}]+(?:[{BLANK}\n]|$))|{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
JOINED = re.compile(f"\n|[{LETTERS}][{MARKS}]|[{MARKS}][{LETTERS}]")
LONG_UNIT, MOST_SPANS = 40, 64
NONE, UNKNOWN = np.int64(2**50), 1 << 20
BATCH_CHARS = 1_000_000
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class PieceCodec:
    """Ids of whole texts and back; forgets the later half of its units at ``limit`` units."""

    def __init__(self, path: str, dropout: float, seed: int, limit: int = 1_500_000) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.seed, self.limit = seed, limit
        self.bound = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(names[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        usual = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {names[i]: i for i in usual}
        self.char_id = np.full(0x110000, UNKNOWN, dtype=np.int64)
        for name, i in self.id_of.items():
            if len(name) == 1:
                self.char_id[ord(name)] = i
        self.raw = [b""] * size
        for i in usual:
            self.raw[i] = names[i].replace(BLANK, " ").encode()
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        self.unit = UNIT if any(JOINED.search(names[i]) for i in usual) else FINE_UNIT
        # every way to make a piece of two pieces; rank: order of falling score, pieces of one score together
        scores = {i: model.get_score(i) for i in usual}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        keys, made, ranks = [], [], []
        for i in usual:
            for cut in range(1, len(names[i])):
                left, right = self.id_of.get(names[i][:cut]), self.id_of.get(names[i][cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    made.append(i)
                    ranks.append(rank[scores[i]])
        order = np.argsort(keys)
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_made, self.pair_rank = np.array(made, dtype=np.int64)[order], np.array(ranks, dtype=np.int64)[order]
        self.pairs = {k: (m, r) for k, m, r in zip(keys, made, ranks, strict=True)}
        self.made = {names[i] for i in made}
        self.longest = max(map(len, self.made), default=0)
        place = np.arange(1 << 16, dtype=np.uint64)
        self.place = (place >> np.uint64(8)) * _C2 + (place & np.uint64(255)) * _C3 + _C1
        self.spans: dict[str, bytes | None] = {}
        self.plain: dict[str, bytes] = {}
        self.varied: dict[tuple[str, int], bytes] = {}

    # -- merging -----------------------------------------------------------------------------

    def _spans_of(self, unit: str) -> bytes | None:
        """start << 8 | stop of each span that a merge can make, 16 bits each; None: too many to keep results by them."""
        n, made = len(unit), self.made
        if n > LONG_UNIT:
            return None
        out = [i << 8 | j for i in range(n - 1) for j in range(i + 2, min(n, i + self.longest) + 1) if unit[i:j] in made]
        return array("H", out).tobytes() if len(out) <= MOST_SPANS else None

    def _draws(self, units: list[str], keys: np.ndarray) -> list[int]:
        """For each occurrence its skipped spans as bits, or its key above them where the unit has too many spans."""
        if not self.bound:
            return [0] * len(units)
        spans = self.spans
        for u in set(units):
            if u not in spans:
                spans[u] = self._spans_of(u)
        own = [spans[u] for u in units]
        wide = [i for i, x in enumerate(own) if x is None]
        for i in wide:
            own[i] = b""
        counts = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 2
        flat = np.frombuffer(b"".join(own), dtype=np.uint16)
        ends = np.cumsum(counts)
        skipped = np.flatnonzero(mix(np.repeat(keys, counts) ^ self.place[flat]) < self.bound)
        owner = np.searchsorted(ends, skipped, side="right")
        bits = np.zeros(len(own), dtype=np.uint64)
        np.bitwise_or.at(bits, owner, np.uint64(1) << (skipped - (ends - counts)[owner]).astype(np.uint64))
        draws = bits.tolist()
        for i in wide:
            draws[i] = 1 << 64 | int(keys[i])
        return draws

    def _skipped(self, key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix(key ^ (start.astype(np.uint64) * _C2 + stop.astype(np.uint64) * _C3 + _C1)) < self.bound

    def _ranked(self, left: np.ndarray, right: np.ndarray, key: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Rank and piece, in one number, of the merge of each pair of neighbours (symbol << 8 | start); NONE: no merge."""
        wanted = ((left >> 8) << 20) | (right >> 8)
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        fine = self.pair_keys[at] == wanted
        if self.bound:
            fine &= ~self._skipped(key, left & 255, stop)
        return np.where(fine, self.pair_rank[at] << 20 | self.pair_made[at], NONE)

    def _merge_many(self, symbols: np.ndarray, keys: np.ndarray) -> list:
        """Agenda processing of units of one length side by side: each round every unit makes its best merge."""
        m, n = symbols.shape
        cells = np.concatenate([symbols << 8 | np.arange(n), np.full((m, 1), n)], axis=1)  # the last cell marks the end
        length = np.full(m, n)
        live = np.arange(m)
        if n > 1:
            rank = self._ranked(cells[:, : n - 1], cells[:, 1:n], keys[:, None], np.arange(2, n + 1)[None, :])
        while n > 1 and len(live):
            best = rank[live].argmin(axis=1)
            value = rank[live, best]
            go = value < NONE
            live, best, value = live[go], best[go], value[go]
            if not len(live):
                break
            shift = np.arange(n + 1)[None, :] + (np.arange(n + 1)[None, :] > best[:, None])
            start = cells[live, best] & 255
            cells[live] = np.take_along_axis(cells[live], np.minimum(shift, n), axis=1)
            cells[live, best] = (value & 0xFFFFF) << 8 | start
            rank[live] = np.take_along_axis(rank[live], np.minimum(shift[:, : n - 1], n - 2), axis=1)
            length[live] -= 1
            rank[live, length[live] - 1] = NONE  # beyond the end of a unit nothing merges
            for side in (-1, 0):
                at = best + side
                fine = (at >= 0) & (at + 1 < length[live])
                row, col = live[fine], at[fine]
                rank[row, col] = self._ranked(cells[row, col], cells[row, col + 1], keys[row], cells[row, col + 2] & 255)
        cells >>= 8
        plain = (cells < UNKNOWN).all(axis=1).tolist()
        raw, sizes = cells.astype("<u4").tobytes(), length.tolist()
        w = 4 * (n + 1)
        return [raw[w * i : w * i + 4 * k] if plain[i] else np.where(cells[i, :k] == UNKNOWN, -1, cells[i, :k]) for i, k in enumerate(sizes)]

    def merge_one(self, symbols: list[int], key: int) -> list[int]:
        """The same with a heap, for one unit of any length."""
        n = len(symbols)
        after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []
        key_ = np.array([key], dtype=np.uint64)

        def add(i: int, j: int) -> None:
            found = self.pairs.get(symbols[i] << 20 | symbols[j]) if symbols[i] >= 0 and symbols[j] >= 0 else None
            if found and not (self.bound and self._skipped(key_, np.array([i]), np.array([stop[j]]))[0]):
                heapq.heappush(agenda, (found[1], i, stop[i], stop[j], found[0]))

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            _, i, middle, end, made = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] == -2 or stop[i] != middle or j >= n or stop[j] != end:
                continue
            symbols[i], symbols[j], stop[i], after[i] = made, -2, end, after[j]
            if after[i] < n:
                before[after[i]] = i
                add(i, after[i])
            if before[i] >= 0:
                add(before[i], i)
        return [s for s in symbols if s != -2]

    def _merged(self, cuts: Sequence[tuple[list[str], np.ndarray, str]]) -> list[bytes]:
        """Ids of each cut; merges the units that are not known yet with the spans they skip."""
        units = [u for own, _, _ in cuts for u in own]
        keys = np.concatenate([k for _, k, _ in cuts]) if cuts else np.zeros(0, dtype=np.uint64)
        if len(self.plain) + len(self.varied) + len(self.spans) > self.limit:
            for name in ("plain", "varied", "spans"):
                kept = getattr(self, name)
                setattr(self, name, dict(islice(kept.items(), len(kept) // 2)))
        draws = self._draws(units, keys)
        plain, varied = self.plain, self.varied
        fresh = {
            (u, d): i for i, (u, d) in enumerate(zip(units, draws, strict=True)) if (u not in plain if not d else (u, d) not in varied)
        }
        self._learn(list(fresh), keys[list(fresh.values())])
        ids = [varied[u, d] if d else plain[u] for u, d in zip(units, draws, strict=True)]
        for pair in fresh:
            if pair[1] >> 64:  # drawn by its key, which does not come again
                del varied[pair]
        out, at = [], 0
        for own, _, stand_in in cuts:
            whole = b"".join(ids[at : at + len(own)])
            out.append(self._literal(whole, stand_in) if stand_in else whole)
            at += len(own)
        return out

    def _learn(self, fresh: list[tuple[str, int]], keys: np.ndarray) -> None:
        """Merge units, each by the key of one occurrence that skips these spans."""
        by_length: dict[int, list[int]] = {}
        for i, (u, _) in enumerate(fresh):
            by_length.setdefault(len(u), []).append(i)
        get = self.id_of.get
        for n, own in by_length.items():
            for at in range(0, len(own), 8192):
                part = own[at : at + 8192]
                if n > LONG_UNIT:
                    done: list = [self.merge_one([get(c, -1) for c in fresh[i][0]], int(keys[i])) for i in part]
                else:
                    text = "".join([fresh[i][0] for i in part]).encode("utf-32-le", "surrogatepass")
                    done = self._merge_many(self.char_id[np.frombuffer(text, dtype="<u4")].reshape(len(part), n), keys[part])
                for i, ids in zip(part, done, strict=True):
                    unit, draw = fresh[i]
                    spelled = ids if isinstance(ids, bytes) else self._spelled(unit, ids)
                    if draw:
                        self.varied[unit, draw] = spelled
                    else:
                        self.plain[unit] = spelled

    def _spelled(self, unit: str, ids: Sequence[int] | np.ndarray) -> bytes:
        """Little-endian ids, with bytes in place of characters that are no piece."""
        ids = np.asarray(ids, dtype=np.int64)
        if (ids >= 0).all():
            return ids.astype("<u4").tobytes()
        out: list[int] = []
        rest = iter(c for c in unit if c not in self.id_of)
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.byte_id[b] for b in next(rest).encode("utf-8", "surrogatepass"))
        return np.array(out, dtype="<u4").tobytes()

    # -- texts -------------------------------------------------------------------------------

    def _cut(self, text: str, document: int) -> Iterator[tuple[list[str], np.ndarray, str]]:
        """Units, the keys of their draws and the stand-in for the blank mark, for each piece of about BATCH_CHARS of a text."""
        literal = BLANK in text
        stand_in = next(c for c in map(chr, range(0xF0000, 0x10FFFE)) if c not in text) if literal else ""
        marked = BLANK + (text.replace(BLANK, stand_in) if literal else text).replace(" ", BLANK)
        seed = np.uint64((self.seed ^ (document * 0x9E3779B97F4A7C15)) & (2**64 - 1))
        at = number = 0
        while at < len(marked):
            end = len(marked)
            if end - at > BATCH_CHARS:
                end = marked.find(BLANK, at + BATCH_CHARS)
                while end > 0 and marked[end - 1] == BLANK:
                    end = marked.find(BLANK, end + 1)
                end = len(marked) if end <= 0 else end
            units = self.unit.findall(marked, at, end)
            yield units, mix(seed + np.arange(number, number + len(units), dtype=np.uint64) * _C1), stand_in
            at, number = end, number + len(units)

    def encode(self, texts: Sequence[str], documents: Sequence[int]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; ``documents`` are the numbers that vary the draws."""
        waiting: list[list[tuple[list[str], np.ndarray, str]]] = []
        size = 0

        def flush() -> Iterator[bytes]:
            nonlocal waiting, size
            done = iter(self._merged([x for parts in waiting for x in parts]))
            for parts in waiting:
                yield b"".join(islice(done, len(parts)))
            waiting, size = [], 0

        for text, document in zip(texts, documents, strict=True):
            if len(text) > BATCH_CHARS:
                yield from flush()
                yield b"".join(x for part in self._cut(text, document) for x in self._merged([part]))
                continue
            waiting.append(list(self._cut(text, document)) if text else [])
            size += len(text)
            if size >= BATCH_CHARS:
                yield from flush()
        yield from flush()

    def _literal(self, ids: bytes, stand_in: str) -> bytes:
        """The stand-in's bytes replaced by those of the blank mark itself."""
        code = lambda c: np.array([self.byte_id[b] for b in c.encode()], dtype="<u4").tobytes()
        old, new, out, at = code(stand_in), code(BLANK), bytearray(), 0
        while (found := ids.find(old, at)) >= 0:
            if found % 4:
                out += ids[at : found + 1]
                at = found + 1
            else:
                out += ids[at:found] + new
                at = found + len(old)
        return bytes(out + ids[at:])

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return data[1:].decode("utf-8", "surrogatepass")


def piece_codec(path: str, dropout: float, seed: int) -> PieceCodec:
    """The codec of this process, kept over batches and tasks of a reused worker."""
    return kept_in_process(("pieces", path, dropout, seed), lambda: PieceCodec(path, dropout, seed))


def encode_documents(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 17, check: bool = False) -> DataFrame:
    """doc_id, ids of every row of ``docs``; with ``check`` doc_id, n_pieces, ids_crc32, decoded_sha256 and lossless instead.

    A null text counts as empty and has no ids. Texts are whole and any character
    survives: those that are no piece, and the blank mark itself, become bytes. The
    same seed, doc_id and text always give the same ids; without dropout they are
    those of the plain vocabulary.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    checks = "n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(path, dropout, seed)
        for batch in batches:
            release_memory()
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = some.column(1).to_pylist()
                numbers = [xxhash.xxh64_intdigest(str(x).encode()) for x in some.column(0).to_pylist()]
                ids = list(codec.encode(texts, numbers))
                if check:
                    decoded = [codec.decode(x) for x in ids]
                    columns = [
                        pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]), pa.array([a == b for a, b in zip(texts, decoded, strict=True)]),
                    ]
                    names = ["n_pieces", "ids_crc32", "decoded_sha256", "lossless"]
                else:
                    edges = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    columns, names = [pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))], ["ids"]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names=["doc_id", *names])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(coded, f"doc_id {key}, " + (checks if check else "ids array<int>"))


def decode_documents(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``text`` from the array of ids; no ids give an empty text, null gives null."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = piece_codec(path, 0.0, 0)
        for batch in batches:
            yield pd.Series([None if x is None else codec.decode(np.asarray(x, dtype="<u4").tobytes()) for x in batch], dtype=object)

    return rows.withColumn("text", decoded(F.col(ids)))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), check=True)


QUERIES = {"op2_piece_codec": op2_piece_codec}
