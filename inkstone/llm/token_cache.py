"""Public tokenizers applied to whole texts, each distinct word encoded once per task process.

Both vocabularies split a text into words before merging, so a text's ids are the
ids of its units one after the other: for ``byte`` vocabularies a unit is a run of
non-blanks with the one space before it, or the blanks between; for ``word``
vocabularies, which drop white space, a run of non-blanks; both are parted between
a letter and a mark. Texts with other white
space than space and newline go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

from inkstone.llm.shared import kept_in_process
from inkstone.llm.word_hashes import span_hashes

#: Spark runs one task per core: threads inside a task would only take memory.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

PIECE_CHARS = 500_000
#: White space that the two libraries may take differently.
UNUSUAL = re.compile(r"[^\S \n]|[\x85\x1c-\x1f᠎​﻿]")
#: The first bytes of such characters in UTF-8.
MAY_BE_UNUSUAL = np.zeros(256, dtype=bool)
MAY_BE_UNUSUAL[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
BYTE_CUT = re.compile(r"(?<=[^ \n])(?= [^ \n])")

#: Letters below this are their own composed form and the same letters to every library.
LATIN_END = "\u0180"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be printed, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()

SPACE, LINE, BREAK = 0x20, 0x0A, 0xFF


_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _inner_cuts(raw: np.ndarray) -> np.ndarray:
    """Places between a plain letter and a mark: both vocabularies part the two (apostrophes may begin a contraction)."""
    if len(raw) < 2:
        return np.zeros(0, dtype=np.int64)
    letter, mark = _LETTER[raw], _MARK[raw]
    first, second = letter.copy(), letter.copy()  # a letter starts, ends here; C3 leads two-byte letters but for two signs
    two = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    first[:-1] |= two
    second[1:] |= two
    return np.flatnonzero((second[:-1] & mark[1:]) | (mark[:-1] & first[1:])) + 1


def unit_edges(raw: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of every unit in UTF-8 bytes; texts are parted by the byte BREAK, which UTF-8 never has."""
    space, line, stop_ = raw == SPACE, raw == LINE, raw == BREAK
    word = ~(space | line | stop_)
    step = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    start, stop, cuts = np.flatnonzero(step == 1), np.flatnonzero(step == -1), _inner_cuts(raw)
    if kind == "word":
        return np.sort(np.concatenate([start, cuts]), kind="stable"), np.sort(np.concatenate([stop, cuts]), kind="stable")
    gap = np.diff(np.concatenate([[0], (space | line).astype(np.int8), [0]]))
    g_start, g_stop = np.flatnonzero(gap == 1), np.flatnonzero(gap == -1)
    # the blanks before a word: a last space goes with the word, a last newline is a unit of its own
    before = np.zeros(len(raw) + 1, dtype=bool)
    before[start] = True
    leads = before[g_stop]
    last = np.where(leads, g_stop - 1, g_stop)
    takes = np.zeros(len(raw) + 1, dtype=bool)
    takes[g_stop[leads & space[g_stop - 1]]] = True
    start = start - takes[start]
    some = last > g_start
    alone = leads & line[g_stop - 1]
    start = np.concatenate([start, cuts, g_start[some], g_stop[alone] - 1])
    stop = np.concatenate([stop, cuts, last[some], g_stop[alone]])
    return np.sort(start, kind="stable"), np.sort(stop, kind="stable")


class WordCache:
    """Ids of units, found by the 64-bit hash of their bytes; emptied at ``limit`` units (about 90 MB).

    The slots hold numbers of units and grow with them; hashes are kept once for each unit.
    """

    def __init__(self, path: str, kind: str, limit: int = 1_600_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the same model without the steps before it, which leave a unit of plain letters whole
        self.merges = Tokenizer(self.tokenizer.model)
        self.kind, self.limit = kind, limit
        self._empty()

    def _empty(self) -> None:
        self.n, self.used = 0, 0
        self.slot_unit = np.full(1 << 16, -1, dtype=np.int32)
        self.hashes = np.zeros(1 << 16, dtype=np.uint64)
        self.at, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)
        self.pool = np.zeros(1 << 18, dtype=np.uint32)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded_units(self, units: list[bytes]) -> list[bytes]:
        """Ids of single units: those of plain letters by the model alone, the others by the whole tokenizer."""
        plain: list[str | None] = []
        for u in units:
            word = u.decode("utf-8")
            letters = word[1:] if word[0] == " " else word
            if letters.isalpha() and max(letters) < LATIN_END:
                data = word.lower().encode() if self.kind == "word" else u
                plain.append(data.decode("latin-1").translate(BYTE_LETTERS))
            else:
                plain.append(None)
        rest = iter(self._encoded([u.decode("utf-8") for u, p in zip(units, plain, strict=True) if p is None]))
        simple = self.merges.encode_batch_fast([p for p in plain if p is not None], add_special_tokens=False)
        own = iter([np.array(e.ids, dtype="<u4").tobytes() for e in simple])
        return [next(rest) if p is None else next(own) for p in plain]

    def _first_slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.slot_unit).bit_length())).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the unit with each hash, -1 if unknown: linear probing of all at once."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.arange(len(hashes))
        slot = self._first_slot(hashes)
        while len(left):
            unit = self.slot_unit[slot]
            same = (self.hashes[unit] == hashes[left]) & (unit >= 0)
            out[left[same]] = unit[same]
            go = (unit >= 0) & ~same
            left, slot = left[go], (slot[go] + 1) & (len(self.slot_unit) - 1)
        return out

    def _place(self, unit: np.ndarray) -> None:
        """Slots for units whose hashes are known and in no slot yet."""
        slot = self._first_slot(self.hashes[unit])
        while len(unit):
            free = self.slot_unit[slot] < 0
            self.slot_unit[slot[free]] = unit[free]  # of several for one slot the last one written stays
            left = self.slot_unit[slot] != unit
            unit, slot = unit[left], (slot[left] + 1) & (len(self.slot_unit) - 1)

    def _add(self, hashes: np.ndarray, encoded: list[bytes]) -> None:
        """Distinct unknown hashes with their ids."""
        m = len(hashes)
        sizes = np.fromiter((len(x) // 4 for x in encoded), dtype=np.int32, count=m)
        total = int(sizes.sum())
        while self.n + m > len(self.at):
            self.at, self.size, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.hashes))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = np.frombuffer(b"".join(encoded), dtype="<u4")
        self.size[self.n : self.n + m] = sizes
        self.at[self.n : self.n + m] = self.used + np.cumsum(sizes) - sizes
        self.hashes[self.n : self.n + m] = hashes
        first = self.n
        if 2 * (self.n + m) > len(self.slot_unit):
            self.slot_unit, first = np.full(1 << (2 * (self.n + m)).bit_length(), -1, dtype=np.int32), 0
        self._place(np.arange(first, self.n + m, dtype=np.int32))
        self.n, self.used = self.n + m, self.used + total

    def _units(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that are cut into units here."""
        data = bytes([BREAK]).join(texts)
        raw = np.frombuffer(data, dtype=np.uint8)
        start, stop = unit_edges(raw, self.kind)
        hashes = span_hashes(raw, start, stop)
        unit = self._find(hashes)
        unknown = np.flatnonzero(unit < 0)
        if len(unknown):
            fresh, first = np.unique(hashes[unknown], return_index=True)
            first = unknown[first]
            if self.n + len(fresh) > self.limit:
                self._empty()
                fresh, first = np.unique(hashes, return_index=True)
            for at in range(0, len(fresh), 10_000):
                part = first[at : at + 10_000]
                units = [data[a:b] for a, b in zip(start[part].tolist(), stop[part].tolist(), strict=True)]
                self._add(fresh[at : at + 10_000], self._encoded_units(units))
            unit = self._find(hashes)
        sizes = self.size[unit].astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.at[unit] - edges[:-1], sizes) + np.arange(edges[-1])].astype("<u4").tobytes()
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        cut = [0, *edges[np.searchsorted(start, ends)].tolist()]
        return [ids[4 * a : 4 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _parts(self, text: str) -> Iterator[str]:
        """``text`` in pieces of about PIECE_CHARS that end where two units meet."""
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = BYTE_CUT.search(text, at + PIECE_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        waiting: list[str] = []
        size = 0
        for text in texts:
            if len(text) > PIECE_CHARS:
                yield from self._encode_some(waiting)
                waiting, size = [], 0
                if self.kind == "byte" and UNUSUAL.search(text):
                    yield self._encoded([text])[0]
                else:
                    yield b"".join(self._units([part.encode("utf-8", "replace")])[0] for part in self._parts(text))
                continue
            waiting.append(text)
            size += len(text)
            if size >= PIECE_CHARS:
                yield from self._encode_some(waiting)
                waiting, size = [], 0
        yield from self._encode_some(waiting)

    def _encode_some(self, texts: list[str]) -> Iterator[bytes]:
        if not texts:
            return
        odd: set[int] = set()
        data = [t.encode("utf-8", "replace") for t in texts]
        if self.kind == "byte" and MAY_BE_UNUSUAL[np.frombuffer(b"".join(data), dtype=np.uint8)].any():
            odd = {i for i, t in enumerate(texts) if UNUSUAL.search(t)}
        plain = iter(self._units([d for i, d in enumerate(data) if i not in odd]))
        rest = iter(self._encoded([texts[i] for i in sorted(odd)]) if odd else ())
        for i in range(len(texts)):
            yield next(rest) if i in odd else next(plain)


def word_cache(path: str, kind: str) -> WordCache:
    """The cache of this process, kept over batches and tasks of a reused worker."""
    return kept_in_process(("words", path, kind), lambda: WordCache(path, kind))
