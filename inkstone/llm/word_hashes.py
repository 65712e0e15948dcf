"""64-bit hashes of words and of word n-grams (numpy), and the words of a text."""

from __future__ import annotations

import numpy as np

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20_011).integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _STEP = 0xD1342543DE82EF93, np.uint64(0x9E3779B97F4A7C15)
_INVERSE = pow(_BASE, -1, 2**64)
PIECE_BYTES = 4_000_000
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        _powers[base] = known = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def to_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def span_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, by differences of one running sum."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), dtype=np.uint64)])
    return mix((sums[stop] - sums[start]) * _power(_INVERSE, len(raw))[start] + (stop - start).astype(np.uint64) * _STEP)


def _piece_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(np.concatenate([[1], _GAP[raw].astype(np.int8), [1]]))
    return span_hashes(raw, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1))


def word_hashes(data: bytes) -> np.ndarray:
    """One hash per word of a UTF-8 text, in pieces cut between words."""
    if len(data) <= PIECE_BYTES:
        return _piece_hashes(data) if data else np.zeros(0, dtype=np.uint64)
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        while end < len(data) and not _GAP[data[end]]:
            end += 1
        out.append(_piece_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row, by doubling; empty for fewer than n words."""
    total = len(words) - n + 1
    if total <= 0:
        return np.zeros(0, dtype=np.uint64)
    part, size, out, done = words, 1, None, 0
    while True:
        if n & size:
            piece = part[done : done + total]
            out = piece if out is None else out * np.uint64(pow(int(_STEP), size, 2**64)) + piece
            done += size
        if done == n:
            return mix(out)
        part = part[:-size] * np.uint64(pow(int(_STEP), size, 2**64)) + part[size:]
        size *= 2
