"""Vectorised word tables of Arrow text batches: boundaries, 64-bit word hashes and n-gram hashes, without a loop over words.

Text is handled as UTF-8 bytes in chunks of whole documents, so memory follows the chunk (or one long document), not the batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # any odd number: it needs an inverse modulo 2**64
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD6E8FEB86659FD93)


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lowered()

#: Bytes of a word where only ASCII white space separates: [^\x20\x09-\x0D]
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of a word of ASCII letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE_LOWER = _BYTE[LOWER]

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + 1)
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        _powers.clear() if size > CHUNK_BYTES * 16 else None
        _powers[name] = known
    return known[:n]


@dataclass
class Words:
    """Words of the documents of one chunk; `first[d]:first[d + 1]` are those of document d."""

    data: np.ndarray  # bytes of the chunk
    start: np.ndarray  # byte offsets of words
    end: np.ndarray
    first: np.ndarray  # word offsets of documents
    hash: np.ndarray  # 64-bit word hashes
    sums: np.ndarray  # running sums from which hashes of parts of words come

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def stems(self, size: int) -> np.ndarray:
        """Hash of the first `size` bytes of each word (of the whole word if it is shorter)."""
        return _part_hash(self.sums, self.start, np.minimum(self.start + size, self.end))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, byte offsets of rows) of pieces of about `limit` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop, raw[at[row]:at[stop]], at[row:stop + 1] - at[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Words of a chunk: maximal runs of bytes in `table`, never across documents."""
    size = len(data)
    inside = table[data] if size else np.zeros(0, dtype=bool)
    before = np.empty(size, dtype=bool)
    if size:
        before[0] = False
        before[1:] = inside[:-1]
        edges = offsets[:-1][offsets[:-1] < size]
        before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(size, dtype=bool)
    if size:
        after[-1] = False
        after[:-1] = inside[1:]
        edges = offsets[1:]
        after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(size + 1, dtype=np.uint64)
    if size:
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power("up", _BASE, size), out=total[1:])
    return Words(data, start, end, np.searchsorted(start, offsets), _part_hash(total, start, end), total)


def _part_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    plain = (sums[end] - sums[start]) * _power("down", _BASE_INV, len(sums))[start]
    return mix(plain + (end - start).astype(np.uint64) * _STEP)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word position, hash) of all runs of n words inside one document, in order."""
    count = len(w.hash) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    left = np.repeat(w.first[1:], np.diff(w.first))  # word offset behind the word's document
    at = np.flatnonzero(np.arange(count) + n <= left[:count])
    return at, run_hash(w.hash, n)[at]


def run_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive entries."""
    count = len(hashes) - n + 1
    out = np.full(count, _U(n))
    for j in range(n):
        out *= _STEP
        out += hashes[j:j + count]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed longs that Spark holds."""
    return x.view(np.int64)
