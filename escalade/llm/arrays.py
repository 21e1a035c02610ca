"""Vectorized text helpers for Arrow tasks: byte chunks, rolling hashes, words and shingles.

A chunk holds whole texts only, so results never depend on how rows were dealt.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: The C library, of which not every one has ``malloc_trim``.
_C = ctypes.CDLL(None)
#: Texts are handled in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


class Chunk(NamedTuple):
    """Texts ``first`` to ``last`` (exclusive) of a batch: their bytes, and where each one starts."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole texts; a null counts as the empty text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    # The bytes stay where they are; only their places are read.
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not wide and not pa.types.is_string(texts.type) and not pa.types.is_binary(texts.type):
        texts, wide = texts.cast(pa.large_binary()), True
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield Chunk(first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last
    if len(data) >= CHUNK_BYTES:
        release()


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_C, "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base % (1 << 64), dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between chunks of like size."""
    size = 1 << max(16, int(n - 1).bit_length())
    return _powers(size, base)[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes, so that any range hashes in constant time."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(len(data) + 1)[:-1]
    np.cumsum(terms, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for arrays of bounds; equal bytes hash alike wherever they stand."""
    inverse = powers(len(prefix), pow(BASE, -1, 1 << 64))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a + size] equals data[b:b + size], for arrays of places."""
    out = np.ones(len(a), dtype=bool)
    # Eight bytes at a time, wherever they stand; the last eight of a range may overlap those before them.
    wide = np.ndarray(max(len(data) - 7, 0), "<u8", np.ascontiguousarray(data), strides=(1,))
    # A few thousand ranges at a time, as every step takes several numbers here.
    for begin in range(0, len(a), 1 << 12):
        s = slice(begin, begin + (1 << 12))
        for unit, view, chosen in ((8, wide, size[s] >= 8), (1, data, size[s] < 8)):
            rows = np.flatnonzero(chosen)
            last = size[s][rows].astype(np.int64) - unit
            steps = -(-(last + unit) // unit)
            row = np.repeat(np.arange(len(rows)), steps)
            step = unit * (np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps))
            step = np.minimum(step, last[row])
            differ = view[a[s][rows][row] + step] != view[b[s][rows][row] + step]
            out[begin + rows] = np.bincount(row[differ], minlength=len(rows)) == 0
    return out


def _word_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[a:b] = True
    return table


#: Bytes of words: ASCII letters and digits, and all of non-ASCII characters.
WORD = _word_table()
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes that stay inside one text: start, end, text number."""
    if not len(member):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    edge = np.zeros(len(member) + 1, dtype=bool)
    edge[offsets] = True
    starts = member.copy()
    starts[1:] &= ~member[:-1] | edge[1:-1]
    ends = member.copy()
    ends[:-1] &= ~member[1:] | edge[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


class Words(NamedTuple):
    """Word hashes of a chunk in reading order, and the text of each."""

    hashes: np.ndarray
    doc: np.ndarray


def words(chunk: Chunk) -> Words:
    """Words without punctuation, ASCII letters in lower case."""
    lower = LOWER[chunk.data]
    start, end, doc = runs(WORD[lower], chunk.offsets)
    if not len(start):
        return Words(np.zeros(0, np.uint64), doc)
    return Words(range_hash(prefix_hash(lower), start, end), doc)


class Shingles(NamedTuple):
    """Hashed word shingles: text, hash, and the place of the first word in ``Words``; ``size`` words each."""

    doc: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    size: np.ndarray


def shingles(found: Words, size: int) -> Shingles:
    """All runs of ``size`` words; a text with fewer words, but one at least, is one shingle."""
    n = len(found.hashes)
    doc = found.doc
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Shingles(none, np.zeros(0, np.uint64), none, none)
    begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    counts = np.diff(np.r_[begins, n])
    full = np.flatnonzero(doc[:n - size + 1] == doc[size - 1:]) if n >= size else np.zeros(0, np.int64)
    acc = np.zeros(len(full), np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        acc = acc * step + found.hashes[full + k]
    short = begins[counts < size]
    lens = counts[counts < size]
    other = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        more = lens > k
        other[more] = other[more] * step + found.hashes[short[more] + k]
    first = np.r_[full, short]
    hashes = mix(np.r_[acc, other] ^ np.uint64(size))
    sizes = np.r_[np.full(len(full), size), lens]
    order = np.argsort(first, kind="stable")
    return Shingles(doc[first[order]], hashes[order], first[order], sizes[order])
