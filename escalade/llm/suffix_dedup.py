"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte is removed that a string of ``LENGTH`` bytes covers which also starts
in a document with a smaller id.  The corpus is no single suffix array: equal
strings are brought together first, and each task sorts the suffixes that its
strings start.

1. Winnowing.  Of the grams of ``GRAM`` bytes in a string the one with the least
   hash is its anchor.  Equal strings have equal anchors, so a string whose
   anchor stands in one document only cannot repeat.  Documents are dealt out in
   blocks; a block sends packed lists of its anchors' hashes, and learns which
   of them are shared.
2. Segments.  Neighbouring strings with one anchor form a segment.  A block sends
   each distinct shared segment once, with the least id that it has there, to the
   part of its anchor.  Where very many documents share an anchor, strings are
   sent one by one to the part of their own hash instead, so that what surrounds
   a common phrase is spread over all parts.
3. Suffix sort.  A part puts its segments into one buffer with prefix sums of a
   polynomial hash.  Two suffixes are compared by a binary search for their
   common extension with such hashes and by the byte after it.  Merge sort with
   this comparison puts equal strings side by side, where they are verified byte
   by byte; each class has a least document id.
4. The least ids go back to the blocks, which mark the bytes that a string with a
   smaller id covers.

A string that many documents share travels once per block, whatever the number
of its occurrences; blocks and parts are many enough that each holds about
``BLOCK_BYTES`` of text.

Special cases: null counts as the empty text; texts shorter than a string keep
all; a null id is smaller than all others; documents with the same id (repeated
rows) never match each other, as neither has the smaller one; repetition within
a document is left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm import arrays
from escalade.llm.arrays import BASE, Chunk, equal_bytes, mix, powers, prefix_hash
from escalade.llm.frames import read

LENGTH = 50
GRAM = 25
#: Text of a block, on average.
BLOCK_BYTES = 8 << 20
#: Documents that share an anchor from which on its strings are sent by their own hashes.
COMMON = 256
#: Bytes of an anchor's hash that are sent, besides its part.
HASH_BYTES = 5
#: Texts longer than this find their anchors by places and not by packed values.
_PACKED = 25

#: Texts are hashed in chunks of about so many bytes, whose numbers stay in a processor's cache.
CHUNK_BYTES = 1 << 17
#: Strings that are compared at once.
_SLICE = 1 << 16

_NONE, _SHARED, _COMMON = 0, 1, 2


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes, low ones first."""
    return pa.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(body: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(body, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def fixed_hash(prefix: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Polynomial hash of the bytes from ``start`` on, the same wherever they stand."""
    inverse = powers(len(prefix), pow(BASE, -1, 1 << 64))
    return (prefix[start + length] - prefix[start]) * inverse[start]


class Runs(NamedTuple):
    """Neighbouring strings of one document with one anchor: its hash and place, and the first and last string's start."""

    anchor: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchor_runs(chunk: Chunk, length: int, gram: int) -> Runs:
    """The runs of a chunk; of equal grams in a string the first one counts."""
    data, n = chunk.data, len(chunk.data)
    if n < length:
        none = np.zeros(0, np.int64)
        return Runs(np.zeros(0, np.uint64), none, none, none)
    prefix = prefix_hash(data)
    hashes = mix((prefix[gram:] - prefix[:-gram]) * powers(n + 1, pow(BASE, -1, 1 << 64))[:n - gram + 1])
    window, span = length - gram + 1, 1
    if n < 1 << _PACKED:
        low = np.uint64((1 << _PACKED) - 1)
        best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        while span < window:
            step = min(span, window - span)
            best = np.minimum(best[:-step], best[step:])
            span += step
        place = (best & low).astype(np.int64)
    else:
        rank, place = hashes & ~np.uint64((1 << _PACKED) - 1), np.arange(len(hashes))
        while span < window:
            step = min(span, window - span)
            place = np.where(rank[place[:-step]] <= rank[place[step:]], place[:-step], place[step:])
            span += step
    ends = np.zeros(n + 1, dtype=np.int32)
    np.add.at(ends, np.maximum(chunk.offsets[1:] - length + 1, chunk.offsets[:-1]), 1)
    np.add.at(ends, chunk.offsets[1:], -1)
    inside = np.cumsum(ends)[:n - length + 1] == 0
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    stops[:-1] &= (place[1:] != place[:-1]) | ~inside[1:]
    # A run never goes on into the next document, since the strings across the border are not inside.
    first = np.flatnonzero(begins)
    return Runs(hashes[place[first]], place[first], first, np.flatnonzero(stops))


class Block:
    """The documents of a block in the order of id and text, with the anchors of their strings."""

    def __init__(self, table: pa.Table, length: int, gram: int, parts: int):
        self.length, self.parts = length, parts
        ids, bodies = [], []
        for row in table.select(["n", "ids", "lengths", "size", "body"]).to_pylist():
            raw = pa.decompress(row["body"], decompressed_size=row["size"], codec="zstd", asbytes=True) if row["size"] else b""
            stops = np.cumsum(unpack(row["lengths"], row["n"])).tolist()
            bodies += [raw[a:b] for a, b in zip([0, *stops], stops)]
            ids.append(unpack(row["ids"], row["n"]))
        ids = np.concatenate(ids)
        order = sorted(range(len(ids)), key=lambda k: (ids[k], bodies[k]))
        self.ids = ids[order]
        texts = pa.array([bodies[k] for k in order], pa.large_binary())
        self.offsets = np.frombuffer(texts.buffers()[1], np.int64)[:len(order) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[:self.offsets[-1]]
        found = [(self.offsets[c.first], anchor_runs(c, length, gram)) for c in arrays.chunks(texts, CHUNK_BYTES)]
        self.runs = Runs(
            np.concatenate([r.anchor for _, r in found]),
            *(np.concatenate([getattr(r, name) + base for base, r in found]) for name in ("place", "first", "last")),
        )
        del bodies, found
        arrays.release()
        # Runs stand in the order of documents, and so in that of ids.
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(np.searchsorted(self.runs.first, self.offsets)))
        order = np.argsort(self.runs.anchor, kind="stable")
        anchor, own = self.runs.anchor[order], self.ids[self.doc[order]]
        new = np.r_[True, anchor[1:] != anchor[:-1]] if len(order) else np.zeros(0, bool)
        other = np.r_[True, own[1:] != own[:-1]] | new if len(order) else new
        # Distinct anchors in the order of hash, with the number of ids that have each; and the one of each run.
        number = np.cumsum(new, dtype=np.int32) - 1
        self.anchors, counts = anchor[new], np.bincount(number[other], minlength=int(new.sum()))
        self.anchor_of = np.empty(len(order), dtype=np.int32)
        self.anchor_of[order] = number
        self.part = part_of(self.anchors, parts)
        self.by_part = np.argsort(self.part, kind="stable")
        self.counts = counts

    def lists(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each part that the block has anchors of, and their places in ``anchors``."""
        part = self.part[self.by_part]
        begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        for a, b in zip(begins, np.r_[begins[1:], len(part)]):
            yield int(part[a]), self.by_part[a:b]

    def segments(self, flags: np.ndarray) -> Segments:
        """The distinct shared strings to send, and which occurrences each stands for."""
        flag = flags[self.anchor_of]
        plain, common = np.flatnonzero(flag == _SHARED), np.flatnonzero(flag == _COMMON)
        # Common strings may be as many as bytes; 32 bits hold their places.
        kind = np.int32 if len(self.data) < 1 << 31 else np.int64
        first, count = self.runs.first.astype(kind), (self.runs.last - self.runs.first + 1).astype(kind)
        own = count[common]
        n = len(plain) + int(own.sum(dtype=np.int64))
        start, size, left, doc = np.empty(n, kind), np.full(n, self.length, kind), np.zeros(n, kind), np.empty(n, kind)
        start[:len(plain)], size[:len(plain)], doc[:len(plain)] = first[plain], count[plain] + self.length - 1, self.doc[plain]
        left[:len(plain)] = self.runs.place[plain] - first[plain]
        start[len(plain):] = np.arange(n - len(plain), dtype=kind)
        start[len(plain):] += np.repeat(first[common] - (np.cumsum(own, dtype=kind) - own), own)
        doc[len(plain):] = np.repeat(self.doc[common].astype(kind), own)
        content = np.empty(n, dtype=np.uint64)
        # Documents are hashed chunk by chunk, as prefix sums take eight times their room; both kinds stand in the order of their starts.
        base, split = 0, len(plain)
        while base < len(self.ids):
            last = int(np.searchsorted(self.offsets, self.offsets[base] + CHUNK_BYTES, side="right")) - 1
            last = min(max(last, base + 1), len(self.ids))
            a, b = self.offsets[base], self.offsets[last]
            bounds = [(base_ + np.searchsorted(own_, (a, b))).tolist() for base_, own_ in ((0, start[:split]), (split, start[split:]))]
            if any(x < y for x, y in bounds):
                prefix = prefix_hash(self.data[a:b])
                for x, y in bounds:
                    content[x:y] = mix(fixed_hash(prefix, start[x:y] - a, size[x:y]) + size[x:y].astype(np.uint64))
            base = last
        key = content.copy()
        key[:len(plain)] = self.runs.anchor[plain]
        return distinct_segments(self.data, start, size, left, key, content, self.ids, doc)


class Segments(NamedTuple):
    """Distinct segments: a place where each stands, size, bytes before the anchor, key, least id; and the occurrences (start, segment)."""

    start: np.ndarray
    size: np.ndarray
    left: np.ndarray
    key: np.ndarray
    least: np.ndarray
    at: np.ndarray
    of: np.ndarray


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(8 * HASH_BYTES)) % np.uint64(parts)).astype(np.int64)


def distinct_segments(data, start, size, left, key, content, ids, doc=None) -> Segments:
    """Segments of equal bytes as one; equal hashes are verified, and a segment that only looks equal stays apart.

    ``ids`` are those of the segments, or of the documents ``doc``.  One sort of one hash, and what is long goes slice by slice: segments may be many.
    """
    kind = np.int32 if max(len(data), len(start)) < 1 << 31 else np.int64
    look = size.astype(np.uint64) * np.uint64(BASE)
    look += left.astype(np.uint64)
    look = mix(look)
    look ^= content
    look = mix(look)
    look ^= key
    order = np.argsort(look, kind="stable").astype(kind)
    new = np.ones(len(order), dtype=bool)
    for a in range(1, len(order), _SLICE):
        own = order[a:a + _SLICE]
        new[a:a + _SLICE] = look[own] != look[order[a - 1:a - 1 + len(own)]]
    del look
    group = np.cumsum(new, dtype=kind)
    group -= 1
    first = order[new]
    del new
    apart = [np.zeros(0, np.int64)]
    for a in range(0, len(order), _SLICE):
        own, head = order[a:a + _SLICE], first[group[a:a + _SLICE]]
        same = (key[own] == key[head]) & (content[own] == content[head]) & (left[own] == left[head]) & (size[own] == size[head])
        same[same] = equal_bytes(data, start[own[same]], start[head[same]], size[own[same]])
        apart.append(a + np.flatnonzero(~same))
    apart = np.concatenate(apart)
    group[apart] = np.arange(len(first), len(first) + len(apart))
    of = np.empty(len(order), dtype=kind)
    of[order] = group
    chosen = np.r_[first, order[apart]]
    del group, order
    # Segments of one key side by side, as they are alike and so travel in less room.
    rank = np.lexsort((start[chosen], left[chosen], content[chosen], key[chosen]))
    chosen, number = chosen[rank], np.empty(len(rank), dtype=kind)
    number[rank] = np.arange(len(rank), dtype=kind)
    of = number[of]
    least = np.full(len(chosen), np.iinfo(np.int64).max)
    for a in range(0, len(of), _SLICE):
        s = slice(a, a + _SLICE)
        np.minimum.at(least, of[s], ids[s] if doc is None else ids[doc[s]])
    return Segments(*(x[chosen].astype(np.int64) for x in (start, size, left)), key[chosen], least, start, of)


def shared_flags(lists: list[np.ndarray], counts: list[np.ndarray], common: int) -> list[np.ndarray]:
    """For each block's list of hashes: 0 for those of one document, 1 for shared ones, 2 for common ones."""
    values = np.concatenate(lists)
    _, of = np.unique(values, return_inverse=True)
    total = np.bincount(of, weights=np.concatenate(counts))[of]
    flags = np.where(total >= common, _COMMON, np.where(total >= 2, _SHARED, _NONE))
    return np.split(flags, np.cumsum([len(x) for x in lists])[:-1])


class SuffixOrder:
    """Suffixes in the segments of a buffer, of at least ``length`` bytes each, compared by hashes.

    The polynomial's powers begin anew with every segment, so few of them are needed.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int):
        self.data, self.length = data, length
        self.inside = np.arange(len(data) + 1, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        self.inside[:-1] -= np.repeat(start.astype(self.inside.dtype), size)
        self.inside[-1] = 0
        most = int(size.max()) + 1 if len(size) else 1
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= powers(most)[self.inside[:-1]]
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(terms, out=self.prefix[1:])
        self.inverse = powers(most, pow(BASE, -1, 1 << 64))

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Polynomial hash of ``size`` bytes from each place on, the same wherever they stand."""
        return (self.prefix[at + size] - self.prefix[at]) * self.inverse[self.inside[at]]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of bytes, up to ``length``, that the suffixes at a and b have in common: binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        if not len(a):
            return low
        whole = self._same(a, b, high)
        low[whole] = self.length
        open_ = np.flatnonzero(~whole)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            same = self._same(a[open_], b[open_], middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle)
            open_ = open_[high[open_] - low[open_] > 1]
        return low

    def _same(self, a, b, size):
        return self.hashes(a, size) == self.hashes(b, size)

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b (or equals it, where asked)."""
        common = self.extension(a, b)
        equal = common >= self.length
        step = np.minimum(common, self.length - 1)
        return np.where(equal, or_equal, self.data[a + step] < self.data[b + step])

    def sort(self, place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and groups by group, and within it by suffix: merge sort of all groups at once, a level at a time.

        An element's place in a merged run is its place in its own run plus the number of elements of the other run before it.
        """
        order = np.argsort(group, kind="stable")
        place, group = place[order], group[order]
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.r_[begins, len(group)])
        begin, size = np.repeat(begins, size), np.repeat(size, size)
        run = 1
        while len(place) and run < size.max():
            here = np.flatnonzero(size > run)
            at = here - begin[here]
            mine = at // run
            other = mine ^ 1
            low = np.minimum(other * run, size[here])
            high = np.minimum(low + run, size[here])
            floor = low.copy()
            second = mine % 2 == 1
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                # Equal elements keep the order of their runs.
                mine_at, theirs = place[here[open_]], place[begin[here[open_]] + middle]
                ahead = self.before(theirs, mine_at, second[open_])
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            target = begin[here] + (mine // 2) * (2 * run) + at % run + (low - floor)
            merged = place.copy()
            merged[target] = place[here]
            place = merged
            run *= 2
        return place, group


def least_ids(suffixes: SuffixOrder, start: np.ndarray, size: np.ndarray, left: np.ndarray, key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every string of every segment, in order: the least id of the segments that hold it."""
    data, length = suffixes.data, suffixes.length
    count = size - length + 1
    # Strings are many; 32 bits hold their places, as a part is about as large as a block.
    kind = np.int32 if count.sum() + len(data) < 1 << 31 else np.int64
    segment = np.repeat(np.arange(len(start), dtype=kind), count)
    step = np.arange(count.sum(), dtype=kind) - np.repeat((np.cumsum(count) - count).astype(kind), count)
    least = ids[segment]
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
    family = np.empty(len(order), dtype=np.int64)
    family[order] = np.cumsum(new) - 1
    several = np.bincount(family)[family] > 1 if len(order) else np.zeros(0, bool)
    # Equal strings stand alike around their anchor, so only those with one distance to it can be equal.
    chosen = np.flatnonzero(several[segment]).astype(kind)
    if not len(chosen):
        return least
    place = start.astype(kind)[segment[chosen]] + step[chosen]
    distance = left.astype(kind)[segment[chosen]] - step[chosen] + length
    # Strings whose hash is alone in the part need not be sorted.
    look = np.empty(len(place), dtype=np.uint64)
    for a in range(0, len(place), _SLICE):
        s = slice(a, a + _SLICE)
        own = family[segment[chosen[s]]].astype(np.uint64) * np.uint64(4 * length) + distance[s].astype(np.uint64)
        look[s] = mix(suffixes.hashes(place[s], length) ^ mix(own))
    by = np.argsort(look, kind="stable").astype(kind)
    twice, same = np.zeros(len(by), dtype=bool), look[by[1:]] == look[by[:-1]]
    twice[by[1:]] |= same
    twice[by[:-1]] |= same
    del look, by, same, step
    chosen, place, distance = chosen[twice], place[twice], distance[twice]
    group = family[segment[chosen]] * (4 * length) + distance
    order = np.argsort(place, kind="stable")
    chosen, place, group = chosen[order], place[order], group[order]
    sorted_place, sorted_group = suffixes.sort(place, group)
    if not len(sorted_place):
        return least
    a, b = sorted_place[:-1], sorted_place[1:]
    equal = (sorted_group[1:] == sorted_group[:-1]) & (suffixes.extension(a, b) >= length)
    check = np.flatnonzero(equal)
    equal[check] = equal_bytes(data, a[check], b[check], np.full(len(check), length))
    begins = np.flatnonzero(np.r_[True, ~equal])
    # Every place is the start of one string, so it leads back to its segment.
    own = chosen[np.searchsorted(place, sorted_place)]
    found = np.minimum.reduceat(least[own], begins)
    least[own] = np.repeat(found, np.diff(np.r_[begins, len(own)]))
    return least


def _packed_texts():
    """Documents packed by block, so that texts are shuffled as long compressed pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, block = batch.column("k").to_numpy(), batch.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            begins = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]]) if len(order) else []
            for a, b in zip(begins, np.r_[begins[1:], len(order)] if len(order) else []):
                rows = order[a:b]
                texts = [x or b"" for x in batch.column("text").take(pa.array(rows)).cast(pa.binary()).to_pylist()]
                body = b"".join(texts)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block[rows[0]]], pa.int64()), "n": pa.array([len(rows)], pa.int64()), "ids": pa.array([pack(ids[rows])], pa.binary()),
                    "lengths": pa.array([pack(np.array([len(t) for t in texts]))], pa.binary()), "size": pa.array([len(body)], pa.int64()),
                    "body": pa.array([pa.compress(body, codec="zstd", asbytes=True) if body else b""], pa.binary()),
                })

    return run


ANSWER = "block long, stage int, part int, n long, body binary"


def _answer_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.table({name: pa.array(list(c), t) for name, c, t in zip(("block", "stage", "part", "n", "body"), columns, kinds)})


def repeated_strings(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, common: int = COMMON) -> DataFrame:
    """(key, n_bytes, removed array<struct<start, stop>>, kept binary) of every document."""
    kind = docs.schema[key].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = parts = size // block_bytes + 1
    lowest = F.lit(-(1 << 63))
    keyed = docs.select(F.coalesce(F.col(key).cast("long"), lowest).alias("k"), "text")
    keyed = keyed.select("k", F.pmod(F.xxhash64("k", F.xxhash64("text")), F.lit(blocks)).alias("block"), "text")
    packed = keyed.mapInArrow(_packed_texts(), "block long, n long, ids binary, lengths binary, size long, body binary")
    # All three steps over the texts read this one exchange.
    packed = packed.repartition(blocks, "block")

    def anchors(table):
        own = Block(table, length, gram, parts)
        rows = []
        for part, at in own.lists():
            low = own.anchors[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
            rows.append((table.column("block")[0].as_py(), part, len(at), low.tobytes(), pack(own.counts[at])))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({name: pa.array(list(c), t) for name, c, t in zip(("block", "part", "n", "hashes", "counts"), columns, kinds)})

    def share(table):
        rows = table.to_pylist()
        lists = []
        for r in rows:
            wide = np.zeros((r["n"], 8), np.uint8)
            wide[:, :HASH_BYTES] = np.frombuffer(r["hashes"], np.uint8).reshape(-1, HASH_BYTES)
            lists.append(wide.view("<u8").ravel())
        flags = shared_flags(lists, [unpack(r["counts"], r["n"]) for r in rows], common)
        return _answer_table([(r["block"], 0, r["part"], r["n"], pack(f)) for r, f in zip(rows, flags)])

    def layout(texts, answers):
        own = Block(texts, length, gram, parts)
        flags = np.zeros(len(own.anchors), np.int64)
        told = {r["part"]: r for r in answers.to_pylist() if r["stage"] == 0}
        for part, at in own.lists():
            flags[at] = unpack(told[part]["body"], told[part]["n"])
        found = own.segments(flags)
        part = part_of(found.key, parts)
        order = np.argsort(part, kind="stable")
        begins = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(order) else np.zeros(0, np.int64)
        return own, found, [(int(part[order[a]]), order[a:b]) for a, b in zip(begins, np.r_[begins[1:], len(order)])]

    def send(texts, answers):
        own, found, lists = layout(texts, answers)
        rows = []
        for part, at in lists:
            own_size = found.size[at]
            body = own.data[np.repeat(found.start[at] - (np.cumsum(own_size) - own_size), own_size) + np.arange(own_size.sum())].tobytes()
            rows.append((
                texts.column("block")[0].as_py(), part, len(at), pack(own_size), pack(found.left[at]), found.key[at].astype("<u8").tobytes(), pack(found.least[at]),
                pa.compress(body, codec="zstd", asbytes=True),
            ))
        columns = list(zip(*rows)) or [[]] * 8
        kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
        return pa.table({name: pa.array(list(c), t) for name, c, t in zip(("block", "part", "n", "sizes", "lefts", "keys", "least", "body"), columns, kinds)})

    def sort(table):
        rows = table.to_pylist()
        sizes = [unpack(r["sizes"], r["n"]) for r in rows]
        bodies = [np.frombuffer(pa.decompress(r["body"], decompressed_size=int(z.sum()), codec="zstd", asbytes=True), np.uint8) for r, z in zip(rows, sizes)]
        data, all_sizes = np.concatenate(bodies), np.concatenate(sizes)
        del bodies
        key = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in rows])
        left, ids = np.concatenate([unpack(r["lefts"], r["n"]) for r in rows]), np.concatenate([unpack(r["least"], r["n"]) for r in rows])
        start = np.cumsum(all_sizes) - all_sizes
        suffixes = SuffixOrder(data, start, all_sizes, length)
        content = mix(suffixes.hashes(start, all_sizes) + all_sizes.astype(np.uint64))
        # Segments that several blocks sent are one before the sort.
        found = distinct_segments(data, start, all_sizes, left, key, content, ids)
        del content
        least = least_ids(suffixes, found.start, found.size, found.left, found.key, found.least)
        count = found.size - length + 1
        begin = np.cumsum(count) - count
        own = count[found.of]
        del suffixes
        kind = np.int32 if own.sum() < 1 << 31 else np.int64
        at = np.arange(own.sum(), dtype=kind)
        at += np.repeat((begin[found.of] - (np.cumsum(own) - own)).astype(kind), own)
        each = least[at]
        del at, least
        arrays.release()
        cuts = np.split(each, np.cumsum([int((z - length + 1).sum()) for z in sizes])[:-1])
        return _answer_table([(r["block"], 1, r["part"], len(c), pack(c)) for r, c in zip(rows, cuts)])

    def finish(texts, answers):
        own, found, lists = layout(texts, answers)
        told = {r["part"]: r for r in answers.filter(pa.compute.equal(answers.column("stage"), 1)).to_pylist()}
        count = found.size - length + 1
        begin = np.empty(len(count), dtype=np.int64)
        least, base = np.empty(count.sum(), dtype=np.int64), 0
        for part, at in lists:
            begin[at] = base + np.cumsum(count[at]) - count[at]
            n = told[part]["n"]
            least[base:base + n] = unpack(told.pop(part)["body"], n)
            base += n
        if base != len(least):
            raise ValueError("the documents changed between two reads: strings of a block without answers")
        # A string starts at a place once, so no place is marked twice.
        edge = np.zeros(len(own.data) + 1, dtype=np.int8)
        for s in range(0, len(found.at), _SLICE // 8):
            of, at = found.of[s:s + _SLICE // 8], found.at[s:s + _SLICE // 8]
            mine = own.ids[np.searchsorted(own.offsets, at, side="right") - 1]
            n = count[of]
            ahead = np.cumsum(n) - n
            step = np.arange(n.sum())
            gone = np.flatnonzero(least[np.repeat(begin[of] - ahead, n) + step] < np.repeat(mine, n))
            where = np.repeat(at - ahead, n)[gone] + gone
            edge[where] += 1
            edge[where + length] -= 1
        removed = np.cumsum(edge[:-1], dtype=np.int32) > 0
        del edge, least, found, lists
        arrays.release()
        a, b, doc = arrays.runs(removed, own.offsets)
        spans = np.searchsorted(doc, np.arange(len(own.ids) + 1))
        offsets = own.offsets.tolist()
        kept = [own.data[x:y][~removed[x:y]].tobytes() for x, y in zip(offsets, offsets[1:])]
        base = own.offsets[doc]
        pairs = pa.StructArray.from_arrays([pa.array(a - base, pa.int64()), pa.array(b - base, pa.int64())], names=["start", "stop"])
        ids = pa.array(own.ids, pa.int64())
        ids = pa.compute.if_else(pa.compute.equal(ids, -(1 << 63)), None, ids)
        return pa.table({
            key: ids.cast(texts_kind), "n_bytes": pa.array(np.diff(own.offsets), pa.int64()),
            "removed": pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pairs), "kept": pa.array(kept, pa.binary()),
        })

    texts_kind = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    told = packed.groupBy("block").applyInArrow(anchors, "block long, part int, n long, hashes binary, counts binary")
    flags = told.repartition(parts, "part").groupBy("part").applyInArrow(share, ANSWER)
    sent = packed.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(
        send, "block long, part int, n long, sizes binary, lefts binary, keys binary, least binary, body binary"
    )
    sorted_ = sent.groupBy("part").applyInArrow(sort, ANSWER)
    answers = flags.unionByName(sorted_)
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, f"{key} {kind}, n_bytes long, removed array<struct<start: bigint, stop: bigint>>, kept binary"
    )


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = repeated_strings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
