"""Document fingerprints: invertible Bloom lookup sketches over hashed paragraphs.

A text is a set of paragraph digests.  Paragraphs end at line breaks; a long
line is cut further where the text itself says so (after words whose hash is a
multiple of ``CUT``), so that an edit changes the paragraphs around it and no
others.  Equal paragraphs of a text are told apart by their number.

A sketch has three parts of cells.  Every digest goes to one cell of each part
and adds to the cell's count, sum of digests and sum of check values.  Two
versions are compared by subtracting their sketches: what they share cancels
out, and cells with one digest left give it back, which empties other cells in
turn (peeling).  If cells remain, larger sketches of both are made, until all
differing digests are recovered.  The likeness is the share of paragraphs that
did not differ.  The fingerprint is the smallest sketch in hexadecimal digits.

To compare each document with the next one, the table is dealt out in blocks of
neighbours by doc_id: every ``BLOCK_ROWS``-th id is a bound, and the first
document of a block goes along to the block before it.  So the text is shuffled
once and a block has a bounded number of documents.

Special cases: null counts as the empty text, whose sketch is all zeros and
which is alike to another empty text (1.0); a null doc_id comes before all
others; rows with one doc_id are neighbours in the order of their text's hash;
in a table of one document it is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm import arrays
from escalade.llm.frames import read

#: Documents of a block of neighbours.
BLOCK_ROWS = 2048
#: One word in so many ends a paragraph within a line.
CUT = 6
#: Cells of each of the three parts of the smallest sketch, and how much larger the next one is.
CELLS = 4
GROWTH = 4
PARTS = 3

#: The digests of several texts: those of text k are keys[starts[k]:starts[k + 1]].
Keys = tuple[np.ndarray, np.ndarray]


def paragraph_keys(texts: pa.Array) -> Keys:
    """Digests of the paragraphs of each text; the n-th repetition has a digest of its own."""
    keys, counts = [], []
    for chunk in arrays.chunks(texts):
        n = len(chunk.offsets) - 1
        start, end, doc = arrays.runs(~arrays.SPACE[chunk.data], chunk.offsets)
        if not len(start):
            counts.append(np.zeros(n, dtype=np.int64))
            continue
        prefix = arrays.prefix_hash(chunk.data)
        breaks = np.concatenate([[0], np.cumsum(chunk.data == 10)])
        last = arrays.range_hash(prefix, start, end) % np.uint64(CUT) == 0
        last[:-1] |= (doc[1:] != doc[:-1]) | (breaks[start[1:]] != breaks[end[:-1]])
        last[-1] = True
        ends = np.flatnonzero(last)
        begins = np.concatenate([[0], ends[:-1] + 1])
        digest, doc = arrays.range_hash(prefix, start[begins], end[ends]), doc[ends]
        order = np.lexsort((digest, doc))
        digest, doc = digest[order], doc[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])])
        number = np.arange(len(doc)) - np.repeat(new, np.diff(np.r_[new, len(doc)]))
        keys.append(arrays.mix(digest + number.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        counts.append(np.bincount(doc, minlength=n))
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], *([np.cumsum(np.concatenate(counts))] if counts else [])]).astype(np.int64)


def gather(keys: Keys, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the chosen texts, and for each the place of its text in the choice."""
    flat, starts = keys
    length = starts[texts + 1] - starts[texts]
    shift = np.cumsum(length) - length
    return flat[np.repeat(starts[texts] - shift, length) + np.arange(length.sum())], np.repeat(np.arange(len(texts)), length)


def check_value(keys: np.ndarray) -> np.ndarray:
    return arrays.mix(keys ^ np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(0xFFFFFFFF)


def places(keys: np.ndarray, owner: np.ndarray, cells: int, part: int) -> np.ndarray:
    """The digests' cells in one part of their owners' sketches."""
    own = arrays.mix(keys + np.uint64(part + 1 + PARTS * cells)) % np.uint64(cells)
    return owner * (PARTS * cells) + part * cells + own.astype(np.int64)


def add(sketch: np.ndarray, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int, cells: int) -> None:
    """Add digests (sign 1) to sketches or take them away (-1); a sketch's cells are rows of count, digests and checks."""
    sign = np.broadcast_to(np.asarray(sign, dtype=np.int64), keys.shape).astype(np.uint64)
    for part in range(PARTS):
        at = places(keys, owner, cells, part)
        np.add.at(sketch[0], at, sign)
        np.add.at(sketch[1], at, sign * keys)
        np.add.at(sketch[2], at, sign * check_value(keys))


def sketches(keys: Keys, cells: int = CELLS) -> np.ndarray:
    """The sketch of every text, one after the other."""
    n = len(keys[1]) - 1
    sketch = np.zeros((3, n * PARTS * cells), dtype=np.uint64)
    flat, owner = gather(keys, np.arange(n))
    add(sketch, flat, owner, 1, cells)
    return sketch


def peel(sketch: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``n`` subtracted sketches give back: digests, owners, signs, and which sketches came out empty."""
    size = PARTS * cells
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(n * size)
    while len(active):
        count = sketch[0][active].astype(np.int64)
        single = active[np.abs(count) == 1]
        sign = sketch[0][single].astype(np.int64)
        keys = sketch[1][single] * sign.astype(np.uint64)
        pure = sketch[2][single] * sign.astype(np.uint64) == check_value(keys)
        keys, sign, owner = keys[pure], sign[pure], single[pure] // size
        order = np.lexsort((keys, owner))
        keys, sign, owner = keys[order], sign[order], owner[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]) if len(keys) else np.zeros(0, np.int64)
        keys, sign, owner = keys[first], sign[first], owner[first]
        found.append((keys, owner, sign))
        add(sketch, keys, owner, -sign, cells)
        active = np.concatenate([places(keys, owner, cells, part) for part in range(PARTS)])
    empty = ~(sketch != 0).any(axis=0).reshape(n, size).any(axis=1)
    return *(np.concatenate(x) for x in zip(*found)), empty


def differences(left: Keys, right: Keys, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests by which each text on the left differs from its text on the right: digest, pair, sign (1 left, -1 right).

    ``base`` are the subtracted smallest sketches, if at hand.
    """
    n, cells = len(left[1]) - 1, CELLS
    open_ = np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(open_):
        if base is not None:
            sketch, base = base, None
        else:
            sketch = np.zeros((3, len(open_) * PARTS * cells), dtype=np.uint64)
            add(sketch, *gather(left, open_), 1, cells)
            add(sketch, *gather(right, open_), -1, cells)
        keys, owner, sign, done = peel(sketch, len(open_), cells)
        keep = done[owner]
        out.append((keys[keep], open_[owner[keep]], sign[keep]))
        open_ = open_[~done]
        cells *= GROWTH
    return tuple(np.concatenate(x) for x in zip(*out))


def likeness(left: Keys, right: Keys, base: np.ndarray | None = None) -> np.ndarray:
    """The share of paragraphs of each two texts that did not differ."""
    total = np.diff(left[1]) + np.diff(right[1])
    differing = np.bincount(differences(left, right, base)[1], minlength=len(total))
    return np.where(total > 0, 1 - differing / np.maximum(total, 1), 1.0)


def fingerprint_text(sketch: np.ndarray, n: int) -> list[str]:
    """Sketches as hexadecimal digits: per cell the count (4 bytes), digests (8) and checks (8)."""
    cells = np.zeros(sketch.shape[1], dtype=np.dtype([("count", ">i4"), ("keys", ">u8"), ("checks", ">u8")]))
    cells["count"], cells["keys"], cells["checks"] = sketch[0].astype(np.int64), sketch[1], sketch[2]
    body, size = cells.tobytes().hex(), 2 * cells.dtype.itemsize * (sketch.shape[1] // max(n, 1))
    return [body[k * size:(k + 1) * size] for k in range(n)]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` to the documents."""
    @F.pandas_udf("string")
    def sketch_text(texts: pd.Series) -> pd.Series:
        keys = paragraph_keys(pa.array(texts, pa.string()))
        return pd.Series(fingerprint_text(sketches(keys), len(texts)), dtype=object)

    return docs.withColumn("fingerprint", sketch_text(F.col(text)))


def compare_versions(versions: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Adds the digests that only one version has (``only_old``, ``only_new``) and the versions' ``likeness``."""
    @F.pandas_udf("only_old array<long>, only_new array<long>, likeness double")
    def recover(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        left, right = paragraph_keys(pa.array(a, pa.string())), paragraph_keys(pa.array(b, pa.string()))
        digest, pair, sign = differences(left, right)
        lists = [[sorted(digest[(pair == k) & (sign == s)].view(np.int64).tolist()) for k in range(len(a))] for s in (1, -1)]
        return pd.DataFrame({"only_old": lists[0], "only_new": lists[1], "likeness": likeness(left, right)})

    rest = [c for c in versions.columns if c not in ("only_old", "only_new", "likeness")]
    return versions.withColumn("__r", recover(F.col(old), F.col(new))).select(*rest, "__r.*")


def _bounds(docs: DataFrame, key: str, block_rows: int) -> np.ndarray:
    """Every ``block_rows``-th id of each sorted range, and the least one: ids at which blocks begin."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            first = -seen % block_rows
            seen += len(batch)
            yield batch.take(pa.array(np.arange(first, len(batch), block_rows)))

    ids = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"))
    return np.unique(ids.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(pick, "k long").toPandas()["k"].to_numpy())


def neighbour_blocks(docs: DataFrame, key: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """(block, guest, k, h, key, text): documents in blocks of neighbours, the next block's first ones as guests."""
    bounds = _bounds(docs, key, block_rows)
    if not len(bounds):
        return None

    @F.pandas_udf("array<int>")
    def blocks(k: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, k.to_numpy(), side="right") - 1
        first = bounds[own] == k.to_numpy()
        return pd.Series([[b, (b - 1) % len(bounds)] if f else [b] for b, f in zip(own.tolist(), first)])

    keyed = docs.select(key, "text", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h"))
    return keyed.select(F.posexplode(blocks("k")).alias("guest", "block"), "k", "h", key, "text")


def _edited_block(key: str):
    def run(table):
        table = table.sort_by([("guest", "ascending"), ("k", "ascending"), ("h", "ascending")])
        n = int((table.column("guest").to_numpy() == 0).sum())
        texts = [t or "" for t in table.column("text").slice(0, n + 1).to_pylist()]
        edited = [t[:len(t) - len(t) // 4] + other[:len(t) // 4] for t, other in zip(texts[:n], texts[1:])]
        every, other = paragraph_keys(pa.array(texts, pa.large_string())), paragraph_keys(pa.array(edited, pa.large_string()))
        own = (every[0][:every[1][n]], every[1][:n + 1])
        following = (every[0][every[1][1]:], every[1][1:] - every[1][1])
        base, changed = sketches(every), sketches(other)
        size = PARTS * CELLS
        return pa.table({
            key: table.column(key).slice(0, n),
            "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array(fingerprint_text(base, n + 1)[:n], pa.string()),
            "edited_fingerprint": pa.array(fingerprint_text(changed, n), pa.string()),
            "near_edited": pa.array(likeness(own, other, base[:, :n * size] - changed)),
            "near_next": pa.array(likeness(own, following, base[:, :n * size] - base[:, size:])),
        })

    return run


def edited_versions(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's fingerprint beside that of its edited version, and its likeness to that and to the next document.

    The edited version has the last quarter of the code points (rounded down) replaced by the first as many of the next document.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    blocks = neighbour_blocks(docs, key)
    if blocks is None:
        return docs.sparkSession.createDataFrame([], schema)
    return blocks.groupBy("block").applyInArrow(_edited_block(key), schema)


def op1_bloom_lookup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return edited_versions(read(spark, sf_dir, "documents").select("doc_id", "text"))
