"""Fill-in-middle transformation by a secondary sort of pieces.

A text is cut into units, a word with the white space before it (and the white
space at the end of the text), and at two random unit boundaries into prefix,
middle and suffix.  A part of the texts is written anew with a mark before each
part: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm) or ``<S>`` suffix ``<P>``
prefix ``<M>`` middle (spm).

1. Each task cuts its texts into pieces of whole units, of about ``PIECE_BYTES``
   at most, keyed by document and place in the output; the marks are pieces too.
2. ``repartition`` and ``sortWithinPartitions`` bring the pieces of a document
   together in the order of the output (the secondary sort); a task streams them
   into an incremental digest, so no document is put together in memory.
3. The reader of that stream knows the output only: from the marks it tells
   which part a piece belongs to, and hands it on with the place of that part in
   the text.  A second sort by that place streams the restored text into its digest.

A plain text is its own output and needs no sort: only its head (a row without a
piece) travels.  Draws come from the SHA-256 of seed and doc_id, so reruns and
retries agree.  The key is a row's own number, so equal rows and equal doc_ids
never meet in one group.

Special cases: a null text counts as empty; an empty text, or one that holds a
mark, stays plain; a null doc_id is written as the empty string; rows that repeat
doc_id and text get the same result each.  The numbers of rows are those of the
scan: an input that is no table of files should be settled first, as a lost task
must number its rows alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm import arrays
from escalade.llm.frames import read

SEED = 42
#: Per cent of the texts that are transformed, and of those the ones in spm order.
RATE = 50
SPM = 80
PREFIX, SUFFIX, MIDDLE = MARKS = (b"<P>", b"<S>", b"<M>")
PIECE_BYTES = 1 << 16
#: Bytes of pieces in an Arrow batch of the first step.
BATCH_BYTES = 1 << 22
#: Order of the parts in the text; heads stand before all pieces.
HEAD, RANK = -1, {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

_HEAD = "row long, doc_id {id}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"
_PIECES = f"{_HEAD}, rank int, place long, piece binary"
_RESULT = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def unit_ends(chunk: arrays.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Byte place of the end of every unit of a chunk of texts, and the first unit of each text (and one after the last)."""
    _, ends, doc = arrays.runs(~arrays.SPACE[chunk.data], chunk.offsets)
    # What follows the last word is white space only: a unit of its own.
    sizes = np.diff(chunk.offsets)
    last = chunk.offsets[:-1].copy()
    last[doc] = ends
    tail = np.flatnonzero((sizes > 0) & (last < chunk.offsets[1:]))
    ends, doc = np.r_[ends, chunk.offsets[tail + 1]], np.r_[doc, tail]
    order = np.lexsort((ends, doc))
    return ends[order], np.searchsorted(doc[order], np.arange(len(sizes) + 1))


def _cut(rate: int, spm: int, kind: pa.DataType):
    """Texts to heads and pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
            for chunk in arrays.chunks(batch.column("text"), BATCH_BYTES):
                ends, first = unit_ends(chunk)
                chars = np.r_[0, np.cumsum((chunk.data & 0xC0) != 0x80)]
                of = slice(chunk.first, chunk.last)
                ids = batch.column("doc_id")[of].to_pylist()
                numbers = batch.column("row")[of].to_pylist()
                heads, pieces = [], []
                for k, (h1, h2, h3, h4) in enumerate(zip(*(d[of].tolist() for d in draws))):
                    begin, end, n = int(chunk.offsets[k]), int(chunk.offsets[k + 1]), int(first[k + 1] - first[k])
                    text = chunk.data[begin:end].tobytes()
                    if not text or h3 % 100 >= rate or any(mark in text for mark in MARKS):
                        heads.append((numbers[k], ids[k], n, "plain", None, None, hashlib.sha256(text).hexdigest(), HEAD, HEAD, None))
                        continue
                    places = [begin, *(begin if u == 0 else int(ends[first[k] + u - 1]) for u in sorted((h1 % (n + 1), h2 % (n + 1)))), end]
                    form = "spm" if h4 % 100 < spm else "psm"
                    count = [int(chars[b] - chars[a]) for a, b in zip(places[:2], places[1:3])]
                    heads.append((numbers[k], ids[k], n, form, *count, None, HEAD, HEAD, None))
                    parts = {PREFIX: (places[0], places[1]), MIDDLE: (places[1], places[2]), SUFFIX: (places[2], places[3])}
                    own = ends[first[k]:first[k + 1]]
                    place = 0
                    for mark in ((PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)):
                        for piece in (mark, *_chunks(chunk.data, *parts[mark], own)):
                            pieces.append((numbers[k], 0, place, piece))
                            place += 1
                yield _rows(heads, pieces, kind)

    return run


def _chunks(data: np.ndarray, begin: int, end: int, ends: np.ndarray) -> Iterator[bytes]:
    """A part in pieces of whole units, as many as fit into a piece, but one at least."""
    while begin < end:
        upto = int(ends[max(np.searchsorted(ends, begin + PIECE_BYTES, side="right") - 1, np.searchsorted(ends, begin, side="right"))])
        upto = min(upto, end)
        yield data[begin:upto].tobytes()
        begin = upto


def _rows(heads: list[tuple], pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    row, ids, n, form, prefix, middle, digest, rank, place, piece = ([h[c] for h in heads] for c in range(10))
    none = [None] * len(pieces)
    return pa.RecordBatch.from_pydict({
        "row": pa.array(row + [p[0] for p in pieces], pa.int64()), "doc_id": pa.array(ids + none, kind), "n": pa.array(n + none, pa.int64()),
        "form": pa.array(form + none, pa.string()), "prefix_chars": pa.array(prefix + none, pa.int64()), "middle_chars": pa.array(middle + none, pa.int64()),
        "output_sha256": pa.array(digest + none, pa.string()), "rank": pa.array(rank + [p[1] for p in pieces], pa.int32()),
        "place": pa.array(place + [p[2] for p in pieces], pa.int64()), "piece": pa.array(piece + [p[3] for p in pieces], pa.binary()),
    })


def _write(kind: pa.DataType):
    """Streams outputs into their digests; heads go on with the digest, pieces with the rank of their part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, rank = None, None, None
        for batch in batches:
            heads, pieces = [], []
            columns = [batch.column(c).to_pylist() for c in ("row", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")]
            for k, (row, place, piece) in enumerate(zip(columns[0], batch.column("place").to_pylist(), batch.column("piece").to_pylist())):
                if place == HEAD:
                    if head is not None:
                        heads.append(_finished(head, digest))
                    head, digest, rank = tuple(c[k] for c in columns), hashlib.sha256(), None
                    continue
                digest.update(piece)
                if piece in RANK:
                    rank = RANK[piece]
                else:
                    pieces.append((row, rank, place, piece))
            yield _rows(heads, pieces, kind)
        if head is not None:
            yield _rows([_finished(head, digest)], [], kind)

    return run


def _finished(head: tuple, digest) -> tuple:
    *rest, known = head
    return (*rest, known or digest.hexdigest(), HEAD, HEAD, None)


def _restore(kind: pa.DataType):
    """Streams the parts in the order of the text into their digests, one row per document."""
    def result(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([d[c] for d in done], t) for c, t in enumerate((kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest = None, None
        names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in names]
            for k, (rank, piece) in enumerate(zip(batch.column("rank").to_pylist(), batch.column("piece").to_pylist())):
                if rank == HEAD:
                    if head is not None:
                        done.append(_told(head, digest))
                    head, digest = tuple(c[k] for c in columns), hashlib.sha256()
                else:
                    digest.update(piece)
            yield result(done)
        if head is not None:
            yield result([_told(head, digest)])

    return run


def _told(head: tuple, digest) -> tuple:
    # A plain text is its own output.
    return (*head, head[5] if head[2] == "plain" else digest.hexdigest())


def cut_texts(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Heads (rank -1, one per document) and pieces (row, place, piece) of the outputs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(named, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *draws)
    return rows.mapInArrow(_cut(rate, spm, _arrow(docs)), _PIECES.format(id=kind))


def _arrow(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def assembled(pieces: DataFrame) -> DataFrame:
    """The outputs as (row, place, piece) in order within each partition: concatenated by row, they are the texts."""
    return pieces.where("piece is not null").select("row", "place", "piece").repartition("row").sortWithinPartitions("row", "place")


def digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every document."""
    kind, arrow = docs.schema["doc_id"].dataType.simpleString(), _arrow(docs)
    pieces = cut_texts(docs, seed, rate, spm).repartition("row").sortWithinPartitions("row", "place")
    written = pieces.mapInArrow(_write(arrow), _PIECES.format(id=kind))
    parts = written.repartition("row").sortWithinPartitions("row", "rank", "place")
    return parts.mapInArrow(_restore(arrow), _RESULT.format(id=kind))


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    """The digests of all documents."""
    return digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


_DRAW = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
#: The same in SQL; the restored text is the text.
SQL = rf"""
WITH d AS (SELECT coalesce(text, '') AS text, doc_id, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
c AS (SELECT *, len(u) AS n, {_DRAW.format(1)} % (len(u) + 1) AS a, {_DRAW.format(9)} % (len(u) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_DRAW.format(17)} % 100 >= 50 THEN 'plain'
       WHEN {_DRAW.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS prefix, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
  coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
