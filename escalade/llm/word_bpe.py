"""BPE encoding and decoding over a table of distinct words.

Encoding:

1. Tasks cut texts into blocks of whole documents and each text into words, at
   places where the tokenizer cuts in any context: before a space or line break
   that follows a character which is surely none.  A block numbers its distinct
   words by frequency; words are told apart by 64-bit hashes and then by their bytes.
2. The blocks' words are dealt by their hash, so that each distinct word meets in
   one partition, whose task encodes it once.  A block sends one packed list to
   each part, so a frequent word travels once per block and no key is hot.
3. The ids go back to the blocks, where the word numbers of every document are
   replaced by them, by position.

The blocks are cut twice, for their words and for their numbers, since both
together take more room than the texts.  A block is known by the digest of its
words: if an input were to change between the two, a block would find no ids
and the job would fail, not give wrong ids.

Decoding joins ids with their pieces by the id-to-piece table, which the
vocabulary bounds.  Pieces are bytes; a text is decoded from all its bytes at
once, since a character may span pieces and words.

Special cases: a null text encodes to no ids and decodes to the empty text; the
strings of special tokens in a text become their ids, as the library does;
equal rows are rows of their own; an empty table gives an empty result; other
columns do not matter.  An id outside the vocabulary has no piece and decodes
to nothing.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm import arrays
from escalade.llm.arrays import equal_bytes
from escalade.llm.frames import read

#: Text of a block in bytes, unless one document is longer.
BLOCK_BYTES = 8 << 20
#: Texts are cut and hashed in chunks of about so many bytes: the numbers of a chunk take many times its room.
CHUNK_BYTES = 1 << 17
#: Words that are compared at once.
_SLICE = 1 << 16
#: Words that are encoded in one call.
JOINED = 1000


@lru_cache(maxsize=2)
def tokenizer_of(spec: str):
    """The tokenizer of a JSON file's content, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin: at texts, and at spaces and line breaks after a character that no tokenizer takes for white space.

    Those are the printable ASCII ones and, by their first byte, all others but U+0080 to U+00BF and U+1000 to U+3FFF.
    """
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[at >= 4]
    before = data[at - 1]
    lead = np.where(before >= 0xC0, before, np.where(data[at - 2] >= 0xC0, data[at - 2], np.where(data[at - 3] >= 0xC0, data[at - 3], data[at - 4])))
    safe = np.where(before < 128, (before > 32) & (before < 127), (lead != 0xC2) & ((lead < 0xE1) | (lead > 0xE3)))
    starts = np.unique(np.concatenate([at[safe], offsets[:-1]]))
    return starts[starts < len(data)]


def split_words(text: str) -> list[str]:
    """The words of a text; each can be encoded alone."""
    body = text.encode()
    starts = word_starts(np.frombuffer(body, np.uint8), np.array([0, len(body)])).tolist()
    return [body[a:b].decode() for a, b in zip(starts, [*starts[1:], len(body)])]


def encode_words(words: list[str], tokenizer) -> list[tuple[int, ...]]:
    """The ids of each word.  Words that begin and end safely are encoded many at a time, and told apart by their places."""
    out: list[tuple[int, ...]] = [()] * len(words)
    joint = [k for k, w in enumerate(words) if w[0] in " \n" and "!" <= w[-1] <= "~"]
    alone = sorted(set(range(len(words))).difference(joint))
    for k, e in zip(alone, tokenizer.encode_batch([words[k] for k in alone], add_special_tokens=False)):
        out[k] = tuple(e.ids)
    for begin in range(0, len(joint), JOINED):
        own = joint[begin:begin + JOINED]
        found = tokenizer.encode("".join(words[k] for k in own), add_special_tokens=False)
        ends = np.cumsum([len(words[k]) for k in own])
        cuts = np.searchsorted(np.array([b for _, b in found.offsets]), ends, side="right").tolist()
        ids = found.ids
        for k, a, b in zip(own, [0, *cuts], cuts):
            out[k] = tuple(ids[a:b])
    return out


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def piece_table(spec: str) -> list[bytes]:
    """The bytes of each id, from 0 on; an id that is not in use has none."""
    vocabulary, byte = tokenizer_of(spec).get_vocab(with_added_tokens=True), byte_of_char()
    pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, number in vocabulary.items():
        known = all(c in byte for c in piece)
        pieces[number] = bytes(byte[c] for c in piece) if known else piece.encode()
    return pieces


def _pack(values: np.ndarray) -> bytes:
    """Non-negative integers, the low bytes first and then the higher ones, compressed."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpack(body: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(body, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each hash among the distinct ones in order, where each of those stands first, and how often it stands."""
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    new = np.ones(len(order), dtype=bool)
    for a in range(1, len(order), _SLICE):
        own = order[a:a + _SLICE]
        new[a:a + _SLICE] = hashes[own] != hashes[order[a - 1:a - 1 + len(own)]]
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    of = np.empty(len(order), dtype=np.int32)
    of[order] = number
    return of, order[new], np.diff(np.flatnonzero(new), append=len(new))


class Block:
    """Texts of a batch from place ``first`` on: distinct words by falling frequency, and every text's word numbers."""

    def __init__(self, texts: pa.Array, first: int, block_bytes: int):
        self.first = first
        hashes, starts, sizes, self.counts, bodies, base, rows = [], [], [], [], [], 0, 0
        for chunk in arrays.chunks(texts.slice(first), CHUNK_BYTES):
            if rows and base + len(chunk.data) > block_bytes:
                break
            start = word_starts(chunk.data, chunk.offsets)
            end = np.r_[start[1:], len(chunk.data)][:len(start)]
            # 32 bits hold the places in a block, unless a document is very long.
            kind = np.int32 if base + len(chunk.data) < 1 << 31 else np.int64
            hashes.append(arrays.range_hash(arrays.prefix_hash(chunk.data), start, end))
            starts.append((start + base).astype(kind))
            sizes.append((end - start).astype(kind))
            self.counts += np.bincount(np.searchsorted(chunk.offsets, start, side="right") - 1, minlength=chunk.last - chunk.first).tolist()
            bodies.append(chunk.data)
            base, rows = base + len(chunk.data), chunk.last
        self.last, self.data = first + rows, np.concatenate(bodies)
        del bodies
        start, size = np.concatenate(starts), np.concatenate(sizes)
        del starts, sizes
        hashes = np.concatenate(hashes)
        of, head, often = _numbered(hashes)
        same = np.empty(len(of), dtype=bool)
        for a in range(0, len(of), _SLICE):
            s = slice(a, a + _SLICE)
            here, first_of = size[s] == size[head[of[s]]], start[head[of[s]]]
            here[here] = equal_bytes(self.data, start[s][here], first_of[here], size[s][here])
            same[s] = here
        if not same.all():
            # Words of one hash: give those that differ from the first a hash of their own, from all their bytes.
            digest = [hashlib.blake2b(self.data[a:a + n].tobytes(), digest_size=8).digest() for a, n in zip(start[~same], size[~same])]
            hashes[~same] = np.frombuffer(b"".join(digest), "<u8")
            of, head, often = _numbered(hashes)
        # By falling frequency, and by hash where that is equal.
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(head), dtype=np.int32)
        rank[order] = np.arange(len(head), dtype=np.int32)
        self.numbers, self.hashes = rank[of], hashes[head[order]]
        self.starts, self.sizes = start[head[order]].astype(np.int64), size[head[order]].astype(np.int64)
        digest = hashlib.blake2b(digest_size=8)
        for part in (self.hashes, np.array(self.counts, "<i8"), self.numbers):
            digest.update(np.ascontiguousarray(part))
        self.id = int.from_bytes(digest.digest(), "little", signed=True)

    def parts(self, count: int) -> np.ndarray:
        """The part of each word."""
        return (self.hashes % np.uint64(count)).astype(np.int64)

    def words(self, chosen: np.ndarray) -> bytes:
        """The bytes of words, one after the other."""
        size = self.sizes[chosen]
        return self.data[np.repeat(self.starts[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for batch in batches:
        arrays.release()
        at = 0
        while at < len(batch):
            block = Block(batch.column("text"), at, block_bytes)
            yield batch, block
            at = block.last


def _word_lists(count: int, block_bytes: int):
    """(block, part, n, lengths, size, words): a block's words of one part, in the order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, block_bytes):
            arrays.release()
            parts = block.parts(count)
            order = np.argsort(parts, kind="stable")
            found = np.unique(parts)
            lists = np.split(order, np.searchsorted(parts[order], found[1:]))
            bodies = [block.words(x) for x in lists] if len(found) else []
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block.id] * len(found), pa.int64()), "part": pa.array(found, pa.int32()),
                "n": pa.array([len(x) for x in lists[:len(found)]], pa.int32()), "lengths": pa.array([_pack(block.sizes[x]) for x in lists[:len(found)]], pa.binary()),
                "size": pa.array([len(x) for x in bodies], pa.int64()), "words": pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in bodies], pa.binary()),
            })

    return run


def _encode_lists(spec: str):
    """(block, part, n, lengths, total, ids): the ids of each list; a partition encodes each of its words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays.release()
        tokenizer, known = tokenizer_of(spec), {}
        for batch in batches:
            for row in batch.to_pylist():
                raw = pa.decompress(row["words"], decompressed_size=row["size"], codec="zstd", asbytes=True)
                ends = np.cumsum(_unpack(row["lengths"], row["n"])).tolist()
                words = [raw[a:b] for a, b in zip([0, *ends], ends)]
                new = [w for w in words if w not in known]
                known.update(zip(new, encode_words([w.decode() for w in new], tokenizer)))
                found = [known[w] for w in words]
                ids = np.fromiter(chain.from_iterable(found), dtype=np.int64)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([row["block"]], pa.int64()), "part": pa.array([row["part"]], pa.int32()), "n": pa.array([row["n"]], pa.int32()),
                    "lengths": pa.array([_pack(np.fromiter(map(len, found), dtype=np.int64))], pa.binary()),
                    "total": pa.array([len(ids)], pa.int64()), "ids": pa.array([_pack(ids)], pa.binary()),
                })

    return run


def _numbers(key: str, count: int, block_bytes: int):
    """A row per document with its word numbers, and one per block with the parts of its words (``own`` false)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _blocks(batches, block_bytes):
            arrays.release()
            keys, n = batch.column(key).slice(block.first, block.last - block.first), block.last - block.first
            codes = np.split(block.numbers, np.cumsum(block.counts)[:-1])
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block.id] * (n + 1), pa.int64()), key: pa.concat_arrays([keys, pa.nulls(1, keys.type)]),
                "own": pa.array([True] * n + [False]), "n": pa.array([*block.counts, len(block.hashes)], pa.int32()),
                "codes": pa.array([*map(_pack, codes), _pack(block.parts(count))], pa.binary()),
            })

    return run


def _place(key: str, pieces: list[bytes] | None):
    """Replaces a block's word numbers by the words' ids, and joins the ids to their pieces if these are given."""

    def run(docs, lists):
        if not docs.num_rows:
            raise ValueError("the documents changed between two reads: words of a block without its documents")
        blocks = docs.filter(pa.compute.invert(docs.column("own")))
        docs = docs.filter(docs.column("own"))
        # Equal blocks have equal ids: one answer and one row of parts serve them all.
        n, body = blocks.column("n")[0].as_py(), blocks.column("codes")[0].as_py()
        parts = _unpack(body, n)
        answers = {r["part"]: r for r in lists.to_pylist()}
        if set(answers) != set(np.unique(parts).tolist()):
            raise ValueError("the documents changed between two reads: words of a block without ids")
        order = [answers[k] for k in sorted(answers)]
        in_lists = np.concatenate([_unpack(r["lengths"], r["n"]) for r in order] or [np.zeros(0, np.int64)])
        flat = np.concatenate([_unpack(r["ids"], r["total"]).astype(np.int32) for r in order] or [np.zeros(0, np.int32)])
        del answers, order
        arrays.release()
        at = np.argsort(parts, kind="stable")
        length, start = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        length[at], start[at] = in_lists, np.cumsum(in_lists) - in_lists
        out = []
        for size, codes in zip(docs.column("n").to_pylist(), docs.column("codes").to_pylist()):
            number = _unpack(codes, size)
            own = length[number]
            out.append(flat[np.repeat(start[number] - (np.cumsum(own) - own), own) + np.arange(own.sum())])
        ends = np.cumsum([0, *map(len, out)])
        values = np.concatenate(out) if out else np.zeros(0, np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
        columns = {key: docs.column(key), "ids": ids}
        return pa.table(columns | ({"text": pa.array(join_pieces(ids, piece_array(pieces)), pa.string())} if pieces else {}))

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """(key, ids) of every document: the ids of its whole ``text`` by the byte-level tokenizer file at ``path``.

    ``decoded`` adds the ``text`` that the ids decode to, as :func:`decode` does, in the tasks that make them.
    """
    spec = Path(path).read_text(encoding="utf-8")
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(key, "text")
    # Parts follow the number of shuffle partitions, which follows the size of the data.
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = texts.mapInArrow(_word_lists(count, block_bytes), "block long, part int, n int, lengths binary, size long, words binary")
    answers = lists.repartition("part").mapInArrow(_encode_lists(spec), "block long, part int, n int, lengths binary, total long, ids binary")
    numbers = texts.mapInArrow(_numbers(key, count, block_bytes), f"block long, {key} {kind}, own boolean, n int, codes binary")
    return numbers.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _place(key, piece_table(spec) if decoded else None), f"{key} {kind}, ids array<int>" + ", text string" * decoded
    )


def piece_array(pieces: list[bytes]) -> pa.Array:
    """The id-to-piece table, with the empty piece of unknown ids at the end."""
    return pa.array([*pieces, b""], pa.large_binary())


def join_pieces(ids: pa.ListArray, table: pa.Array) -> list[str]:
    """Joins all ids of a batch to the table at once; a text is read as UTF-8 when its pieces stand together."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    flat = np.where((flat >= 0) & (flat < len(table) - 1), flat, len(table) - 1)
    ends = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())])
    if not len(flat):
        return [""] * len(ids)
    joined = table.take(pa.array(flat, pa.int32()))
    starts, body = np.frombuffer(joined.buffers()[1], "<i8"), joined.buffers()[2].to_pybytes()
    return [body[starts[a]:starts[b]].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text``, the texts of ``ids``; a column of this name is replaced.

    The id-to-piece table has a row per vocabulary entry, which bounds it; it goes to every task, and each batch of ids is
    joined to it as a whole.
    """
    pieces = piece_table(Path(path).read_text(encoding="utf-8"))
    encoded = encoded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_array(pieces)
        for batch in batches:
            texts = pa.array(join_pieces(batch.column("ids"), table), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, text string")


def op3_word_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return encode(read(spark, sf_dir, "documents"), path, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )
