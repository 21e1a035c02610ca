"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles.

1. Equal texts are one node: their least doc_id.
2. A word's document frequency is counted over all documents in a hashed
   vocabulary of ``VOCABULARY`` places, which bounds the broadcast table; tasks
   add up their own counts first.  A shingle of five words weighs its count
   times the mean inverse document frequency of its words.
3. Improved consistent weighted sampling draws one shingle per hash function so
   that two texts draw the same with a probability of their weighted Jaccard
   similarity.  ``BANDS`` bands of ``ROWS`` draws make the candidate buckets; two
   texts of similarity 0.8 share a bucket with a probability of 0.9998.
4. Most of a class is joined by few comparisons: each node with the least one of
   its buckets in the first bands; what this joins counts as one in the buckets of
   all bands, where it is compared with the bucket's ends.
5. Then all pairs of nodes that share a bucket and are not in one class yet are
   compared.  A bucket of up to ``FEW`` nodes emits its pairs.  The nodes of larger
   ones meet by a weighted prefix filter, which loses no pair: in a common order,
   rarest first, two texts at or over the threshold share a shingle among those
   before which at most a share of 1 - threshold of the weight stands.  What
   stands before the first common one bounds the shared weight, and so do the
   whole weights: both drop pairs, groups and blocks that cannot reach the
   threshold before any text is moved.  Shingles of up to ``MANY`` nodes emit
   the other pairs; nodes of others are dealt out as pairs of blocks, where a task
   looks at weights and bands alone.  It names the pairs that are left, or, if they
   are many, has all texts of the two blocks compared by matrix products.
6. Links are joined to classes by their least doc_id.

Pairs are verified by the weighted Jaccard similarity of their whole texts.  A hot
bucket or copied text combines map-side and is joined by ``join_counted``; texts are
joined to pairs by equi-joins on doc_id, whose hot partitions can be split, as the
texts stand in a written table.

Special cases: texts are compared by their words without punctuation, ASCII
letters in lower case; a text of fewer than five words is one shingle; a text
without words, or null, is a class of its own even if repeated, and so is a row
with a null doc_id (class null, kept); rows that repeat doc_id and text get the
same result; a doc_id that stands on several texts joins their classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm import arrays
from escalade.llm.arrays import Chunk
from escalade.llm.frames import components, join_counted, pick, read, settle

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 12
ROWS = 3
#: Bands that join most of a class before the others are looked at.
FIRST_BANDS = 4
#: Nodes of a bucket that emits all its pairs.
FEW = 8
#: Nodes of a prefix shingle that emits all its pairs, and of a block where there are more.
MANY = 64
BLOCK = 512
#: Pairs of two blocks, a node, that are verified one by one; where there are more, all texts of the blocks are compared.
PAIRS = 16
#: Places of the hashed shingles that the order of the prefixes counts.
PLACES = 1 << 20
#: Columns of a matrix product.
_COLUMNS = 4096
#: Places of the hashed vocabulary (a power of two).
VOCABULARY = 1 << 18
_SHIFT = np.uint64(64 - 18)
_LEVELS = 1 << 16


@lru_cache(maxsize=1)
def _quantiles() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """65,536 even quantiles of Gamma(2, 1), their logarithms, and of the uniform distribution."""
    share = (np.arange(_LEVELS) + 0.5) / _LEVELS
    low, high = np.zeros(_LEVELS), np.full(_LEVELS, 64.0)
    for _ in range(64):
        middle = (low + high) / 2
        under = 1 - np.exp(-middle) * (1 + middle) < share
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return high, np.log(high), share


def weighted_shingles(chunk: Chunk, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and TF-IDF weight of every distinct shingle, sorted by text and hash."""
    found = arrays.words(chunk)
    all_ = arrays.shingles(found, SHINGLE)
    if not len(all_.doc):
        return all_.doc, all_.hashes, np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(idf[(found.hashes >> _SHIFT).astype(np.int64)])])
    mean = (total[all_.first + all_.size] - total[all_.first]) / all_.size
    order = np.lexsort((all_.hashes, all_.doc))
    doc, hashes = all_.doc[order], all_.hashes[order]
    begins = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])
    count = np.diff(np.r_[begins, len(doc)])
    # The words' mean comes from a running sum; rounding it keeps equal shingles at equal weights.
    return doc[begins], hashes[begins], count * np.round(mean[order][begins], 6)


def band_keys(chunk: Chunk, idf: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band keys per text; texts without words have a row of zeros."""
    doc, hashes, weight = weighted_shingles(chunk, idf)
    keys = np.zeros((len(chunk.offsets) - 1, bands), dtype=np.uint64)
    if not len(doc):
        return keys
    r, log_c, beta = _quantiles()
    begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    group = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(doc)]))
    log_weight = np.log(weight)
    for band in range(bands):
        key = np.full(len(begins), band + 1, dtype=np.uint64)
        for row in range(rows):
            seed = arrays.mix(np.array([band * rows + row + 1], dtype=np.uint64))
            draw = arrays.mix(hashes ^ seed)
            own_r = r[(draw & np.uint64(_LEVELS - 1)).astype(np.int64)]
            own_b = beta[(draw >> np.uint64(16) & np.uint64(_LEVELS - 1)).astype(np.int64)]
            level = np.floor(log_weight / own_r + own_b)
            rank = log_c[(draw >> np.uint64(32) & np.uint64(_LEVELS - 1)).astype(np.int64)] - own_r * (level - own_b + 1)
            least = np.flatnonzero(rank == np.minimum.reduceat(rank, begins)[group])
            first = least[np.r_[True, group[least[1:]] != group[least[:-1]]]]
            key = arrays.mix(key ^ hashes[first] + arrays.mix(level[first].astype(np.int64).astype(np.uint64)))
        keys[doc[begins], band] = key
    return keys


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's document frequencies by place of the vocabulary; place -1 counts documents."""
    total, docs = np.zeros(VOCABULARY, dtype=np.int64), 0
    for batch in batches:
        for chunk in arrays.chunks(batch.column("text")):
            found = arrays.words(chunk)
            place = np.unique(found.doc.astype(np.int64) * VOCABULARY + (found.hashes >> _SHIFT).astype(np.int64))
            total += np.bincount(place % VOCABULARY, minlength=VOCABULARY)
            docs += len(chunk.offsets) - 1
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"place": pa.array(np.r_[-1, used], pa.int32()), "n": pa.array(np.r_[docs, total[used]], pa.int64())})


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln((documents + 1) / (frequency + 1)) + 1 for each place of the hashed vocabulary."""
    rows = docs.select("text").mapInArrow(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    n = int(rows.loc[rows["place"] == -1, "n"].sum())
    frequency = np.zeros(VOCABULARY)
    rows = rows[rows["place"] >= 0]
    frequency[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return np.log((n + 1) / (frequency + 1)) + 1


def _bands(idf, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            for chunk in arrays.chunks(batch.column("text")):
                keys = band_keys(chunk, table, bands, rows).view(np.int64)
                has = np.flatnonzero(keys.any(axis=1))
                places = chunk.offsets.tolist()
                digests = [hashlib.blake2b(chunk.data[places[k]:places[k + 1]].tobytes(), digest_size=16).digest() for k in has.tolist()]
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").slice(chunk.first, chunk.last - chunk.first).take(pa.array(has)), "digest": pa.array(digests, pa.binary()),
                    "bands": pa.FixedSizeListArray.from_arrays(pa.array(keys[has].ravel()), bands).cast(pa.list_(pa.int64())),
                })

    return run


def similarities(left: Chunk, right: Chunk, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each text on the left with its text on the right."""
    n = len(left.offsets) - 1
    a, b = weighted_shingles(left, idf), weighted_shingles(right, idf)
    doc, hashes, weight = (np.concatenate(x) for x in zip(a, b))
    total = np.bincount(doc, weights=weight, minlength=n)
    order = np.lexsort((hashes, doc))
    doc, hashes, weight = doc[order], hashes[order], weight[order]
    both = np.flatnonzero((doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1]))
    shared = np.bincount(doc[both], weights=np.minimum(weight[both], weight[both + 1]), minlength=n)
    return shared / np.maximum(total - shared, 1e-300)


def all_similarities(chunk: Chunk, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each two different texts of a chunk (the diagonal is not filled)."""
    n = len(chunk.offsets) - 1
    doc, hashes, weight = weighted_shingles(chunk, idf)
    total = np.bincount(doc, weights=weight, minlength=n)
    shared = np.zeros((n, n))
    _, column = np.unique(hashes, return_inverse=True)
    taken = np.zeros(len(doc))
    while len(doc):
        # The least weight that a shingle still has is shared by all texts that have it; what is left of the others is the next layer.
        several = np.bincount(column)[column] > 1
        doc, weight, taken = doc[several], weight[several], taken[several]
        _, column = np.unique(column[several], return_inverse=True)
        if not len(doc):
            break
        least = np.full(column.max() + 1, np.inf)
        np.minimum.at(least, column, weight)
        root = np.sqrt(least[column] - taken)
        order = np.argsort(column, kind="stable")
        for begin in range(0, len(least), _COLUMNS):
            some = order[slice(*np.searchsorted(column[order], [begin, begin + _COLUMNS]))]
            matrix = np.zeros((n, min(_COLUMNS, len(least) - begin)))
            matrix[doc[some], column[some] - begin] = root[some]
            shared += matrix @ matrix.T
        more = weight > least[column]
        doc, weight, taken, column = doc[more], weight[more], least[column][more], column[more]
    return shared / np.maximum(total[:, None] + total[None, :] - shared, 1e-300)


def _shingle_counts(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, dtype=np.int64)
        for batch in batches:
            for chunk in arrays.chunks(batch.column("text")):
                _, hashes, _ = weighted_shingles(chunk, idf.value)
                total += np.bincount((hashes % np.uint64(PLACES)).astype(np.int64), minlength=PLACES)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    return run


def prefixes(chunk: Chunk, idf: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of the rarest shingles, the text's weight and that before the shingle: two texts at or over the threshold share one."""
    doc, hashes, weight = weighted_shingles(chunk, idf)
    rare = counts[(hashes % np.uint64(PLACES)).astype(np.int64)]
    order = np.lexsort((hashes, rare, doc))
    doc, hashes, weight, rare = doc[order], hashes[order], weight[order], rare[order]
    total = np.bincount(doc, weights=weight, minlength=len(chunk.offsets) - 1)
    upto = np.cumsum(weight) - weight
    before = upto - (np.cumsum(total) - total)[doc]
    # What only one text has needs no row.
    chosen = (before <= (1 - threshold + 1e-6) * total[doc] + 1e-6) & (rare > 1)
    return doc[chosen], hashes[chosen], total[doc[chosen]], before[chosen]


def _prefixes(idf, counts, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in arrays.chunks(batch.column("text")):
                doc, hashes, total, before = prefixes(chunk, idf.value, counts.value, threshold)
                rows = batch.select(["node", "label"]).slice(chunk.first, chunk.last - chunk.first).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(hashes.view(np.int64)), pa.array(total), pa.array(before)], names=["node", "label", "shingle", "total", "before"]
                )

    return run


def _verify(idf, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            for chunk in arrays.chunks(batch.column("text_a"), arrays.CHUNK_BYTES // 2):
                other = batch.column("text_b").slice(chunk.first, chunk.last - chunk.first)
                (right,) = arrays.chunks(other, 1 << 62)
                found = similarities(chunk, right, table)
                rows = batch.select(["a", "b"]).slice(chunk.first, chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found), pa.array(found >= threshold)], names=["a", "b", "similarity", "linked"])

    return run


def _ends(members: DataFrame) -> DataFrame:
    """Buckets of several nodes: (bucket, node, low, high)."""
    ends = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low <> high")
    return join_counted(members, settle(ends, "ends"), "bucket")


def _pairs(paired: DataFrame) -> DataFrame:
    """Each node with both ends of its buckets, as (a, b) with a < b."""
    each = paired.select("node", F.explode(F.array("low", "high")).alias("end")).where("node <> end")
    return each.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()


def _all_pairs(members: DataFrame, key: str | list[str], threshold: float | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of different labels in each of the (small) groups.

    With a threshold, members have ``total`` and ``before`` at the group's shingle,
    and only pairs that can reach it are made.
    """
    more = [] if threshold is None else ["total", "before"]
    x = members.groupBy(key).agg(F.collect_set(F.struct("node", "label", *more)).alias("all")).select("all", F.explode("all").alias("x"))
    pairs = x.select("x", F.explode("all").alias("y")).where("x.node < y.node and x.label <> y.label")
    if threshold is not None:
        pairs = pairs.where(_reach(F.col("x"), F.col("y"), threshold))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _reach(x, y, threshold: float):
    """Whether two texts whose first common shingle this is can be at or over the threshold.

    The lesser weight is at most the similarity's share of the greater one; and
    what they share stands at or behind that shingle in both.
    """
    low, high = F.least(x["total"], y["total"]), F.greatest(x["total"], y["total"])
    left = F.least(x["total"] - x["before"], y["total"] - y["before"])
    return (low >= threshold * high * (1 - 1e-6)) & (left * (1 + 1e-6) >= threshold / (1 + threshold) * (low + high))


def _groups(marks: DataFrame, threshold: float) -> DataFrame:
    """(shingle, n) of the groups with two labels and a node that can be the lighter one of a pair; of those of the same nodes, the first shingle's."""
    # The lighter one shares more than half of a sum of two weights, neither of them below its own.
    lighter = F.col("before") <= ((1 - threshold) / (1 + threshold) + 1e-6) * F.col("total") + 1e-6
    found = marks.groupBy("shingle").agg(
        F.count("*").alias("n"), F.count_if(lighter).alias("lighter"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum("before").alias("before"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ).where("low <> high and lighter > 0")
    # Shingles stand in one order in all texts: among those of the same nodes, the first has the least before it.
    return found.groupBy("n", "x", "y").agg(F.min_by("shingle", "before").alias("shingle")).select("shingle", "n")


def _block_pairs(members: DataFrame) -> DataFrame:
    """The members (shingle, node, label, ...) of each two blocks that are to be compared: adds low, high (the blocks) and own; written."""
    # A label with many nodes has blocks of its own, which are not compared with each other.
    members = settle(members, "dense")
    labels = settle(members.groupBy("shingle", "label").agg(F.count("*").alias("n")), "labels")
    pools = labels.where(F.col("n") <= BLOCK).groupBy("shingle").agg(F.ceil(F.sum("n") / BLOCK).alias("pools"))
    labels = settle(labels.join(pools, "shingle", "left").withColumn("big", F.when(F.col("n") > BLOCK, F.col("label"))).withColumn("parts", F.ceil(F.col("n") / BLOCK)), "labels")
    own = F.when(F.col("big").isNotNull(), F.xxhash64("big", F.pmod(F.xxhash64("node"), "parts"))).otherwise(F.pmod(F.xxhash64("label"), "pools"))
    dealt = join_counted(members, labels, ["shingle", "label"])
    dealt = settle(dealt.select(*members.columns, "big", own.alias("own")), "blocks")
    blocks = dealt.select("shingle", F.col("own").alias("other"), F.col("big").alias("other_big")).distinct()
    met = dealt.join(blocks, "shingle").where("big is null or other_big is null or big <> other_big")
    return met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("big", "other", "other_big")


def _two_blocks(key, ids: np.ndarray, labels: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which pairs of rows are pairs of two labels, and of two blocks if there are two."""
    apart = (labels[:, None] != labels[None, :]) & (ids[:, None] < ids[None, :])
    return apart & (own[:, None] != own[None, :]) if key[1].as_py() != key[2].as_py() else apart


def _candidates(met: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(shingle, low, high, a, b): pairs of two blocks that share a bucket and can reach the threshold by their weights.

    Two blocks with more of them than ``PAIRS`` a node give one row without a pair: all their texts are compared.
    """
    def choose(key, table):
        ids, labels, own, total, before = (table.column(c).to_numpy() for c in ("node", "label", "own", "total", "before"))
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        left = total - before
        found = _two_blocks(key, ids, labels, own)
        found &= np.minimum(total[:, None], total) >= threshold * np.maximum(total[:, None], total) * (1 - 1e-6)
        found &= np.minimum(left[:, None], left) * (1 + 1e-6) >= threshold / (1 + threshold) * (total[:, None] + total)
        a, b = np.nonzero(found)
        shared = np.zeros(len(a), dtype=bool)
        for band in bands.T:
            shared |= band[a] == band[b]
        a, b = a[shared], b[shared]
        pairs = (ids[a], ids[b]) if len(a) <= PAIRS * len(ids) else ([None], [None])
        n = len(pairs[0])
        return pa.table({
            "shingle": pa.array([key[0].as_py()] * n, pa.int64()), "low": pa.array([key[1].as_py()] * n, pa.int64()), "high": pa.array([key[2].as_py()] * n, pa.int64()),
            "a": pa.array(pairs[0], table.schema.field("node").type), "b": pa.array(pairs[1], table.schema.field("node").type),
        })

    return met.groupBy("shingle", "low", "high").applyInArrow(choose, f"shingle long, low long, high long, a {kind}, b {kind}")


def _block_links(met: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b, similarity) between nodes of different labels, all texts of two blocks at once."""
    kind = met.schema["node"].dataType.simpleString()

    def compare(key, table):
        ids, labels, own = (table.column(c).to_numpy() for c in ("node", "label", "own"))
        (chunk,) = arrays.chunks(table.column("text"), 1 << 62)
        found = all_similarities(chunk, idf.value)
        a, b = np.nonzero((found >= threshold) & _two_blocks(key, ids, labels, own))
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b]), "similarity": pa.array(found[a, b], pa.float64())})

    own_texts = pick(texts, settle(met.select("node").distinct(), "ids"), "node").select("node", "text").distinct()
    rows = met.select("shingle", "low", "high", "own", "node", "label").join(own_texts, "node")
    return rows.groupBy("shingle", "low", "high").applyInArrow(compare, f"a {kind}, b {kind}, similarity double").distinct()


def near_links(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(key, node) of every document with words, and the verified links (a, b, similarity) between nodes."""
    spark = docs.sparkSession
    texts = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).alias("id"), "text")
    idf = spark.sparkContext.broadcast(inverse_frequencies(texts))
    kind = docs.schema[key].dataType.simpleString()
    signed = settle(texts.mapInArrow(_bands(idf, bands, rows), f"id {kind}, digest binary, bands array<long>"), "bands")
    nodes = settle(signed.groupBy("digest").agg(F.min("id").alias("node"), F.any_value("bands").alias("bands"), F.count("*").alias("n")), "nodes")
    # A text that nothing repeats is its own node.
    several = join_counted(signed.select("id", "digest"), nodes.where("n > 1").select("digest", "node", "n"), "digest").select(F.col("id").alias(key), "node")
    membership = several.unionByName(nodes.where("n = 1").select(F.col("node").alias(key), "node"))

    def judge(pairs: DataFrame, source: DataFrame, name: str) -> DataFrame:
        sides = pairs.join(source.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        sides = sides.join(source.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        judged = sides.mapInArrow(_verify(idf, threshold), f"a {kind}, b {kind}, similarity double, linked boolean")
        return settle(judged.where("linked").select("a", "b", "similarity"), name)

    def pool(pairs: DataFrame) -> DataFrame:
        ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        return settle(pick(texts, ids, "id"), "pool")

    # First each node with the least one that it meets in the first bands, which joins most of a class.
    early = _ends(nodes.select("node", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("bucket")).distinct())
    least = settle(early.where("node > low").groupBy(F.col("node").alias("b")).agg(F.min("low").alias("a")), "pairs")
    first = judge(least, pool(least), "links")
    label = first.select(F.col("b").alias("node"), F.col("a").alias("label"))
    further = first.select(F.col("b").alias("label"), F.col("a").alias("next"))
    label = label.join(further, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    # Then, in all bands, the least node of every label: what hangs on one label is joined already.
    named = nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.explode("bands").alias("bucket"))
    paired = settle(_ends(named.groupBy("bucket", "label").agg(F.min("node").alias("node")).select("bucket", "node")), "buckets")
    pairs = settle(_pairs(paired).join(least, ["a", "b"], "left_anti"), "pairs")
    held = pool(pairs)
    second = judge(pairs, held, "links")
    links = first.unionByName(second)
    # All other pairs that share a bucket and are not in one class yet.
    label = components(links.select("a", "b")).select("node", F.col("component").alias("label"))
    named = nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.explode("bands").alias("bucket")).distinct()
    sizes = named.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = settle(sizes.where("low <> high").select("bucket", "n", F.col("n").alias("rows")), "sizes")
    mixed = settle(join_counted(named, sizes, "bucket", "rows"), "mixed")
    crowd = settle(mixed.where(F.col("n") > FEW).select("node", "label").distinct(), "crowd-nodes")
    crowded = settle(pick(texts.withColumnRenamed("id", "node"), crowd, "node", "inner").select("node", "label", "text"), "crowd")
    counted = crowded.select("text").mapInArrow(_shingle_counts(idf), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(PLACES, dtype=np.int32)
    counts[counted["place"].to_numpy(dtype=np.int64)] = np.minimum(counted["n"].to_numpy(dtype=np.int64), np.iinfo(np.int32).max)
    counts = spark.sparkContext.broadcast(counts)
    schema = f"node {kind}, label {kind}, shingle long, total double, before double"
    marks = settle(crowded.mapInArrow(_prefixes(idf, counts, threshold), schema).distinct(), "prefixes")
    groups = settle(_groups(marks, threshold), "groups")
    grouped = join_counted(marks, groups.where(F.col("n") <= MANY), "shingle")
    sides = [nodes.select(F.col("node").alias(x), F.col("bands").alias(f"bands_{x}")) for x in "ab"]
    close = settle(_all_pairs(grouped, "shingle", threshold), "close").join(sides[0], "a").join(sides[1], "b")
    close = close.where(F.arrays_overlap("bands_a", "bands_b")).select("a", "b")
    # Shingles of many nodes, by pairs of blocks: first their weights and bands, then the texts of what is left.
    many = join_counted(marks, groups.where(F.col("n") > MANY), "shingle").join(nodes.select("node", "bands"), "node")
    met = settle(_block_pairs(many), "met")
    chosen = settle(_candidates(met, kind, threshold), "candidates")
    rest = _all_pairs(mixed.where(F.col("n") <= FEW), "bucket").unionByName(close).unionByName(chosen.where("a is not null").select("a", "b")).distinct()
    rest = settle(rest.join(pairs.unionByName(least), ["a", "b"], "left_anti"), "pairs")
    third = judge(rest, pool(rest), "links")
    full = met.join(chosen.where("a is null").select("shingle", "low", "high"), ["shingle", "low", "high"])
    dense = settle(_block_links(full, crowded, idf, threshold), "links")
    return membership, links.unionByName(third).unionByName(dense)


def near_classes(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Adds ``class_id`` and ``kept`` to the documents: each class keeps its least document.  Columns of these names are replaced."""
    docs = docs.drop("class_id", "kept")
    membership, links = near_links(docs, key, threshold, bands, rows)
    # A doc_id with several texts hangs its nodes together, as each is linked with it.
    own = membership.where(F.col(key) != F.col("node")).select(F.col(key).alias("a"), F.col("node").alias("b"))
    classes = components(links.select("a", "b").unionByName(own)).select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    joined = docs.join(classes, docs[key] == classes["__node"], "left")
    class_id = F.coalesce(F.col("__component"), docs[key])
    return joined.select(*[docs[c] for c in docs.columns], class_id.alias("class_id"), docs[key].eqNullSafe(class_id).alias("kept"))


def op9_weighted_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_classes(docs).select("doc_id", "class_id", "kept")
