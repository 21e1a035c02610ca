"""A trie of conversation prefixes by composable fingerprints.

Conversation c is rebuilt from the first h turns of its base, the conversation
that stands at the start of its run of ``RUN`` numbers, and its own turns after its
first h.  A node of the trie is a distinct sequence of the first d rebuilt turns.

1. Turns are range-sorted by conversation and turn and written with their text.
   A turn is an element (m, a) of the affine maps over the field of 2^61 - 1
   elements; products of elements are such maps again, are associative and have
   inverses.  A task scans the products of its sorted turns; a conversation that
   goes on in several tasks is given the product of what stands before.
2. The fingerprint of a rebuilt prefix is the base's head product times the
   inverse of the own head's product times the own prefix product: one map per
   (conversation, range) is composed and applied.  No rebuilt text is made.
3. Prefixes of one fingerprint are a node.  Its members must agree in the hash of
   the last turn and in the parent's fingerprint, and turns of one hash are
   compared text by text with the first of them, read through the stored places.
   Any difference starts anew with wider or other hashes.  So equal nodes are
   equal turns, by induction over the depth.
4. A node's sums over its subtree need no descent: a conversation is the least
   member of the nodes from some depth of its path on; the sums over those from
   depth d on go to the node itself, and all of them to each node above.

A conversation, a first turn or a base of a third of all rows is no single task:
places are sorted by range, sums along a path are added up in blocks of ``BLOCK``
depths, counts combine map-side, hot nodes and conversations are joined by
``join_counted``, and the numbers of members that end at a node are put together
in ranges of ``BLOCK`` numbers, whose texts a task streams into the node's digest.

Special cases: null role and text count as empty; a null turn stands first; turns
that tie go by the MD5 of role and text, so repeated rows stand side by side; rows
without a conv_id are no conversation; a base that is absent gives no head; the
quotient of negative numbers is cut towards 0; a conversation without rebuilt turns
ends at the root; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escalade.llm.curriculum import word_count
from escalade.llm.frames import join_counted, read, settle

#: Conversations that share a base, and the most turns that are taken from it (less one).
RUN = 20
HEADS = 4
#: Depths of a block of a path, and numbers of a block of members.
BLOCK = 4096
#: Bits of the two hashes of a turn.
BITS = 61
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)


# --- affine maps x -> m x + a over the field of PRIME elements ---------------


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo PRIME, by halves of 32 bits."""
    half, low = np.uint64(32), np.uint64((1 << 32) - 1)
    x1, x0, y1, y0 = x >> half, x & low, y >> half, y & low
    middle = _fold(_fold(x1 * y0) + _fold(x0 * y1))
    # 2^61 = 1, so 2^64 = 8 and 2^32 m = (m >> 29) + (m mod 2^29) 2^32.
    lifted = (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << half)
    return _fold(_fold(_fold(x1 * y1) * np.uint64(8)) + _fold(lifted) + _fold(x0 * y0))


def product(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First ``left``, then ``right``."""
    return times(left[0], right[0]), _fold(times(left[1], right[0]) + right[1])


def inverse(m: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    back = np.array([pow(int(x), -1, PRIME) for x in m], dtype=np.uint64)
    return back, times(_fold(_P - a), back)


def scan(m: np.ndarray, a: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of each run's elements up to and with each place; ``begins`` gives the start of each place's run."""
    place, step = np.arange(len(m)), 1
    longest = int((place - begins).max(initial=0)) + 1
    while step < longest:
        reach = np.flatnonzero(place - step >= begins)
        joined = product((m[reach - step], a[reach - step]), (m[reach], a[reach]))
        m, a = m.copy(), a.copy()
        m[reach], a[reach] = joined
        step *= 2
    return m, a


def _u(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _maps(m: np.ndarray, a: np.ndarray) -> list[pa.Array]:
    return [pa.array(m.view(np.int64)), pa.array(a.view(np.int64))]


def _scan_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with their place among the conversation's turns here, and the products of these before and with the turn."""
    last, count, carry = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, m, a = _u(batch.column("conv_id")), _u(batch.column("m")), _u(batch.column("a"))
        goes_on = last is not None and conv[0] == last
        turn = _maps(m, a)
        if goes_on:
            first = product(carry, (m[:1], a[:1]))
            m, a = np.r_[first[0], m[1:]], np.r_[first[1], a[1:]]
        new = np.r_[True, conv[1:] != conv[:-1]]
        begins = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        at = np.arange(len(conv)) - begins + np.where(begins == 0, count if goes_on else 0, 0)
        m, a = scan(m, a, begins)
        # What stands before a turn: the product up to the turn before it.
        before = np.r_[np.uint64(1), m[:-1]], np.r_[np.uint64(0), a[:-1]]
        before[0][new], before[1][new] = 1, 0
        if goes_on:
            before[0][0], before[1][0] = carry[0][0], carry[1][0]
        names = ["conv_id", "part", "role", "text", "words"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(at), *turn, *_maps(*before), *_maps(m, a)], names=[*names, "at", "m", "a", "before_m", "before_a", "upto_m", "upto_a"]
        )
        last, count, carry = conv[-1], int(at[-1]) + 1, (m[-1:], a[-1:])


_TURNS = ("conv_id long, part int, role string, text string, words long, at long, m long, a long, "
          "before_m long, before_a long, upto_m long, upto_a long")


def _hash(seed: int, bits: int, *columns) -> Column:
    """A turn's hash in 1 .. 2^bits - 1, so that it has an inverse."""
    low = F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << bits) - 1))
    return F.when((low == 0) | (low == PRIME), 1).otherwise(low).cast("long")


def sorted_turns(conversations: DataFrame, seed: int, bits: int) -> DataFrame:
    """All turns with their texts and their products within (conv_id, part), where they stand at place ``at``; written."""
    given = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").alias("__turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    tie = F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary")))
    # Equal rows may be dealt to several ranges, whichever stands where.
    turns = given.select("*", tie.alias("__tie"), F.monotonically_increasing_id().alias("__row"), word_count(F.col("text")).alias("words"),
                         _hash(2 * seed, bits, "role", "text").alias("m"), _hash(2 * seed + 1, bits, "role", "text").alias("a"))
    order = [F.asc("conv_id"), F.asc_nulls_first("__turn"), F.asc("__tie"), F.asc("__row")]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return settle(ranged.select("conv_id", "part", "role", "text", "words", "m", "a").mapInArrow(_scan_turns, _TURNS), "turns")


def _offsets(key, table):
    """Parts of one conversation in order: turns and product before each."""
    table = table.sort_by("part")
    m, a = _u(table.column("m").combine_chunks()), _u(table.column("a").combine_chunks())
    upto = scan(m, a, np.zeros(len(m), dtype=np.int64))
    n = table.column("n").to_numpy()
    before = np.r_[np.uint64(1), upto[0][:-1]], np.r_[np.uint64(0), upto[1][:-1]]
    return pa.table([table.column("conv_id"), table.column("part"), pa.array(np.r_[0, np.cumsum(n)[:-1]]), *_maps(*before)], names=["conv_id", "part", "start", "m", "a"])


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n, start, m, a): what stands before each part of a conversation; written."""
    own = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max_by(F.struct("upto_m", "upto_a"), "at").alias("p"))
    own = settle(own.select("conv_id", "part", "n", F.col("p.upto_m").alias("m"), F.col("p.upto_a").alias("a")), "segments")
    # A range's bounds cut at most one conversation each, so few go on over several ranges.
    several = own.groupBy("conv_id").agg(F.count("*").alias("k")).where("k > 1").select("conv_id")
    cut = own.join(several, "conv_id").groupBy("conv_id").applyInArrow(_offsets, "conv_id long, part int, start long, m long, a long")
    whole = own.select("conv_id", "part", "n").join(cut, ["conv_id", "part"], "left")
    return settle(whole.select("conv_id", "part", "n", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("start", 0), ("m", 1), ("a", 0))]), "offsets")


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left_m, left_a) before (before_m, before_a) and (upto_m, upto_a)."""
    for batch in batches:
        left = _u(batch.column("left_m")), _u(batch.column("left_a"))
        out = [product(left, (_u(batch.column(f"{x}_m")), _u(batch.column(f"{x}_a")))) for x in ("before", "upto")]
        rest = ["conv_id", "depth", "words", "m", "a"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + _maps(*out[0]) + _maps(*out[1]), names=[*rest, "pm", "pa", "fm", "fa"])


def _rebase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map that takes a product of own turns to that of the rebuilt ones: base head times the inverse of the own head."""
    for batch in batches:
        own = inverse(_u(batch.column("own_m")), _u(batch.column("own_a")))
        out = product((_u(batch.column("head_m")), _u(batch.column("head_a"))), own)
        rest = ["conv_id", "shift"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + _maps(*out), names=[*rest, "left_m", "left_a"])


def _join_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left_m, left_a) before (m, a), as the new left."""
    for batch in batches:
        out = product((_u(batch.column("left_m")), _u(batch.column("left_a"))), (_u(batch.column("m")), _u(batch.column("a"))))
        rest = ["conv_id", "part", "start", "shift"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + _maps(*out), names=[*rest, "left_m", "left_a"])


def head_size(conv: Column) -> Column:
    """Turns that are taken from the base."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt_paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, words, m, a, pm, pa, fm, fa) of every rebuilt turn, and (conv_id, length) of every conversation; both written.

    (m, a) is the turn, (pm, pa) the parent's fingerprint and (fm, fa) the own one.
    """
    parts = segments(turns)
    lengths = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", "n", head_size(F.col("conv_id")).alias("h"))
    # The first turns of every conversation, at most three: place, words, turn, and the products before and with it.
    opening = parts.where(F.col("start") < HEADS - 1).withColumnsRenamed({"m": "left_m", "a": "left_a", "conv_id": "c", "part": "p"}).drop("n")
    first = turns.where(F.col("at") < HEADS - 1).join(opening, (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")))
    first = first.withColumn("depth", F.col("start") + F.col("at") + 1).where(F.col("depth") < HEADS)
    heads = settle(first.mapInArrow(_compose, _PATHS), "heads")
    # Heads of the bases, for each conversation that has one.
    based = lengths.withColumn("base", F.col("conv_id") - F.col("conv_id") % RUN)
    taken = based.select(F.col("conv_id").alias("own"), "base", "h").join(heads.withColumnRenamed("conv_id", "base"), "base").where(F.col("depth") <= F.col("h"))
    taken = settle(taken.drop("base", "h").withColumnRenamed("own", "conv_id").select(*[c.split()[0] for c in _PATHS.split(", ")]), "taken")
    ends = taken.groupBy("conv_id").agg(F.max("depth").alias("taken"), F.max_by(F.struct("fm", "fa"), "depth").alias("head"))
    sides = lengths.join(ends, "conv_id", "left").join(
        heads.select("conv_id", F.col("depth").alias("h"), F.col("fm").alias("own_m"), F.col("fa").alias("own_a")), ["conv_id", "h"], "left"
    ).select("conv_id", "n", "h", *[F.coalesce(c, F.lit(v)).alias(n) for c, v, n in (
        ("taken", 0, "taken"), ("head.fm", 1, "head_m"), ("head.fa", 0, "head_a"), ("own_m", 1, "own_m"), ("own_a", 0, "own_a"))])
    sides = settle(sides, "sides")
    rest = sides.where(F.col("n") > F.col("h")).withColumn("shift", F.col("taken") - F.col("h"))
    maps = rest.mapInArrow(_rebase, "conv_id long, shift long, left_m long, left_a long")
    maps = parts.join(maps, "conv_id").mapInArrow(_join_maps, "conv_id long, part int, start long, shift long, left_m long, left_a long")
    # A conversation of many turns stands in many parts, so no key of this join is hot.
    own = turns.join(settle(maps.join(sides.select("conv_id", "h"), "conv_id"), "maps"), ["conv_id", "part"])
    place = F.col("start") + F.col("at")
    own = own.where(place >= F.col("h")).withColumn("depth", place + 1 + F.col("shift"))
    paths = taken.unionByName(own.mapInArrow(_compose, _PATHS))
    lengths = sides.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return settle(paths, "paths"), settle(lengths, "lengths")


_PATHS = "conv_id long, depth long, words long, m long, a long, pm long, pa long, fm long, fa long"


def collides(turns: DataFrame, paths: DataFrame) -> bool:
    """Whether prefixes of one fingerprint, or turns of one hash, differ."""
    last = [F.min(c) != F.max(c) for c in ("depth", "m", "a", "pm", "pa")]
    differ = last[0]
    for other in last[1:]:
        differ = differ | other
    root = (F.col("fm") == 1) & (F.col("fa") == 0)
    if not paths.groupBy("fm", "fa").agg(differ.alias("differ")).where(F.col("differ") | root).isEmpty():
        return True
    shared = turns.groupBy("m", "a").agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "part", "at")).alias("first")).where("n > 1")
    shared = settle(shared.select("m", "a", "n", "first.*"), "shared")
    place = ["conv_id", "part", "at"]
    stored = turns.select(*place, F.col("role").alias("first_role"), F.col("text").alias("first_text"))
    firsts = settle(shared.join(stored, place).drop(*place), "firsts")
    met = join_counted(turns.select("m", "a", "role", "text"), firsts, ["m", "a"])
    return not met.where("role <> first_role or text <> first_text").isEmpty()


def paths_of(conversations: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Verified paths and lengths of all rebuilt conversations (see ``rebuilt_paths``)."""
    seed = 0
    while True:
        turns = sorted_turns(conversations, seed, bits)
        paths, lengths = rebuilt_paths(turns)
        if not collides(turns, paths):
            return paths, lengths
        seed, bits = seed + 1, min(2 * bits, BITS)


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of members in order, node by node, into one digest a node."""
    node, digest = None, None

    def told(done):
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0][k] for d in done], pa.int64()) for k in (0, 1)] + [pa.array([d[1] for d in done], pa.string())], names=["fm", "fa", "ends_sha256"]
        )

    for batch in batches:
        done = []
        for fm, fa, members in zip(*(batch.column(c).to_pylist() for c in ("fm", "fa", "members"))):
            if (fm, fa) != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = (fm, fa), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(members.encode())
        yield told(done)
    if node is not None:
        yield told([(node, digest.hexdigest())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(fm, fa, ends_sha256) of the conversations (conv_id, fm, fa) that end at a node."""
    block = F.floor(F.col("conv_id") / BLOCK).cast("long")
    # Numbers of conversations differ, so a block holds at most BLOCK of them.
    blocks = ends.groupBy("fm", "fa", block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("members"))
    blocks = blocks.repartition("fm", "fa").sortWithinPartitions("fm", "fa", "block")
    return blocks.select("fm", "fa", "members").mapInArrow(_stream_digests, "fm long, fa long, ends_sha256 string")


def trie(conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths, lengths = paths_of(conversations, bits)
    key, root = ["fm", "fa"], {"fm": 1, "fa": 0}
    shared = paths.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.first("words").alias("words"),
        F.first("pm").alias("pm"), F.first("pa").alias("pa"),
    )
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *[F.lit(v).cast("long").alias(c) for c, v in root.items()], "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"),
        F.lit(None).cast("long").alias("pm"), F.lit(None).cast("long").alias("pa"),
    )
    nodes = settle(shared.unionByName(top), "nodes")
    children = settle(nodes.where("depth > 0").groupBy(F.col("pm").alias("fm"), F.col("pa").alias("fa")).agg(F.count("*").alias("n_children")), "children")
    nodes = settle(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes")
    # What a conversation adds as the least member of nodes, and its sums from each depth on: blocks first, then within a block.
    own = nodes.select(*key, "conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    own = own.withColumn("block", F.floor(F.col("depth") / BLOCK))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    blocks = own.groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "sl"],
                           *[F.sum(c).over(whole).alias(f"{c}_all") for c in "sl"])
    blocks = settle(blocks, "path-blocks")
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    own = own.join(blocks, ["conv_id", "block"]).select(*key, *[
        (F.sum(c).over(within) + F.col(f"{x}_later") - F.col(f"{x}_all")).alias(f"{c}_own") for c, x in (("saved", "s"), ("leaf", "l"))
    ])
    # All that a member adds, at each of the nodes on its path; at its own ones the part before them is taken off again above.
    totals = blocks.groupBy("conv_id").agg(F.max("s_all").alias("s_all"), F.max("l_all").alias("l_all")).where("s_all > 0 or l_all > 0")
    totals = settle(totals.join(lengths, "conv_id"), "totals")
    steps = join_counted(paths.select("conv_id", *key), totals, "conv_id", n="length")
    sums = steps.groupBy(*key).agg(F.sum("s_all").alias("s"), F.sum("l_all").alias("l"))
    at_root = totals.agg(F.sum("s_all").alias("s"), F.sum("l_all").alias("l")).where("l is not null").select(
        *[F.lit(v).cast("long").alias(c) for c, v in root.items()], "s", "l"
    )
    last = paths.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("conv_id", *key)
    none = lengths.where("length = 0").select("conv_id", *[F.lit(v).cast("long").alias(c) for c, v in root.items()])
    ends = ends_digests(last.unionByName(none))
    parents = settle(nodes.where("n_children > 0").select(F.col("fm").alias("pm"), F.col("fa").alias("pa"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")), "parents")
    full = nodes.join(own, key).join(sums.unionByName(at_root), key).join(ends, key, "left")
    full = settle(full.select("conv_id", "depth", "n_convs", "n_children", (F.col("l") + F.col("leaf_own")).alias("n_leaves"),
                              (F.col("s") + F.col("saved_own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "pm", "pa"), "trie")
    named = join_counted(full, parents, ["pm", "pa"], n="n", how="left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return trie(read(spark, sf_dir, "conversations"))


#: The same in SQL: prefixes are lists of turns, and a node's subtree is found by its fingerprint in the paths of the leaves.
SQL = r"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS i,
  struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS u FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(u ORDER BY i) AS us FROM t GROUP BY conv_id),
h AS (SELECT conv_id, us, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))),
  lambda c, d: xor(c >> 8, tab[(xor(c, d) & 255) + 1])), 4294967295) % 4 AS h FROM lists, crc_table),
r AS (SELECT h.conv_id, coalesce(list_concat(b.us[1:h.h], h.us[h.h + 1:]), h.us[h.h + 1:]) AS us FROM h LEFT JOIN lists b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(us) AS length, unnest(range(0, len(us) + 1)) AS depth, us FROM r),
q AS (SELECT conv_id, length, depth, us[1:depth] AS pre, us FROM p),
k AS (SELECT pre, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth), '') AS ends
  FROM q GROUP BY pre, depth),
c AS (SELECT pre[1:depth - 1] AS pre, depth - 1 AS depth, count(*) AS n FROM k WHERE depth > 0 GROUP BY 1, 2),
n AS (SELECT k.*, coalesce(c.n, 0) AS n_children, CASE WHEN k.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(k.pre[k.depth].x, '[^ 	-
]+')) END AS saved
  FROM k LEFT JOIN c ON c.pre = k.pre AND c.depth = k.depth),
above AS (SELECT pre, unnest(range(0, depth + 1)) AS up, saved, CAST(n_children = 0 AS BIGINT) AS leaf FROM n),
s AS (SELECT pre[1:up] AS pre, up AS depth, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(leaf) AS BIGINT) AS n_leaves FROM above GROUP BY 1, 2)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.pre = n.pre AND s.depth = n.depth LEFT JOIN n m ON m.depth = n.depth - 1 AND m.pre = n.pre[1:n.depth - 1]
"""
