"""Near-duplicate vectors by a forest of random-projection trees.

1. Vectors of equal direction are one point: their least vec_id, with the number of copies.
2. Every tree splits its points at the median of a random projection, again and
   again.  Points near the median go to both sides (the spill), so that close
   points are rarely parted; many trees make up for the rest.
3. Nodes too large for a task are split by Spark, level by level: one grouping
   gives the medians, and each point moves on by an equi-join with its node's
   split.  The others are split further inside one task each, down to leaves.
4. Points of a leaf are compared by cosine in double precision.  Pairs at or over
   the threshold come out of several trees and are made distinct.
5. Pairs that the trees find join points to components; in a large group of close
   points they are a part of its links only.  So the links are counted exactly within
   each component: up to ``BLOCK`` points in one task, larger ones dealt out as pairs
   of blocks.  Only counts leave these tasks, no pairs.
6. Links and components count the copies of each point.

No node ever meets a task with more than ``TASK_POINTS`` points, whatever the
size of a cluster of vectors: distinct points can always be split.  Only pairs
that are links leave a task.

Special cases: vectors that are null, empty, all zero or hold a null or
non-finite component link with nothing, not even with an equal one; vectors of
different lengths are not compared; rows that repeat a vec_id and vector are
one vector (one row for each of them, with the same result); a vec_id with
several vectors joins their components, and its links are those of all of them;
a null vec_id links with nothing (component null, kept).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm.arrays import mix
from escalade.llm.frames import components, read, settle

THRESHOLD = 0.9
TREES = 10
#: Share of a node's points on either side of the median that goes to both.
SPILL = 0.06
#: Points that one task splits by itself.
TASK_POINTS = 65536
#: Vectors whose unit vectors agree to one part in so many are one point; their cosine is over 1 - 1e-15.
DIRECTIONS = 1 << 30
#: Points of a leaf.
LEAF_POINTS = 128
#: Points of a block in which links are counted, and rows of it that are compared at a time.
BLOCK = 8192
_STRIP = 512


def direction(tree: int, path: int, size: int) -> np.ndarray:
    """A node's random direction; the same in every task and every run."""
    seed = mix(np.array([tree * 0x1F3D + 7, path], dtype=np.uint64))
    return np.random.default_rng([int(seed[0]), int(seed[1])]).standard_normal(size)


def _matrix(column: pa.Array) -> np.ndarray:
    body = column.flatten().to_numpy(zero_copy_only=False)
    return body.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors of the rows that have one, and a digest of their direction."""
    for batch in batches:
        x = batch.column("x")
        length = x.value_lengths().to_numpy()
        filled = np.flatnonzero(length > 0)
        values, row = x.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(float), np.repeat(np.arange(len(filled)), length[filled])
        starts = np.cumsum(length[filled]) - length[filled]
        # Scaled by the greatest component before squaring, so that no square overflows or vanishes.
        most = np.maximum.reduceat(np.abs(values), starts) if len(filled) else np.zeros(0)
        sound = np.isfinite(most) & (most > 0)
        keep = sound[row]
        row, values = (np.cumsum(sound) - 1)[row[keep]], values[keep] / most[row[keep]]
        values /= np.sqrt(np.bincount(row, weights=values * values))[row]
        ends = np.concatenate([[0], np.cumsum(length[filled][sound])])
        steps = (np.rint(values * DIRECTIONS).astype(np.int64) + 0).astype("<i8")
        digests = [hashlib.blake2b(steps[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id").take(pa.array(filled[sound])), "point": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
            "direction": pa.array(digests, pa.binary()),
        })


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each point's value along its node's direction."""
    for batch in batches:
        trees, paths = batch.column("tree").to_numpy(), batch.column("path").to_numpy()
        points = batch.column("point")
        lengths = points.value_lengths().to_numpy()
        starts = np.concatenate([[0], np.cumsum(lengths)])
        body, values = points.flatten().to_numpy(zero_copy_only=False), np.zeros(len(trees))
        for key in np.unique(np.stack([trees, paths, lengths]), axis=1).T:
            rows = np.flatnonzero((trees == key[0]) & (paths == key[1]) & (lengths == key[2]))
            values[rows] = body[starts[rows][:, None] + np.arange(key[2])] @ direction(int(key[0]), int(key[1]), int(key[2]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, "value"])


def leaf_pairs(ids: np.ndarray, points: np.ndarray, tree: int, path: int, threshold: float, spill: float, leaf: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places at or over the threshold within the leaves below a node."""
    found, open_ = [], [(path, np.arange(len(ids)))]
    while open_:
        path, rows = open_.pop()
        value = None
        if len(rows) > leaf:
            value = points[rows] @ direction(tree, path, points.shape[1])
            low, middle, high = np.quantile(value, [0.5 - spill, 0.5, 0.5 + spill])
            left, right = value <= max(high, middle), value >= low
            if left.all() or right.all():
                # Values tie around the median: part them by order instead.
                order = np.argsort(value, kind="stable")
                left = np.zeros(len(rows), dtype=bool)
                left[order[:len(rows) // 2]] = True
                right = ~left
            open_.append((2 * path, rows[left]))
            open_.append((2 * path + 1, rows[right]))
            continue
        near = np.triu(points[rows] @ points[rows].T >= threshold, 1)
        a, b = np.nonzero(near)
        found.append((rows[a], rows[b]))
    return found


def point_links(points: DataFrame, threshold: float, trees: int, spill: float, task_points: int, leaf: int) -> DataFrame:
    """Distinct pairs (a, b) of points (node, point) whose cosine is at or over the threshold."""
    kind = points.schema["node"].dataType.simpleString()
    rows = points.select(
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("path"), F.size("point").alias("size"), "node", "point"
    )
    finished = []
    while True:
        rows = settle(rows, "forest-level")
        nodes = rows.groupBy("tree", "path", "size").count()
        if nodes.where(F.col("count") > task_points).isEmpty():
            finished.append(rows)
            break
        large = nodes.where(F.col("count") > task_points).select("tree", "path", "size")
        finished.append(rows.join(large, ["tree", "path", "size"], "left_anti"))
        valued = rows.join(large, ["tree", "path", "size"], "left_semi").select("tree", "path", "size", "node", "point")
        valued = valued.mapInArrow(_projected, f"tree int, path long, size int, node {kind}, point array<double>, value double")
        cuts = valued.groupBy("tree", "path", "size").agg(F.percentile_approx("value", [0.5 - spill, 0.5 + spill], 1000).alias("cut"))
        moved = valued.join(cuts, ["tree", "path", "size"])
        left = F.when(F.col("value") <= F.col("cut")[1], F.col("path") * 2)
        right = F.when(F.col("value") >= F.col("cut")[0], F.col("path") * 2 + 1)
        rows = moved.select("tree", F.explode(F.array_compact(F.array(left, right))).alias("path"), "size", "node", "point")
    columns = ["tree", "path", "size", "node", "point"]
    rows = finished[0].select(columns)
    for more in finished[1:]:
        rows = rows.unionByName(more.select(columns))

    def compare(key, table):
        ids = table.column("node").to_numpy()
        order = np.argsort(ids, kind="stable")
        units = _matrix(table.column("point").combine_chunks())[order]
        ids = ids[order]
        pairs = leaf_pairs(ids, units, key[0].as_py(), key[1].as_py(), threshold, spill, leaf)
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
        once = np.unique(a * len(ids) + b)
        return pa.table({"a": pa.array(ids[once // max(len(ids), 1)]), "b": pa.array(ids[once % max(len(ids), 1)])})

    pairs = rows.groupBy("tree", "path", "size").applyInArrow(compare, f"a {kind}, b {kind}")
    return pairs.where("a <> b").distinct()


def link_counts(codes: np.ndarray, vectors: list[np.ndarray], copies: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (codes) of the left points, and the copies of the other nodes of the right points that they link with.

    A node may have several points, also of different lengths; it counts once.
    """
    left, right = (x[np.argsort(codes[x], kind="stable")] for x in (left, right))
    begins, ends = np.unique(codes[left], return_index=True)[1], np.unique(codes[right], return_index=True)[1]
    sizes = np.array([len(v) for v in vectors])
    matrices = {n: np.stack([vectors[k] for k in right[sizes[right] == n]]) for n in np.unique(sizes[right])}
    weight, counts = copies[right[ends]].astype(float), []
    for first in range(0, len(begins), _STRIP):
        own = begins[first:first + _STRIP]
        rows = left[own[0]:begins[first + _STRIP] if first + _STRIP < len(begins) else len(left)]
        near = np.zeros((len(rows), len(right)), dtype=bool)
        for n, matrix in matrices.items():
            some = np.flatnonzero(sizes[rows] == n)
            if len(some):
                near[np.ix_(some, np.flatnonzero(sizes[right] == n))] = np.stack([vectors[k] for k in rows[some]]) @ matrix.T >= threshold
        if len(ends) < len(right):
            near = np.logical_or.reduceat(near, ends, axis=1)
        if len(own) < len(rows):
            near = np.logical_or.reduceat(near, own - own[0], axis=0)
        near &= codes[left[own]][:, None] != codes[right[ends]][None, :]
        counts.append(near @ weight)
    return codes[left[begins]], np.concatenate(counts).astype(np.int64)


def component_links(points: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, others): copies of the other nodes that a node links with, from (node, point, copies, component)."""
    kind = points.schema["node"].dataType.simpleString()
    sizes = points.groupBy("component").count()
    sized = points.join(sizes, "component")
    small = sizes.where(F.col("count") <= block).agg(F.sum("count")).first()[0] or 0
    pool = F.pmod(F.xxhash64("component"), F.lit(small // block + 1))
    columns = ["component", "node", "point", "copies", "own", "low", "high"]
    # Small components share a task; large ones are dealt out as pairs of blocks.
    together = sized.where(F.col("count") <= block).withColumns({"own": F.lit(0).cast("long"), "low": F.lit(-1).cast("long"), "high": pool})
    parts = F.ceil(F.col("count") / block)
    apart = sized.where(F.col("count") > block).withColumns({"own": F.pmod(F.xxhash64("node"), parts), "other": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))})
    apart = apart.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    dealt = together.select(*columns, F.lit(None).cast(kind).alias("large")).unionByName(apart.select(*columns, F.col("component").alias("large")))

    def count(key, table):
        ids, codes = np.unique(table.column("node").to_numpy(), return_inverse=True)
        groups = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        copies, own = table.column("copies").to_numpy(), table.column("own").to_numpy()
        body = table.column("point").combine_chunks()
        ends = np.cumsum(body.value_lengths().to_numpy())
        vectors = np.split(body.flatten().to_numpy(zero_copy_only=False), ends[:-1])
        low, high = key[1].as_py(), key[2].as_py()
        if key[0].as_py() is None:
            order = np.argsort(groups, kind="stable")
            sides = [(x, x) for x in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1)]
        elif low == high:
            sides = [(np.arange(len(codes)),) * 2]
        else:
            a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
            sides = [(a, b), (b, a)] if len(a) and len(b) else []
        found = [link_counts(codes, vectors, copies, a, b, threshold) for a, b in sides]
        nodes = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        others = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        return pa.table({"node": pa.array(ids[nodes]), "others": pa.array(others, pa.int64())})

    counted = dealt.groupBy("large", "low", "high").applyInArrow(count, f"node {kind}, others long")
    return counted.groupBy("node").agg(F.sum("others").alias("others"))


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL,
    task_points: int = TASK_POINTS, leaf: int = LEAF_POINTS, block: int = BLOCK,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    kind = vectors.schema[key].dataType.simpleString()
    named = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("x"))
    usable = settle(named.mapInArrow(_unit_vectors, f"id {kind}, point array<double>, direction binary"), "units")
    nodes = usable.groupBy("direction").agg(F.min("id").alias("node"), F.min_by("point", "id").alias("point"), F.count_distinct("id").alias("copies"))
    nodes = settle(nodes, "points")
    own = settle(usable.join(nodes, "direction").select("id", "node", "copies").distinct(), "copies")
    links = settle(point_links(nodes, threshold, trees, spill, task_points, leaf), "vector-links")
    sizes = nodes.groupBy("node").agg(F.max("copies").alias("copies"))
    hung = own.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    classes = components(links.unionByName(hung)).withColumnRenamed("node", "id")
    members = nodes.select("node", "point").join(sizes, "node").join(classes.withColumnRenamed("id", "node"), "node")
    others = component_links(members, threshold, block)
    counted = own.join(others, "node", "left").groupBy("id").agg(F.sum(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    result = counted.join(classes, "id", "left").withColumnRenamed("id", "__id")
    rows = vectors.select(key).join(result, F.col(key) == F.col("__id"), "left")
    component = F.coalesce("component", key)
    return rows.select(
        key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept")
    )


def op8_projection_forest(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_vectors(read(spark, sf_dir, "embeddings"))
