"""k-means over integer vectors by kd-tree filtering, exact to the last unit.

Vectors with exactly ``dims`` components, none null or non-finite, become integers floor(``scale`` * x). Each task
cuts its vectors into blocks of ``BLOCK`` and builds a kd-tree of each: a node is a range of the reordered block with
its bounding box, count and componentwise sum. Trees and vectors are written to the shared folder once and read in every round.

In a round, a block goes down its tree level by level. At a node, of the candidates that its parent left, the one
nearest to the box's middle is held against each other one: where that is strictly farther at the box's corner that
favours it most, it is farther in the whole box, and is pruned (a tie keeps it, for the smaller number wins). A node
with one candidate left is assigned whole, by its count and sum; leaves compare their vectors with what is left.
Tasks add up counts and sums by centroid, Spark adds up the tasks', and the driver gets one row a centroid.

Integers up to 2**22 are computed in doubles, in which every term and sum here is whole and below 2**53. A table
with a larger one takes Python integers without a tree, and sums in limbs of ``LIMB`` bits: exact as well, only slower.

Edge cases: vectors that are not kept have no row. Rows stay one for one, repeated ids included (of equal hashes, the
smaller vector is the earlier centroid); a row without an id hashes as ``null``. With fewer vectors than
centroids, all are centroids; without any, and for an empty table, the result is empty. Distances and inertias beyond a long are
the largest long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierweave.llm.common import cut

BLOCK, LEAF = 8192, 32
#: Largest magnitude that doubles handle exactly here, for up to 64 components.
PLAIN = 1 << 22
LIMB, LIMBS = 31, 40
LONGEST = (1 << 63) - 1
TREES = "ids array<long>, peak double, points binary, lows array<int>, highs array<int>, levels array<int>"


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); Python integers where doubles end."""
    with np.errstate(over="ignore"):
        if np.abs(x).max(initial=0.0) * scale < 2.0**52:
            return np.floor(x * scale).astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= 2.0**52 else math.floor(v * scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``order, lows, highs, levels``: the points' new order and the nodes' ranges in it, level by level from the root.

    A node of more than ``LEAF`` points is parted at the median of its widest component. Node i's children follow on the next level, in order.
    """
    order, level, lows, highs, levels = np.arange(len(points)), [(0, len(points))], [], [], [0]
    while level:
        below = []
        for low, high in level:
            lows.append(low)
            highs.append(high)
            if high - low > LEAF:
                own = points[order[low:high]]
                widest = int(np.argmax(own.max(0) - own.min(0)))
                middle = (high - low) // 2
                order[low:high] = order[low:high][np.argpartition(own[:, widest], middle, kind="introselect")]
                below += [(low, low + middle), (low + middle, high)]
        levels.append(len(lows))
        level = below
    return order, np.array(lows), np.array(highs), np.array(levels)


def trees(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """``ids, peak, points, lows, highs, levels``: a row a block of kept vectors, with its tree. ``peak`` is the largest magnitude."""
    names = [f.split()[0] for f in TREES.split(", ")]

    def row(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        x = whole(x, scale)
        plain = x.dtype != object and int(np.abs(x).max()) <= PLAIN
        if plain:
            order, lows, highs, levels = build(x)
            data = x[order].astype("<i4").tobytes()
        else:
            order, lows, highs, levels = np.arange(len(ids)), *[np.empty(0, np.int64)] * 3
            data = ",".join(str(v) for row in x.tolist() for v in row).encode()
        peak = float(min(int(np.abs(x).max()), 1 << 1000))
        cols = [[ids[order].tolist()], [peak], [data], [lows.tolist()], [highs.tolist()], [levels.tolist()]]
        kinds = [pa.list_(pa.int64()), pa.float64(), pa.binary(), *[pa.list_(pa.int32())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = np.empty(0, object), np.empty((0, dims))
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dims), False))
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)  # null components are NaN
            finite = np.isfinite(x).all(1)
            ids, rows = np.concatenate((ids, np.array(b.column(0).to_pylist(), object)[finite])), np.concatenate((rows, x[finite]))
            full = len(ids) // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                yield row(ids[i : i + BLOCK], rows[i : i + BLOCK])
            ids, rows = ids[full:], rows[full:]
        if len(ids):
            yield row(ids, rows)

    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return cut(own.mapInArrow(work, TREES), "kd-trees")


def integers(data: bytes, dims: int, plain: bool) -> np.ndarray:
    if plain:
        return np.frombuffer(data, "<i4").reshape(-1, dims).astype(np.float64)
    return np.array([int(v) for v in data.decode().split(",")], object).reshape(-1, dims)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact in either kind of number."""
    if points.dtype == object:
        return np.array([[sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in centroids.tolist()] for p in points.tolist()], object).reshape(len(points), len(centroids))
    return (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)


def undominated(lows: np.ndarray, highs: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Of ``open_[node, centroid]``, those that may be nearest to some point of the node's box ``lows..highs``."""
    middle = distances(lows + highs, 2 * centroids)  # four times the distances of the middles
    nearest = np.where(open_, middle, np.inf).argmin(1)
    kept = open_.copy()
    for z in np.unique(nearest).tolist():
        own = np.flatnonzero(nearest == z)
        away = centroids - centroids[z]
        corner = highs[own] @ np.maximum(away, 0).T + lows[own] @ np.minimum(away, 0).T
        # At the corner that favours it most, a centroid is farther than z by its own square less z's, less twice this product.
        farther = (centroids**2).sum(1) - (centroids[z] ** 2).sum() - 2 * corner
        kept[own] &= farther <= 0
    return kept


def filtered(points: np.ndarray, lows: np.ndarray, highs: np.ndarray, levels: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``cluster, counts, sums, compared`` of a block: each point's centroid, and how many points were compared with centroids at leaves."""
    k = len(centroids)
    low_box, high_box, node_sum = np.minimum.reduceat, np.maximum.reduceat, np.add.reduceat
    cluster = np.full(len(points), -1, np.int64)
    counts, sums, compared = np.zeros(k), np.zeros((k, points.shape[1])), 0
    active, open_ = np.array([0]), np.ones((1, k), bool)
    for depth in range(len(levels) - 1):
        if not len(active):
            break
        begin, end = lows[active], highs[active]
        edges = np.stack((begin, end), 1).ravel()
        pad = np.concatenate((points, points[:1]))  # for a range that ends with the block
        box = [f(pad, edges)[::2] for f in (low_box, high_box)]
        kept = undominated(*box, open_, centroids)
        single = kept.sum(1) == 1
        if single.any():
            own = kept[single].argmax(1)
            total = node_sum(pad, edges)[::2][single]
            np.add.at(counts, own, (end - begin)[single])
            np.add.at(sums, own, total)
            for a, b, z in zip(begin[single].tolist(), end[single].tolist(), own.tolist(), strict=True):
                cluster[a:b] = z
        leaf = ~single & (end - begin <= LEAF)
        if leaf.any():
            size = (end - begin)[leaf]
            at = np.arange(size.sum()) + np.repeat(begin[leaf] - (np.cumsum(size) - size), size)
            own = np.where(np.repeat(kept[leaf], size, axis=0), distances(points[at], centroids), np.inf).argmin(1)
            cluster[at] = own
            compared += len(at)
            np.add.at(counts, own, 1)
            np.add.at(sums, own, points[at])
        parted = ~single & ~leaf
        # The nodes of this level that were parted, all of them, give the next level's places.
        level = np.arange(levels[depth], levels[depth + 1])
        rank = np.cumsum(highs[level] - lows[level] > LEAF) - 1
        child = levels[depth + 1] + 2 * rank[active[parted] - levels[depth]]
        active = np.stack((child, child + 1), 1).ravel()
        open_ = np.repeat(kept[parted], 2, axis=0)
    return cluster, counts, sums, compared


def _assign(row: dict, centroids: list[list[int]], plain: bool) -> tuple[np.ndarray, np.ndarray, list[int], list[list[int]], int]:
    """``points, cluster, counts, sums, compared`` of a row of ``trees``."""
    dims = len(centroids[0])
    own_plain = bool(row["levels"])
    points = integers(row["points"], dims, own_plain)
    if plain:
        lows, highs, levels = (np.array(row[n], np.int64) for n in ("lows", "highs", "levels"))
        cluster, counts, sums, compared = filtered(points, lows, highs, levels, np.array(centroids, np.float64))
        return points, cluster, counts.astype(np.int64).tolist(), [[int(v) for v in r] for r in sums.tolist()], compared
    points = np.array([[int(v) for v in p] for p in points.tolist()], object).reshape(points.shape)
    cluster = np.array([min(range(len(d)), key=d.__getitem__) for d in distances(points, np.array(centroids, object)).tolist()], np.int64)
    counts = np.bincount(cluster, minlength=len(centroids)).tolist()
    sums = [[sum(points[cluster == z, i].tolist()) for i in range(dims)] for z in range(len(centroids))]
    return points, cluster, counts, sums, len(points)


def limbs(v: int, n: int) -> list[int]:
    """``v`` as ``n`` digits of ``LIMB`` bits, lowest first, all of its sign."""
    sign, v = (-1, -v) if v < 0 else (1, v)
    return [sign * (v >> LIMB * i & (1 << LIMB) - 1) for i in range(n)]


def step(blocks: DataFrame, centroids: list[list[int]], plain: bool) -> tuple[list[list[int]], int]:
    """The centroids after a round, and how many vectors were compared at leaves. The driver gets one row a centroid."""
    n_limbs = 1 if plain else LIMBS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, compared = [0] * len(centroids), [[0] * len(centroids[0]) for _ in centroids], 0
        for b in batches:
            for row in b.to_pylist():
                _, _, n, s, c = _assign(row, centroids, plain)
                counts = [x + y for x, y in zip(counts, n, strict=True)]
                sums = [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(sums, s, strict=True)]
                compared += c
        flat = [[x for v in s for x in ([v] if plain else limbs(v, LIMBS))] for s in sums]
        some = [z for z, n in enumerate(counts) if n]
        cols = [pa.array(some, pa.int32()), pa.array([counts[z] for z in some], pa.int64()), pa.array([flat[z] for z in some], pa.list_(pa.int64())), pa.array([compared if z == some[0] else 0 for z in some], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["z", "n", "sums", "compared"])

    width = len(centroids[0]) * n_limbs
    found = blocks.mapInArrow(work, "z int, n long, sums array<long>, compared long").groupBy("z").agg(F.sum("n"), F.sum("compared"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width)))).collect()
    out = list(centroids)
    for z, n, _, flat in found:
        out[z] = [sum(flat[i * n_limbs + j] << LIMB * j for j in range(n_limbs)) // n for i in range(len(centroids[0]))]
    return out, sum(r[2] for r in found)


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, seed: int) -> list[list[int]]:
    """The kept vectors with the smallest hashes of ``seed:vec_id``, in that order; at most ``k`` rows reach the driver."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    kept = vectors.select(F.col("vec_id").cast("long").cast("string").alias("id"), x.alias("x")).where((F.size(x) == dims) & finite)
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit("null"))), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [[int(v) for v in row] for row in whole(np.array([r.x for r in first], np.float64).reshape(len(first), dims), scale).tolist()]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every kept row of ``vectors(vec_id, embedding)``."""
    if dims > 64:
        raise ValueError("sums of squares of more than 64 components may leave the doubles' whole numbers")
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    spark = vectors.sparkSession
    blocks = trees(vectors, dims, scale)
    centroids = first_centroids(vectors, k, dims, scale, seed)
    if not centroids:
        return spark.createDataFrame([], schema)
    plain = blocks.agg(F.max("peak")).first()[0] <= PLAIN
    for _ in range(rounds):
        centroids, _ = step(blocks, centroids, plain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                points, own, _, _, _ = _assign(row, centroids, plain)
                if plain:
                    far = ((points - np.array(centroids, np.float64)[own]) ** 2).sum(1).astype(np.int64)
                else:
                    far = [min(sum((int(x) - y) ** 2 for x, y in zip(p, centroids[z], strict=True)), LONGEST) for p, z in zip(points.tolist(), own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(own, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    found = cut(blocks.mapInArrow(work, "vec_id long, cluster int, distance long"), "kd-assigned")
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # a row a centroid
    total = min(sum(sums.values()), LONGEST)
    rows = [(z, min(sums.get(z, 0), LONGEST), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for z, c in enumerate(centroids)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
