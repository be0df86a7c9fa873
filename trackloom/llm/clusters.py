"""Grouping records into similarity clusters.

Records become vectors by hashing their named, weighted features. Distributed k-means: parallel oversampled seeding (every round
each record joins the candidates with a probability in proportion to its squared distance to them; the candidates, weighted by
the records nearest to them, are reduced to k on the driver), then passes that send one sum and count per centre and partition.
Every pass counts every record: records are packed once into blocks of leaves with their bounds and sums, and a leaf whose bounds
settle its records alike is counted by its sum.
With a radius the centres, and all candidates so that no small group is lost among the k, are refined by the mean of the records
within it until they rest; centres that come to rest in one place are one cluster, and records far from all groups belong to none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.session import checkpointed

BLOCK = 8192
#: Points of one leaf of a tree, and numbers (points x dimensions) that are ordered into one tree.
LEAF, TREE = 512, 1 << 20
#: Rounds of refinement after which a fit that has not come to rest is an error, not a result.
MOST_ROUNDS = 1000
#: Up to so many anchors are sent to every task; beyond, they are joined by cluster, salted.
BROADCAST_ANCHORS, SALTS = 10_000, 32


def hashed_slots(names: list[str], size: int) -> list[tuple[int, float]]:
    """(slot, sign) of each feature name. Raises if two names share a slot: choose a larger size."""
    digests = [hashlib.sha256(n.encode()).digest() for n in names]
    slots = [(int.from_bytes(d[:4], "big") % size, 1.0 if d[4] & 1 else -1.0) for d in digests]
    if len({s for s, _ in slots}) < len(slots):
        raise ValueError(f"features share a slot among {size}")
    return slots


def vectorised(df: DataFrame, key: str, weights: dict[str, float], valid: Column, size: int = 64) -> DataFrame:
    """(key, x array<double>): weight x value of each feature in its hashed slot.

    Only slots in use are kept, in slot order: the others are 0 in every row and change no distance. Rows that are not valid
    (null and NaN never are) are left out.
    """
    slots = sorted(zip(hashed_slots(list(weights), size), weights.items()))
    sound = valid
    for name in weights:
        sound = sound & F.col(name).isNotNull() & ~F.isnan(F.col(name))
    return df.filter(sound).select(F.col(key), F.array(*[F.col(n) * F.lit(w * sign) for (_, sign), (n, w) in slots]).alias("x"))


def to_slots(values: dict[str, float], weights: dict[str, float], size: int = 64) -> list[float]:
    """One record on the driver, as vectorised gives it."""
    slots = sorted(zip(hashed_slots(list(weights), size), weights.items()))
    return [values[n] * w * sign for (_, sign), (n, w) in slots]


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre and squared distance to it, in blocks."""
    index, squared = np.empty(len(points), dtype=np.int64), np.empty(len(points))
    norms = (centres**2).sum(1)
    for i in range(0, len(points), BLOCK):
        p = points[i : i + BLOCK]
        d = (p**2).sum(1)[:, None] - 2 * p @ centres.T + norms
        j = d.argmin(1)
        index[i : i + BLOCK], squared[i : i + BLOCK] = j, ((p - centres[j]) ** 2).sum(1)
    return index, squared


def matrix(column: pa.Array) -> np.ndarray:
    """A batch of equally long vectors without nulls as one matrix, without copying value by value."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _vectors(rows: np.ndarray) -> pa.Array:
    return pa.array(list(rows), type=pa.list_(pa.float64()))


PASSED = ("x", "lo", "hi", "s")


class Block(NamedTuple):
    """Points in leaves of LEAF successive ones (the last may be shorter), the hashes of their keys and the leaves' sizes, bounds and sums."""

    x: np.ndarray
    h: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    s: np.ndarray


def _leaf_order(x: np.ndarray) -> np.ndarray:
    """An order in which every LEAF successive points lie close together: halves by the widest dimension, again and again."""
    order, open_ = np.arange(len(x)), [(0, len(x))]
    while open_:
        a, b = open_.pop()
        if b - a <= LEAF:
            continue
        part, middle = x[order[a:b]], LEAF * ((-(-(b - a) // LEAF) + 1) // 2)
        order[a:b] = order[a:b][np.argpartition(part[:, np.ptp(part, axis=0).argmax()], middle)]
        open_ += [(a, a + middle), (a + middle, b)]
    return order


def packed(points: DataFrame, key: str, seed: int) -> DataFrame:
    """All points as blocks of up to BLOCK; checkpointed, as every pass reads it. least, first: the smallest hash and its point."""

    def rows(x: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = _leaf_order(x)
        x, h = x[order], h[order]
        for i in range(0, len(x), BLOCK):
            p, g = x[i : i + BLOCK], h[i : i + BLOCK]
            starts, j = np.arange(0, len(p), LEAF), g.argmin()
            parts = {"x": p, "h": g} | {name: f.reduceat(p, starts, axis=0) for name, f in (("lo", np.minimum), ("hi", np.maximum), ("s", np.add))}
            yield _batch({"least": g[j : j + 1], "first": _vectors(p[j : j + 1])} | {name: pa.array([v.tobytes()]) for name, v in parts.items()})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, hs, size = [], [], 0
        for b in batches:
            if len(b):
                xs.append(matrix(b.column("x")))
                hs.append(b.column("h").to_numpy())
                size += xs[-1].size
            if size >= TREE:
                yield from rows(np.vstack(xs), np.concatenate(hs))
                xs, hs, size = [], [], 0
        if xs:
            yield from rows(np.vstack(xs), np.concatenate(hs))

    hashed = points.select("x", F.xxhash64(F.col(key), F.lit(seed)).alias("h"))
    blocks = checkpointed(hashed.mapInArrow(pack, "least long, first array<double>, x binary, h binary, lo binary, hi binary, s binary"))
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-blocks.rdd.getNumPartitions() // 4))
    return blocks.coalesce(tasks)  # a pass over packed points is short: fewer tasks than it took to read them


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Block]:
    """The blocks of a pass that was sent PASSED, or those and the hashes."""
    for b in batches:
        for i in range(len(b)):
            x, lo, hi, s = (np.frombuffer(b.column(name)[i].as_buffer()).reshape(-1, dims) for name in PASSED)
            n = np.full(len(lo), LEAF)
            n[-1] = len(x) - LEAF * (len(lo) - 1)
            h = np.frombuffer(b.column("h")[i].as_buffer(), dtype=np.int64) if "h" in b.schema.names else np.empty(0, dtype=np.int64)
            yield Block(x, h, n, lo, hi, s)


def _bounds(lo: np.ndarray, hi: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances from each centre to the nearest and to the farthest place of each box."""
    least, most = np.zeros((len(lo), len(centres))), np.zeros((len(lo), len(centres)))
    for i in range(centres.shape[1]):
        below, above = lo[:, i, None] - centres[:, i], centres[:, i] - hi[:, i, None]
        least += np.maximum(np.maximum(below, above), 0) ** 2
        most += np.minimum(below, above) ** 2
    return least, most


def _near(lo: np.ndarray, hi: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each box and centre: may the centre be the nearest of a point in the box? Rounding is allowed for."""
    least, most = _bounds(lo, hi, centres)
    bound = most.min(1, keepdims=True)
    return least <= bound + 1e-9 * (bound + (lo**2).max(1, keepdims=True, initial=0) + (hi**2).max(1, keepdims=True, initial=0))


def _nearest(b: Block, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest for a block: a leaf is compared with those centres only that may be the nearest of one of its points."""
    index, squared = np.empty(len(b.x), dtype=np.int64), np.empty(len(b.x))
    some = np.flatnonzero(_near(b.lo.min(0, keepdims=True), b.hi.max(0, keepdims=True), centres)[0])
    near = _near(b.lo, b.hi, centres[some])
    for i in range(len(near)):
        j, at = some[near[i]], slice(i * LEAF, (i + 1) * LEAF)
        k, squared[at] = nearest(b.x[at], centres[j])
        index[at] = j[k]
    return index, squared


def _uniform(h: np.ndarray, r: int) -> np.ndarray:
    """A number in [0, 1) per hash and round."""
    z = h.view(np.uint64) + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def seeds(blocks: DataFrame, k: int, rounds: int = 5, oversample: float = 2.0, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """k starting centres by parallel oversampled seeding over all points, and all candidates for them.

    Per round oversample x k candidates are expected. The draw of a point depends on its key and the round alone, so a task
    that is run again draws the same.
    """
    first = blocks.select("least", "first").orderBy("least", "first").limit(1).collect()
    if not first:
        return np.empty((0, 0)), np.empty((0, 0))
    candidates = np.array([first[0]["first"]])
    dims = candidates.shape[1]

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _batch({"cost": [sum(float(_nearest(b, chosen)[1].sum()) for b in _blocks(batches, dims))]})

    for r in range(rounds):
        chosen = candidates
        phi = blocks.select(*PASSED).mapInArrow(cost, "cost double").agg(F.sum("cost")).first()[0] or 0.0
        if phi <= 0:
            break

        def draw(batches: Iterator[pa.RecordBatch], phi=phi, chosen=chosen, r=r) -> Iterator[pa.RecordBatch]:
            for b in _blocks(batches, dims):
                hit = _uniform(b.h, r) < np.minimum(1, oversample * k * _nearest(b, chosen)[1] / phi)
                yield _batch({"x": _vectors(b.x[hit])})

        drawn = blocks.select(*PASSED, "h").mapInArrow(draw, "x array<double>").collect()
        if drawn:
            candidates = np.unique(np.vstack([candidates, np.array([d["x"] for d in drawn])]), axis=0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(len(candidates), dtype=np.int64)
        for b in _blocks(batches, dims):
            weights += np.bincount(_nearest(b, candidates)[0], minlength=len(candidates))
        yield _batch({"c": np.flatnonzero(weights), "n": weights[weights > 0]})

    counted = blocks.select(*PASSED).mapInArrow(weigh, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    weights = np.zeros(len(candidates))
    for r in counted:
        weights[r["c"]] = r["n"]
    return _reduce(candidates, weights, k, np.random.default_rng(seed)), candidates


def _reduce(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ over the candidates; fewer than k candidates are all taken."""
    if len(candidates) <= k:
        return candidates
    chosen = [int(weights.argmax())]
    d = ((candidates - candidates[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and (d * weights).sum() > 0:
        p = d * weights
        chosen.append(int(rng.choice(len(candidates), p=p / p.sum())))
        d = np.minimum(d, ((candidates - candidates[chosen[-1]]) ** 2).sum(1))
    return candidates[chosen]


def _means(blocks: DataFrame, centres: np.ndarray, radius: float | np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New centres, records per centre and the moves. One row per centre and partition is shuffled.

    Each record counts for its nearest centre, or with a radius (one for all centres or one each) for every centre within it.
    Centres of no records stay.
    """
    k, dims = centres.shape
    limit = None if radius is None else np.broadcast_to(np.square(radius), k)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims)), np.zeros(k, dtype=np.int64)
        for b in _blocks(batches, dims):
            lo, hi = b.lo.min(0, keepdims=True), b.hi.max(0, keepdims=True)
            if limit is None:
                some = np.flatnonzero(_near(lo, hi, centres)[0])
                near = _near(b.lo, b.hi, centres[some])
                whole, open_ = near & (near.sum(1, keepdims=True) == 1), near & (near.sum(1, keepdims=True) > 1)
            else:
                some = np.flatnonzero(_bounds(lo, hi, centres)[0][0] <= limit * (1 + 1e-9))
                least, most = _bounds(b.lo, b.hi, centres[some])
                whole = most < limit[some] * (1 - 1e-9)
                open_ = (least <= limit[some] * (1 + 1e-9)) & ~whole
            total[some] += whole.T.astype(float) @ b.s
            count[some] += whole.T @ b.n
            for i in np.flatnonzero(open_.any(1)):
                j, p = some[open_[i]], b.x[i * LEAF : (i + 1) * LEAF]
                if limit is None:
                    member = np.zeros((len(p), len(j)))
                    member[np.arange(len(p)), nearest(p, centres[j])[0]] = 1
                else:
                    member = ((p**2).sum(1)[:, None] - 2 * p @ centres[j].T + (centres[j] ** 2).sum(1) <= limit[j]).astype(float)
                total[j] += member.T @ p
                count[j] += member.sum(0).astype(np.int64)
        used = np.flatnonzero(count)
        yield _batch({"c": used, "n": count[used], "s": _vectors(total[used])})

    parts = blocks.select(*PASSED).mapInArrow(sums, "c long, n long, s array<double>")
    merged = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dims)]).alias("s")).collect()
    new, counts = centres.copy(), np.zeros(k, dtype=np.int64)
    for r in merged:
        new[r["c"]], counts[r["c"]] = np.array(r["s"]) / r["n"], r["n"]
    return new, counts, np.sqrt(((new - centres) ** 2).sum(1))


def fit(
    points: DataFrame, key: str, k: int, iterations: int = 8, radius: float | None = None, seed: int = 11,
    starts: np.ndarray | None = None, gap: tuple[float, float] | None = None,
) -> np.ndarray:
    """Centres of the clusters, from all points in every pass. With a radius: refined and merged, largest cluster first.

    starts: places to refine besides those found. gap: two radii; a place with more points between them than within the first
    is no cluster.
    """
    blocks = packed(points, key, seed)
    centres, candidates = seeds(blocks, k, seed=seed)
    if not len(centres):
        return centres
    for _ in range(iterations):
        centres, _, moved = _means(blocks, centres, None)
        if moved.max() < 1e-6:
            break
    if radius is None:
        return centres
    centres = np.vstack([centres, candidates] + ([starts] if starts is not None and len(starts) else []))
    going, moved = np.arange(len(centres)), np.array([np.inf])
    for _ in range(MOST_ROUNDS):
        places, which = np.unique(centres[going], axis=0, return_inverse=True)  # centres in one place stay together
        new, _, moved = _means(blocks, places, radius)
        centres[going], moved = new[which.ravel()], moved[which.ravel()]
        if moved.max() < radius / 100:
            break
        going = going[moved > 0]  # a centre that did not move at all never will
    else:
        raise RuntimeError(f"centres still move by {moved.max()} after {MOST_ROUNDS} rounds")
    centres = np.unique(centres, axis=0)
    radii = (radius, *(gap or ()))
    counts, *around = _means(blocks, np.tile(centres, (len(radii), 1)), np.repeat(radii, len(centres)))[1].reshape(len(radii), -1)
    if around:
        counts[around[1] > 2 * around[0]] = 0
    merged: list[np.ndarray] = []
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] and all(((centres[i] - m) ** 2).sum() > (radius / 2) ** 2 for m in merged):
            merged.append(centres[i])
    return np.array(merged).reshape(len(merged), centres.shape[1])


def assign(points: DataFrame, key: str, centres: np.ndarray, radius: float | None = None) -> DataFrame:
    """(key, cluster, distance) of every point within the radius of its nearest centre (no radius: of every point)."""
    schema = f"`{key}` {dict(points.dtypes)[key]}, cluster int, distance double"

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b) and len(centres):
                j, d = nearest(matrix(b.column("x")), centres)
                out = _batch({key: b.column(key), "cluster": j.astype("int32"), "distance": np.sqrt(d)})
                yield out if radius is None else out.filter(pa.array(d <= radius**2))

    return points.select(key, "x").mapInArrow(assigned, schema)


def describe(assigned: DataFrame, key: str, members: int = 5) -> DataFrame:
    """(cluster, size, member_rank, key, distance): the size of each cluster and the members nearest to its centre.

    Ties in distance go to the smaller key. The top members are cut per partition before they are shuffled.
    """
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("size"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("distance", key))
    typical = assigned.withColumn("member_rank", rank).filter(F.col("member_rank") <= members)
    return typical.join(F.broadcast(sizes), "cluster").select("cluster", "size", "member_rank", key, "distance")


# Features of a group of alike tracks, their weights and their valid ranges.
TRACK_WEIGHTS = {"danceability": 1.0, "energy": 1.0, "tempo": 1 / 150, "loudness": 1 / 30}
GROUP_RADIUS, GAP_RADIUS = 0.12, 0.18


def track_points(tracks: DataFrame) -> DataFrame:
    """(row_num, x) of the tracks whose four features are valid; checkpointed, as every pass reads it."""
    valid = F.col("danceability").between(0, 1) & F.col("energy").between(0, 1) & (F.col("tempo") > 0) & (F.col("tempo") <= 300) & F.col("loudness").between(-60, 5)
    return checkpointed(vectorised(tracks, "row_num", TRACK_WEIGHTS, valid))


def track_groups(tracks: DataFrame, groups: int, starts: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """(row_num, cluster, distance) of the tracks in a group, and the centres. Three centres are fitted per expected group, so
    that rows of no group have centres of their own, which the gap round a group then tells from groups."""
    points, radius = track_points(tracks), (GROUP_RADIUS + GAP_RADIUS) / 2
    centres = fit(points, "row_num", 3 * groups, radius=radius, starts=starts, gap=(GROUP_RADIUS, GAP_RADIUS))
    return assign(points, "row_num", centres, radius), centres


def anchored_groups(tracks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(row_num, anchor_id): each track in a group, with the anchor in the same group.

    An anchor belongs to the nearest centre within the group radius and half the gap; centres are also looked for at the anchors.
    Anchors of no group or with a null value, and groups of no anchor, give no rows; rows of one key are one row.
    """
    count = anchors.count()
    known = vectorised(anchors.select("anchor_id", *TRACK_WEIGHTS), "anchor_id", TRACK_WEIGHTS, F.lit(True))
    starts = matrix(known.select("x").toArrow().column("x").combine_chunks())
    assigned, centres = track_groups(tracks, max(1, count), starts[np.isfinite(starts).all(1)])
    table = assign(known, "anchor_id", centres, (GROUP_RADIUS + GAP_RADIUS) / 2).select("cluster", "anchor_id")
    if count <= BROADCAST_ANCHORS:
        joined = assigned.join(F.broadcast(table), "cluster")
    else:
        table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = assigned.withColumn("_salt", F.pmod(F.xxhash64("row_num"), F.lit(SALTS)).cast("int")).join(table, ["cluster", "_salt"])
    return joined.select("row_num", "anchor_id").distinct()
