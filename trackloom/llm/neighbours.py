"""Most similar vectors for every vector: a two-level inverted-list index scanned dimension by dimension.

Index: k-means on a bounded sample cuts space into regions, as many as give each some REGION_VECTORS vectors; every vector is put in
the region of its nearest centre. A region is searched in one task, where its vectors are cut into lists by k-means again: lists grow
with the number of vectors. (A region that is larger all the same is cut into blocks, a crowd of queries into parts.)

Scan: vectors are rotated at random, so that any first few coordinates speak for the whole distance. The queries of a list scan their
own list whole, which bounds their k-th distance; then the lists that this bound reaches, nearest first, column group by column
group: after each group a hypothesis test on the partial distance abandons candidates that would exceed the query's current k-th
distance, and the bound tightens as better candidates come in. Whether a list is reached is tested the same way. With few dimensions
both tests are looser than the plain bounds (a partial distance is never more than the whole; the triangle inequality), so nothing is
lost. Queries whose bound reaches into other regions are searched for there in a second round, within their bound.

Copies of one vector that are a large part of the sample are indexed by their first k + 1 ids and searched for once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.clusters import matrix, nearest
from trackloom.session import checkpointed, partitions

#: The regions are fitted on at most this many vectors; all vectors are indexed.
FIT_SAMPLE = 50_000
#: Vectors of a region, and vectors and queries that meet in one task at a time.
REGION_VECTORS, BLOCK = 32_768, 65_536
#: Error bounds of the hypothesis tests on partial distances and on lists: larger abandons later and loses less.
EPSILON, REACH = 2.1, 4.0
#: A vector that is so many times in the sample counts as a crowd of copies.
CROWD = 64
#: Squared distances that agree to so many places are ties.
PLACES = 12
_FOUND = "array<struct<squared:double,id:bigint>>"


@dataclass(frozen=True)
class Index:
    """vectors: (id, region, crowd, v); crowd is the number of a vector with many copies, or -1. Per region (numpy): centre, least and
    greatest distance from it, vectors. There are at most FIT_SAMPLE / 8 regions and FIT_SAMPLE / CROWD crowds."""

    vectors: DataFrame
    centres: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    sizes: np.ndarray
    rotation: np.ndarray
    crowds: int


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k centres (or as many as there are points) by k-means from random points."""
    centres = points[rng.permutation(len(points))[:k]]
    for _ in range(rounds):
        j, _ = nearest(points, centres)
        size = np.bincount(j, minlength=len(centres))
        total = np.stack([np.bincount(j, weights=column, minlength=len(centres)) for column in points.T], axis=1)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _lists_column(v: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(np.ascontiguousarray(v).ravel()))


def build(vectors: DataFrame, region_vectors: int = REGION_VECTORS, sample: int = FIT_SAMPLE, seed: int = 5) -> Index | None:
    """Index over (id bigint, v array<double>); None if there are no vectors. Repeated vectors and ids are indexed as they come.

    The sample is drawn by a hash of the id, so it is the same each time.
    """
    vectors = checkpointed(vectors.select("id", "v"))
    count = vectors.count()
    if not count:
        return None
    drawn = vectors
    if count > sample:  # a hash threshold: nothing but the sample reaches the driver
        drawn = vectors.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(0.95 * sample / count * (1 << 30)))
    arrow = drawn.select("v").limit(sample).toArrow()
    if not arrow.num_rows:
        arrow = vectors.select("v").limit(sample).toArrow()
    fitted = matrix(arrow.column("v").combine_chunks())
    turn = rotation(fitted.shape[1], seed)
    distinct, copies = np.unique(fitted, axis=0, return_counts=True)
    crowds = _rows(distinct[copies >= CROWD])
    k = max(1, min(-(-count // region_vectors), len(fitted) // 8))
    centres = means(fitted, k, np.random.default_rng(seed))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                v = matrix(b.column("v"))
                j, d = nearest(v, centres)
                crowd = np.full(len(v), -1, dtype=np.int32)
                if len(crowds):
                    rows = _rows(v)
                    at = np.minimum(np.searchsorted(crowds, rows), len(crowds) - 1)
                    crowd = np.where(crowds[at] == rows, at, -1).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "region": j.astype("int32"), "crowd": crowd, "distance": np.sqrt(d), "v": b.column("v")})

    held = checkpointed(vectors.mapInArrow(placed, "id long, region int, crowd int, distance double, v array<double>"))
    least, greatest, sizes = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    for r in held.groupBy("region").agg(F.min("distance").alias("a"), F.max("distance").alias("b"), F.count("*").alias("n")).collect():  # one row a region
        least[r["region"]], greatest[r["region"]], sizes[r["region"]] = r["a"], r["b"], r["n"]
    return Index(held.drop("distance"), centres, least, greatest, sizes, turn, len(crowds))


def _rows(v: np.ndarray) -> np.ndarray:
    """Each row as one comparable value, in byte order; -0.0 is 0.0."""
    return np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.shape[1] * 8))).ravel()


def reaches(distance: np.ndarray, least: np.ndarray, greatest: np.ndarray, dims: int) -> np.ndarray:
    """A squared distance below which a query has hardly any vector of a list, from its distance to the list's centre.

    A vector at distance r from the centre is at d2 + r2 - 2 d r cos of the query; in many dimensions the cosine is at most some
    REACH / sqrt(dims), in few it can be 1, and this is the triangle inequality.
    """
    cosine = min(1.0, REACH / dims**0.5)
    r = np.clip(cosine * distance, least, greatest)
    return distance**2 + r**2 - 2 * cosine * distance * r


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of q to all of x; exact to rounding."""
    return np.maximum((q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1), 0)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of rows of q to the same rows of x, to PLACES places, summed in the order of the columns."""
    out = np.zeros(len(q))
    for a, b in zip(q.T, x.T):
        out += (a - b) ** 2
    return np.round(out, PLACES)


def _cut(row: np.ndarray, at: np.ndarray, squared: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of each row, sorted by row, distance and id."""
    order = np.lexsort((ids[at], squared, row))
    row, at, squared = row[order], at[order], squared[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    best = place < k
    return row[best], at[best], squared[best]


def knn(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, limits: np.ndarray, k: int, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, position in x, squared distance) of up to k nearest others of each query within its squared limit, sorted.

    own: the id that a query must not find. Lists are scanned nearest first, column groups double in size.
    """
    dims, rng = x.shape[1], np.random.default_rng(3)
    turned, asked = x @ turn, q @ turn
    lists = 1 if len(x) <= 1024 else round(len(x) ** 0.5)
    centres = means(turned[rng.permutation(len(x))[: 16 * lists]], lists, rng, 4)
    home, d = nearest(turned, centres)
    order = np.argsort(home, kind="stable")
    x, turned, ids, home, d = x[order], turned[order], ids[order], home[order], np.sqrt(d[order])
    starts = np.searchsorted(home, np.arange(len(centres) + 1))
    sizes = np.diff(starts)
    filled = np.flatnonzero(sizes)
    centres, sizes, begins = centres[filled], sizes[filled], starts[filled]
    least, greatest = np.minimum.reduceat(d, begins), np.maximum.reduceat(d, begins)
    cuts = [0, dims] if dims < 16 else [0, dims // 4, dims // 2, dims]
    between = _distances(centres, centres)
    where, _ = nearest(asked, centres)
    rows = np.argsort(where, kind="stable")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low in range(0, len(rows), 512):
        for part in np.split(rows[low : low + 512], np.flatnonzero(np.diff(where[rows[low : low + 512]])) + 1):
            near = np.argsort(between[where[part[0]]], kind="stable")
            taken = int(np.searchsorted(np.cumsum(sizes[near]), min(2 * (k + 1), len(x)))) + 1
            limit = limits[part].copy()
            seen = np.concatenate([np.arange(begins[j], begins[j] + sizes[j]) for j in near[:taken]])
            full = _distances(q[part], x[seen])
            if full.shape[1] > k + 1:
                kth = np.partition(full, k, axis=1)[:, k]
                limit = np.minimum(limit, kth * (1 + 1e-9) + 1e-11)
            i, j = np.nonzero(full <= limit[:, None])
            pairs = (i, seen[j])
            found = _among(pairs, part, x, q, ids, own, k)
            limit = _tighter(limit, found, k)
            to_centres = np.sqrt(_distances(asked[part], centres[near[taken:]]))
            floor = reaches(to_centres, least[near[taken:]], greatest[near[taken:]], dims)
            rest = near[taken:]
            at = 0
            while at < len(rest):
                reached = floor[:, at:] <= limit[:, None]
                hit = np.flatnonzero(reached.any(0))
                if not len(hit):
                    break
                size = np.cumsum(sizes[rest[at:]][hit])
                group = hit[: max(1, int(np.searchsorted(size, 1 << 13)))]
                chosen = rest[at:][group]
                seen = np.concatenate([np.arange(begins[c], begins[c] + sizes[c]) for c in chosen])
                open_ = np.repeat(reached[:, group], sizes[chosen], axis=1)
                if dims < 16:
                    i, j = np.nonzero(open_ & (_distances(q[part], x[seen]) <= limit[:, None]))
                else:
                    partial = _distances(asked[part, : cuts[1]], turned[seen, : cuts[1]])
                    i, j = np.nonzero(open_ & (partial <= limit[:, None] * _ratio(cuts[1], dims, epsilon)))
                    partial = partial[i, j]
                    for a, b in zip(cuts[1:], cuts[2:]):
                        partial = partial + ((asked[part[i], a:b] - turned[seen[j], a:b]) ** 2).sum(1)
                        keep = partial <= limit[i] * _ratio(b, dims, epsilon)
                        i, j, partial = i[keep], j[keep], partial[keep]
                if len(i):
                    found = _among((np.concatenate([found[0], i]), np.concatenate([found[1], seen[j]])), part, x, q, ids, own, k)
                    limit = _tighter(limit, found, k)
                at += int(group[-1]) + 1
            out.append((part[found[0]], order[found[1]], found[2]))
    if not out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    row, at, squared = (np.concatenate(c) for c in zip(*out))
    turned_back = np.argsort(row, kind="stable")
    return row[turned_back], at[turned_back], squared[turned_back]


def _ratio(seen: int, dims: int, epsilon: float) -> float:
    """The part of the limit that the distance over `seen` of all rotated columns may hardly exceed."""
    return (1 + 1e-9) * (1.0 if seen >= dims else min(1.0, seen / dims * (1 + epsilon / seen**0.5) ** 2))


def _among(pairs, part, x, q, ids, own, k):
    i, at = pairs
    other = ids[at] != own[part[i]]
    i, at = i[other], at[other]
    return _cut(i, at, _exact(q[part[i]], x[at]), ids, k)


def _tighter(limit: np.ndarray, found, k: int) -> np.ndarray:
    row, _, squared = found
    last = np.flatnonzero(np.diff(row, append=-1) != 0)
    full = last[np.bincount(row, minlength=len(limit))[row[last]] >= k]
    limit = limit.copy()
    limit[row[full]] = np.minimum(limit[row[full]], squared[full] * (1 + 1e-9) + 1e-11)
    return limit


def _lookup(values: np.ndarray, column: Column) -> Column:
    """values[column] as a literal array; one entry a region."""
    return F.get(F.lit([int(v) for v in values]), column)


def _meeting(index: Index, base: DataFrame, asked: DataFrame | None, k: int) -> DataFrame:
    """Rows (region, block, part, role, query, id, limit, v) that meet: role 1 is indexed, 2 asked, 3 both.

    asked: (query, id, region, limit, v); None if all of base is asked. Oversized regions are cut into blocks of vectors and parts
    of queries, each block meeting each part.
    """
    region = F.col("region")
    blocks = np.maximum(1, -(-index.sizes // BLOCK))
    if asked is None:
        parts = blocks
    else:
        parts = np.ones(len(blocks), dtype=np.int64)
        for r in asked.groupBy("region").count().collect():  # one row a region
            parts[r["region"]] = -(-r["count"] // BLOCK)
    infinite = F.lit(float("inf"))
    block, part = F.pmod(F.xxhash64("id"), _lookup(blocks, region)).cast("int"), F.pmod(F.xxhash64("query", F.lit(1)), _lookup(parts, region)).cast("int")
    all_blocks, all_parts = (F.explode(F.sequence(F.lit(0), (_lookup(n, region) - 1).cast("int"))) for n in (blocks, parts))
    columns = ["region", "block", "part", "role", "query", "id", "limit", "v"]
    single = (_lookup(blocks, region) == 1) & (_lookup(parts, region) == 1)
    if asked is None:
        base = base.withColumns({"query": F.col("id"), "limit": infinite})
        if (blocks == 1).all():
            return base.withColumns({"block": F.lit(0), "part": F.lit(0), "role": F.lit(3)}).select(columns)
        both = base.filter(single).withColumns({"block": F.lit(0), "part": F.lit(0), "role": F.lit(3)}).select(columns)
        base, asked = base.filter(~single), base.filter(~single)
    else:
        both = None
        base = base.withColumns({"query": F.lit(None).cast("long"), "limit": infinite})
    held = base.withColumns({"block": block, "role": F.lit(1)}).withColumn("part", all_parts).select(columns)
    looking = asked.withColumns({"part": part, "role": F.lit(2)}).withColumn("block", all_blocks).select(columns)
    out = held.unionByName(looking)
    return out.unionByName(both) if both is not None else out


def _met(index: Index, rows: DataFrame, k: int, first: bool) -> DataFrame:
    """(query, found) of each task; in the first round also what is needed to go on: id, limit, v and the regions reached."""
    centres, least, greatest, sizes, turn = index.centres, index.least, index.greatest, index.sizes, index.rotation
    schema = f"query long, found {_FOUND}" + (", id long, limit double, v array<double>, reach array<int>" if first else "")

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        home, block = key[0].as_py(), key[1].as_py()
        role = table.column("role").to_numpy()
        v, ids = matrix(table.column("v").combine_chunks()), table.column("id").to_numpy()
        held, asking = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        names = table.column("query").take(pa.array(asking)).to_numpy()
        limits, own, q = table.column("limit").to_numpy()[asking].copy(), ids[asking], v[asking]
        if first and block == 0:
            for low in range(0, len(q), 4096):  # a bound before anything is scanned: the nearest regions that hold k + 1 vectors
                far = np.sqrt(_distances(q[low : low + 4096], centres))
                near = np.argsort(far, axis=1)
                enough = (np.cumsum(sizes[near], axis=1) >= k + 1).argmax(1)
                reach = np.maximum.accumulate(np.take_along_axis(far + greatest, near, 1), axis=1)
                bound = np.where(sizes.sum() > k, reach[np.arange(len(near)), enough] ** 2 * (1 + 1e-9) + 1e-11, np.inf)
                limits[low : low + 4096] = np.minimum(limits[low : low + 4096], bound)
        own = np.where(np.isnan(own.astype(float)), -1, own).astype(np.int64) if own.dtype.kind == "f" else own
        row, at, squared = knn(ids[held].astype(np.int64), v[held], own, q, limits, k, turn) if len(held) and len(q) else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        offsets = np.searchsorted(row, np.arange(len(q) + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(squared), pa.array(ids[held][at].astype(np.int64))], ["squared", "id"])
        found = pa.ListArray.from_arrays(pa.array(offsets), pairs)
        columns = {"query": pa.array(names.astype(np.int64)), "found": found}
        if first:
            full = np.flatnonzero(np.diff(offsets) >= k)
            limits[full] = np.minimum(limits[full], squared[offsets[full + 1] - 1] * (1 + 1e-9) + 1e-11)
            counts, reached = np.zeros(len(q), dtype=np.int32), []
            for low in range(0, len(q) if block == 0 else 0, 4096):
                d = np.sqrt(_distances(q[low : low + 4096], centres))
                hit = (reaches(d, least, greatest, q.shape[1]) <= limits[low : low + 4096, None]) & (sizes > 0)
                hit[:, home] = False
                counts[low : low + 4096] = hit.sum(1)
                reached.append(np.nonzero(hit)[1])
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            crossing = counts > 0
            widths = np.where(crossing, q.shape[1], 0)
            columns |= {
                "id": pa.array(own), "limit": pa.array(limits),
                "v": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)), pa.array(q[crossing].ravel())),
                "reach": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(reached).astype(np.int32) if reached else np.empty(0, dtype=np.int32))),
            }
        return pa.table(columns)

    # By number, so that tasks of few bytes but much work are not put together.
    groups = int((np.maximum(1, -(-index.sizes // BLOCK)) ** 2).sum())
    spread = rows.repartition(max(groups, partitions(rows.sparkSession)), "region", "block", "part")
    return spread.groupBy("region", "block", "part").applyInArrow(meet, schema)


def _base(index: Index, k: int) -> DataFrame:
    """The indexed vectors; of a crowd of copies the k + 1 smallest ids."""
    if not index.crowds:
        return index.vectors
    rank = F.row_number().over(Window.partitionBy("crowd").orderBy("id"))  # cut to k + 1 before the shuffle
    few = index.vectors.filter("crowd >= 0").withColumn("_rank", rank).filter(F.col("_rank") <= k + 1).drop("_rank")
    return index.vectors.filter("crowd < 0").unionByName(few)


def search(index: Index | None, queries: DataFrame | None, k: int) -> DataFrame:
    """(query, id, rank, squared) of the k nearest other vectors of each query; ties go to the smaller id.

    queries: (query bigint unique, self bigint: the id a query must not find or null, v array<double>); None asks every indexed
    vector, with its id as query. A query for which the index holds fewer than k others gets them all. No index: empty.
    """
    if index is None:
        spark = queries.sparkSession if queries is not None else None
        return spark.createDataFrame([], "query long, id long, rank int, squared double")
    base = _base(index, k)
    if queries is not None:
        best = _search(index, base, _placed(index, queries), k)
    elif not index.crowds:
        best = _search(index, base, None, k)
    else:
        # Of a crowd the first is asked, for one more and for itself too; every copy then leaves itself out.
        first = index.vectors.filter("crowd >= 0").groupBy("crowd").agg(F.min_by(F.struct("id", "v"), "id").alias("_r"))
        asked = index.vectors.filter("crowd < 0").select(F.col("id").alias("query"), F.col("id").alias("self"), "v")
        single = _search(index, base, _placed(index, asked), k)
        shared = _search(index, base, _placed(index, first.select(F.col("crowd").cast("long").alias("query"), F.lit(None).cast("long").alias("self"), "_r.v")), k + 1)
        copies = index.vectors.filter("crowd >= 0").select(F.col("id").alias("query"), F.col("crowd").cast("long").alias("_c"))
        copies = copies.join(F.broadcast(shared.withColumnRenamed("query", "_c")), "_c")  # one row a crowd
        others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query")), 1, k)
        best = single.unionByName(copies.select("query", others.alias("found")))
    ranked = best.select("query", F.posexplode("found").alias("_p", "_f"))
    return ranked.select("query", F.col("_f.id").alias("id"), (F.col("_p") + 1).alias("rank"), F.col("_f.squared").alias("squared"))


def _placed(index: Index, queries: DataFrame) -> DataFrame:
    """(query, id, region, limit, v): queries with the nearest region that holds vectors."""
    filled = np.flatnonzero(index.sizes)
    centres = index.centres[filled]

    def nearest_region(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                j, _ = nearest(matrix(b.column("v")), centres)
                yield pa.RecordBatch.from_pydict({"query": b.column("query"), "id": b.column("self"), "region": filled[j].astype("int32"), "limit": np.full(len(b), np.inf), "v": b.column("v")})

    return checkpointed(queries.select("query", F.coalesce("self", F.lit(-1 << 62)).alias("self"), "v").mapInArrow(nearest_region, "query long, id long, region int, limit double, v array<double>"))


def _search(index: Index, base: DataFrame, asked: DataFrame | None, k: int) -> DataFrame:
    """(query, found): the k nearest of each query, in order."""
    first = checkpointed(_met(index, _meeting(index, base, asked, k), k, True))
    crossing = first.filter(F.size("reach") > 0)
    again = crossing.select("query", "id", "limit", "v", F.explode("reach").alias("region"))
    wanted = [r[0] for r in again.select("region").distinct().collect()]  # one row a region
    parts = first.select("query", "found")
    if wanted:
        # Those that cross no border, and whose region is one block, are done.
        split = bool((index.sizes > BLOCK).any())
        second = _met(index, _meeting(index, base.filter(F.array_contains(F.lit(wanted), F.col("region"))), again, k), k, False).filter(F.size("found") > 0)
        done = None if split else first.filter(F.size("reach") == 0).select("query", "found")
        open_ = (first if split else crossing).select("query", "found").unionByName(second)
    elif (index.sizes > BLOCK).any():
        done, open_ = None, parts
    else:
        return parts
    merged = open_.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    return merged if done is None else done.unionByName(merged)


# Fixed value: the features of a track's vector, unscaled, each in [0, 1].
TRACK_VECTOR = ["danceability", "energy", "valence", "acousticness"]


def track_vectors(tracks: DataFrame) -> DataFrame:
    """(track, id, v): each track id once, by its row of smallest row_num (the vector's id), if all four values are in [0, 1].

    Tracks without an id take no part.
    """
    first = tracks.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("track")).agg(
        F.min_by(F.struct("row_num", *TRACK_VECTOR), "row_num").alias("_r")
    )
    sound = first.select("track", "_r.*")
    for name in TRACK_VECTOR:
        sound = sound.filter(F.col(name).between(0, 1))
    return sound.select("track", F.col("row_num").alias("id"), F.array(*TRACK_VECTOR).alias("v"))


def probe_neighbours(tracks: DataFrame, probes: DataFrame, k: int = 10) -> DataFrame:
    """(probe_id, row_num): for each probe the k nearest other tracks. Probes whose track takes no part give no rows."""
    vectors = checkpointed(track_vectors(tracks))
    asked = probes.join(vectors.withColumnRenamed("id", "self"), F.col("track_id") == F.col("track"))
    asked = asked.select(F.col("probe_id").alias("query"), "self", "v")
    found = search(build(vectors.select("id", "v")), asked, k)
    return found.select(F.col("query").alias("probe_id"), F.col("id").alias("row_num"))


def all_neighbours(tracks: DataFrame, k: int = 10) -> DataFrame:
    """(row_num, neighbour, rank, distance) of every track that takes part."""
    vectors = track_vectors(tracks).select("id", "v")
    index = build(vectors)
    if index is None:
        return tracks.sparkSession.createDataFrame([], "row_num long, neighbour long, rank int, distance double")
    found = search(index, None, k)
    return found.select(F.col("query").alias("row_num"), F.col("id").alias("neighbour"), "rank", F.round(F.sqrt("squared"), 9).alias("distance"))


def embedding_neighbours(embeddings: DataFrame, k: int = 10, every: int = 20) -> DataFrame:
    """(vec_id, neighbour, rank) of the vectors whose id is divisible by `every`, among all. Null vectors take no part."""
    vectors = embeddings.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    queries = vectors.filter(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query"), F.col("id").alias("self"), "v")
    index = build(vectors)
    if index is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, neighbour long, rank int")
    return search(index, queries, k).select(F.col("query").alias("vec_id"), F.col("id").alias("neighbour"), "rank")
