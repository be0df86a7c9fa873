"""Random-hyperplane hashing: buckets, multiprobe with early stop, candidates. For many queries at once."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import LSH_BITS, LSH_SEED, LSH_TABLES, MIN_CANDIDATES, PROBE_RADIUS


def normal_planes(dims: int, tables: int = LSH_TABLES, bits: int = LSH_BITS, seed: int = LSH_SEED) -> np.ndarray:
    """Unit normals drawn with a seed: (tables, bits, dims)."""
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
    return planes / np.linalg.norm(planes, axis=2, keepdims=True)


def portable_planes(dims: int, tables: int = LSH_TABLES, bits: int = LSH_BITS) -> np.ndarray:
    """Planes given by integer arithmetic, the same in any engine: uniform in [-0.5, 0.5)."""
    i = np.arange(tables * bits * dims, dtype=np.uint64).reshape(tables, bits, dims)
    return (i * np.uint64(2654435761) % np.uint64(1 << 32)).astype(float) / float(1 << 32) - 0.5


def bucket_keys(vector: Column, planes: np.ndarray) -> Column:
    """array<int>: per table the bits of the planes the vector lies above (strictly), bit i from plane i. Null for null."""
    tables, bits, dims = planes.shape
    flat, powers = planes.reshape(tables * bits, dims).T, 1 << np.arange(bits)

    @F.pandas_udf("array<int>")
    def keys(vectors: pd.Series) -> pd.Series:
        known = vectors.notna().to_numpy()
        out = np.full(len(vectors), None, dtype=object)
        if known.any():
            above = (np.stack(vectors.to_numpy()[known]).astype(float) @ flat > 0).reshape(-1, tables, bits)
            for i, row in zip(np.flatnonzero(known), (above * powers).sum(2).astype("int32")):
                out[i] = row
        return pd.Series(out)

    return keys(vector)


def hashed(df: DataFrame, key: str, vector: str, planes: np.ndarray) -> DataFrame:
    """(key, table_idx, bucket) of every vector."""
    return df.select(F.col(key), F.posexplode(bucket_keys(F.col(vector), planes)).alias("table_idx", "bucket"))


def bucket_sizes(index: DataFrame) -> DataFrame:
    """(table_idx, bucket, size). Buckets stay flat rows: a full one is never gathered into one list."""
    return index.groupBy("table_idx", "bucket").agg(F.count("*").alias("size"))


def probe_masks(bits: int = LSH_BITS, radius: int = PROBE_RADIUS) -> list[tuple[int, int]]:
    """(radius, mask) of every way to flip up to `radius` bits."""
    return [(r, sum(1 << i for i in flips)) for r in range(radius + 1) for flips in combinations(range(bits), r)]


def probes(queries: DataFrame, query: str, bits: int = LSH_BITS, radius: int = PROBE_RADIUS) -> DataFrame:
    """(query, step, table_idx, bucket) to look into, in steps: table by table, radius by radius."""
    masks = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(m).alias("m")) for r, m in probe_masks(bits, radius)])
    spread = queries.select(query, "table_idx", "bucket", F.explode(masks).alias("_m"))
    return spread.select(query, (F.col("table_idx") * (radius + 1) + F.col("_m.r")).alias("step"), "table_idx", F.col("bucket").bitwiseXOR(F.col("_m.m")).alias("bucket"))


def miss_probability(cosine: float, tables: int = LSH_TABLES, bits: int = LSH_BITS, radius: int = PROBE_RADIUS) -> float:
    """That full probing with normal planes misses a vector of this cosine with the query: each bit differs with angle / pi."""
    differs = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    found = sum(math.comb(bits, r) * differs**r * (1 - differs) ** (bits - r) for r in range(radius + 1))
    return (1 - found) ** tables


def candidates(index: DataFrame, queries: DataFrame, query: str, key: str, enough: int | None = MIN_CANDIDATES, bits: int = LSH_BITS, radius: int = PROBE_RADIUS, few: bool = False) -> DataFrame:
    """(query, key, step): what the probes find, each key with its first step.

    index, queries: as `hashed` gives them. enough: after the first step with so many keys in all no further step counts, as
    when probing stops there; None probes everything. The running count has one row per query and step.
    few: the queries are so few that their probes go to every task, and the index is not shuffled.
    """
    probed = probes(queries, query, bits, radius)
    hits = (F.broadcast(probed) if few else probed).join(index, ["table_idx", "bucket"]).groupBy(query, key).agg(F.min("step").alias("step"))
    if enough is None:
        return hits
    counted = hits.groupBy(query, "step").agg(F.count("*").alias("_n"))
    running = counted.withColumn("_cum", F.sum("_n").over(Window.partitionBy(query).orderBy("step")))
    stop = running.filter(F.col("_cum") >= enough).groupBy(query).agg(F.min("step").alias("_stop"))
    return hits.join(stop, query, "left").filter(F.col("_stop").isNull() | (F.col("step") <= F.col("_stop"))).drop("_stop")
