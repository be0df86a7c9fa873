"""Vector algebra on array<double> columns and on feature columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import AUDIO_FEATURES, AUDIO_WEIGHT, TEXT_DIMS, TEXT_WEIGHT
from trackloom.functions.parse import FeatureFilter


def dot(left: Column, right: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)


def dot_with(vector: Column, query: list[float]) -> Column:
    """Inner product with one fixed vector, a matrix product per Arrow batch. Null vectors give null."""
    q = np.asarray(query, dtype=float)

    @F.pandas_udf("double")
    def product(vectors: pd.Series) -> pd.Series:
        known = vectors.notna().to_numpy()
        out = np.full(len(vectors), None, dtype=object)
        if known.any():
            out[known] = np.stack(vectors.to_numpy()[known]).astype(float) @ q
        return pd.Series(out)

    return product(vector)


def l2_normalize(vector: Column) -> Column:
    """Unit length; a vector of zeros stays."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x.cast("double") / norm))


def compose(text: Column, audio: Column, text_weight: float = TEXT_WEIGHT, audio_weight: float = AUDIO_WEIGHT) -> Column:
    """Unit vector of the weighted text vector followed by the weighted unit audio vector; zeros stay zeros.

    Done per Arrow batch: array lambdas over hundreds of elements are interpreted one by one. Null in, null out.
    """

    @F.pandas_udf("array<double>")
    def composed(texts: pd.Series, audios: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        known = (texts.notna() & audios.notna()).to_numpy()
        if known.any():
            t, a = np.stack(texts[known].to_numpy()).astype(float), np.stack(audios[known].to_numpy()).astype(float)
            whole = np.hstack([t * text_weight, _unit(a) * audio_weight])
            for i, row in zip(np.flatnonzero(known), _unit(whole)):
                out.iat[i] = row
        return out

    return composed(text, audio)


def _columns(values: list[pd.Series]) -> np.ndarray:
    return np.column_stack([v.to_numpy(dtype=float) for v in values])


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


def query_audio_vector(filters: list[FeatureFilter], features: list[str] = AUDIO_FEATURES) -> list[float]:
    """+1 for a feature wanted high, -1 for low, 0 otherwise; a later filter on a feature wins, unknown features are ignored."""
    slots = dict.fromkeys(features, 0.0)
    for feature, op, _ in filters:
        if feature in slots:
            slots[feature] = 1.0 if op == ">" else -1.0
    return list(slots.values())


def minmax_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, min, max), null for an empty df."""
    row = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in features for n, f in (("min", F.min), ("max", F.max))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max")) for c in features])))


def minmax_scaled(value: Column, low: Column, high: Column) -> Column:
    """0 to 1; 0.5 where all values are equal."""
    return F.when(high == low, 0.5).otherwise((value - low) / (high - low))


def minmax_applied(df: DataFrame, features: list[str]) -> DataFrame:
    """df with each feature scaled by its extrema, which are one row."""
    row = df.agg(*[f(c).alias(f"_{n}_{c}") for c in features for n, f in (("min", F.min), ("max", F.max))])
    scaled = {c: minmax_scaled(F.col(c).cast("double"), F.col(f"_min_{c}"), F.col(f"_max_{c}")) for c in features}
    return df.crossJoin(F.broadcast(row)).withColumns(scaled).drop(*row.columns)  # one row


def normalized_scores(score: str, keys: list[str]) -> Column:
    """Min-max of a score within each group of keys; 0.5 where all are equal."""
    group = Window.partitionBy(*keys)
    return minmax_scaled(F.col(score).cast("double"), F.min(score).over(group), F.max(score).over(group))


def mean_vector(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """Keys and the component-wise mean, renormalised. Partial sums are shuffled, one row per group and component."""
    parts = df.select(*keys, F.posexplode(vector).alias("_p", "_x")).groupBy(*keys, "_p").agg(F.avg("_x").alias("_x"))
    gathered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_x"))).alias("_v"))
    return gathered.select(*keys, l2_normalize(F.transform("_v", lambda s: s["_x"])).alias(vector))


AUDIO_DIMS = ["danceability", "energy", "valence", "acousticness", "instrumentalness", "tempo", "loudness"]


def audio_vector7(feature) -> Column:
    """Unit vector of seven features: tempo over 200 up to 1, loudness from -60 to 0. A null counts as raw 0.5 before scaling.

    feature: name -> Column.
    """
    raw = {d: F.coalesce(F.nanvl(feature(d).cast("double"), F.lit(None).cast("double")), F.lit(0.5)) for d in AUDIO_DIMS}
    raw["tempo"] = F.least(raw["tempo"] / 200.0, F.lit(1.0))
    raw["loudness"] = F.least(F.greatest((raw["loudness"] + 60) / 60.0, F.lit(0.0)), F.lit(1.0))
    norm = F.sqrt(sum((raw[d] * raw[d] for d in AUDIO_DIMS), F.lit(0.0)))
    return F.array(*[F.when(norm > 0, raw[d] / norm).otherwise(raw[d]) for d in AUDIO_DIMS])


@dataclass(frozen=True)
class HashEmbedder:
    """A deterministic bag-of-tokens embedding: each token adds a signed 1 to a slot given by its MD5; unit length.

    Another embedder needs the same two methods; one around a pretrained model may load it in each worker.
    """

    dims: int = TEXT_DIMS

    def column(self, text: Column) -> Column:
        """array<double>; zeros for a null and for a text without tokens."""

        @F.pandas_udf("array<double>")
        def filled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, np.ndarray] = {}
            for texts in batches:
                yield pd.Series(list(self._vectors(texts, known)), dtype=object)

        return filled(text)

    def composed(self, text: Column, audio: list[Column]) -> Column:
        """array<float>: the unit vector of weighted text and unit audio, in one crossing to Python."""

        @F.pandas_udf("array<float>")
        def filled(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            known: dict[str, np.ndarray] = {}
            for texts, *audios in batches:
                rows = np.array(self._known(texts, known, self.vector)).reshape(len(texts), self.dims) * TEXT_WEIGHT
                yield pd.Series(list(_unit(np.hstack([rows, _unit(_columns(audios)) * AUDIO_WEIGHT])).astype(np.float32)), dtype=object)

        return filled(text, *audio)

    def similarity(self, text: Column, audio: list[Column], query: np.ndarray) -> Column:
        """The cosine of composed(text, audio) with a unit query, without making the vectors: per distinct text one inner product."""
        by_text, by_audio = query[: self.dims] * TEXT_WEIGHT, query[self.dims :] * AUDIO_WEIGHT

        def measured(t: str) -> np.ndarray:
            v = self.vector(t)
            return np.array([v @ by_text, (v @ v) * TEXT_WEIGHT**2])

        @F.pandas_udf("double")
        def cosine(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            known: dict[str, np.ndarray] = {}
            for texts, *audios in batches:
                parts = np.array(self._known(texts, known, measured)).reshape(-1, 2)
                unit = _unit(_columns(audios))
                norm = np.sqrt(parts[:, 1] + (unit**2).sum(1) * AUDIO_WEIGHT**2)
                yield pd.Series((parts[:, 0] + unit @ by_audio) / np.where(norm == 0, 1, norm))

        return cosine(text, *audio)

    def bucket_keys(self, text: Column, audio: list[Column], planes: np.ndarray) -> Column:
        """array<int>: lsh.bucket_keys of composed(text, audio), without making the vectors; length does not change a side."""
        tables, bits, _ = planes.shape
        flat, powers = planes.reshape(tables * bits, -1).T, 1 << np.arange(bits)
        by_text, by_audio = flat[: self.dims] * TEXT_WEIGHT, flat[self.dims :] * AUDIO_WEIGHT

        @F.pandas_udf("array<int>")
        def keys(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            known: dict[str, np.ndarray] = {}
            for texts, *audios in batches:
                sides = np.array(self._known(texts, known, lambda t: self.vector(t) @ by_text)).reshape(-1, tables * bits) + _unit(_columns(audios)) @ by_audio
                yield pd.Series(list(((sides > 0).reshape(-1, tables, bits) * powers).sum(2).astype("int32")), dtype=object)

        return keys(text, *audio)

    def _vectors(self, texts: pd.Series, known: dict[str, np.ndarray]) -> list[np.ndarray]:
        return self._known(texts, known, self.vector)

    @staticmethod
    def _known(texts: pd.Series, known: dict[str, np.ndarray], made) -> list[np.ndarray]:
        """made(text) of each. Descriptions repeat, so results are kept, up to 10,000 per task."""
        if len(known) > 10_000:
            known.clear()
        out = []
        for t in texts:
            t = t or ""
            if t not in known:
                known[t] = made(t)
            out.append(known[t])
        return out

    def vector(self, text: str) -> np.ndarray:
        """The same on the driver."""
        import hashlib

        from trackloom.functions.text import tokens_of

        v = np.zeros(self.dims)
        for t in tokens_of(text):
            digest = hashlib.md5(t.encode()).hexdigest()
            v[int(digest[:7], 16) % self.dims] += 1.0 if int(digest[7:14], 16) % 2 == 0 else -1.0
        norm = np.sqrt((v * v).sum())
        return v / norm if norm else v
