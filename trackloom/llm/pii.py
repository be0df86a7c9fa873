"""Personal information inside free text: weak labelers vote, their reliabilities are estimated, a span classifier decides.

1. Candidate spans of each kind are cut out of every text and labelers vote on each (trackloom.llm.pii_spans): the form of the span,
   gazetteers, the words before and after it, and other details in the same sentence.
2. Expectation-maximisation over the counts of vote patterns, at most 3^5 per kind from all documents, estimates how reliable
   each labeler is and how likely each pattern is a true detail. Nothing but the start of the search prefers any labeler.
3. A logistic span classifier over votes, shape and context words is trained on these probabilities, on a bounded sample of
   candidates; it decides for every candidate of every document. What it calls a person's name makes later mentions of the
   family name in the same text personal too.

Texts are read once: candidates with their votes and hashed features are written to the checkpoint folder, counted there, and
judged there. Only counts, the sample and the weights pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.pii_spans import FEATURES, KINDS, LABELERS, PERSON_KIND, WIDTH, Candidate, Gazetteer, Reader
from trackloom.session import checkpointed

#: Candidates per kind, drawn by hash, on which the classifier is trained; votes are counted over all candidates.
TRAIN_SAMPLE = 12_000
#: Names on a member list above this number are refused: the list is broadcast.
MAX_MEMBERS = 1_000_000
#: At most so many log odds come from the votes directly.
SWAY = 2.0

Votes = tuple[int, ...]
_CANDIDATE = "kind int, start int, end int, votes int, features array<int>, family string, mention boolean, found string"


def packed_votes(votes: Votes) -> int:
    """Votes as one number in base 3."""
    return sum((v + 1) * 3**i for i, v in enumerate(votes))


def unpacked_votes(number: int) -> Votes:
    return tuple(number // 3**i % 3 - 1 for i in range(LABELERS))


_POWERS = 3 ** np.arange(LABELERS)


@dataclass(frozen=True)
class Reliabilities:
    """What the votes say, as log odds: prior + sum of one value per labeler and vote (against, none, for)."""

    prior: float
    votes: np.ndarray

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of rows of votes."""
        return self.prior + self.votes[np.arange(self.votes.shape[0]), votes + 1].sum(1)

    def chance(self, votes: Votes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.odds(np.array([votes]))[0], -30, 30))))


def reliabilities(patterns: dict[Votes, int], rounds: int = 200) -> Reliabilities:
    """How far each vote is to be trusted, by expectation-maximisation over the counts of vote patterns.

    Each labeler has its own probabilities of voting for or against on true and on false candidates; labelers are taken as
    independent given the truth. To abstain says nothing, but for a labeler that never votes against: there it is the other vote.
    The search starts from the votes, one against counting as two for: they are given on direct evidence only. Each probability
    has the weight of one candidate spread evenly as prior, so that no vote is impossible. Without candidates nothing is true.
    """
    if not patterns:
        return Reliabilities(-30.0, np.zeros((LABELERS, 3)))
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    votes = np.array(keys)
    p = 1 / (1 + np.exp(-(2.0 * (votes == 1).sum(1) - 4.0 * (votes == -1).sum(1) - 2.0)))
    for _ in range(rounds):
        prior = (float((n * p).sum()) + 1) / (n.sum() + 2)
        table = np.zeros((votes.shape[1], 3))
        for j in range(votes.shape[1]):
            silent = 1 if (votes[:, j] == -1).any() else 0
            shares = []
            for weight in (n * p, n * (1 - p)):
                share = np.bincount(votes[:, j] + 1, weights=weight, minlength=3) + 1 / 3
                share[silent] = 0
                shares.append(share / share.sum())
            spoken = np.arange(3) != silent
            table[j, spoken] = np.log(shares[0][spoken] / shares[1][spoken])
        trust = Reliabilities(float(np.log(prior / (1 - prior))), table)
        p = 1 / (1 + np.exp(-np.clip(trust.odds(votes), -30, 30)))
    return trust


def train(features: np.ndarray, targets: np.ndarray, epochs: int = 150, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic model over hashed features (rows of slots, 0 unused; soft targets), by adaptive gradient steps."""
    w, squared = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    if not len(features):
        return w
    slots = features.ravel()
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-np.clip(w[features].sum(1), -30, 30))) - targets
        gradient = np.bincount(slots, weights=np.repeat(error, features.shape[1]), minlength=FEATURES) / len(features) + 1e-5 * w
        gradient[0] = 0
        squared += gradient**2
        w -= rate * gradient / np.sqrt(squared)
    return w


def chosen(found: list[tuple[int, int, int, str, bool, float]]) -> list[int]:
    """Which of a text's candidates (kind, start, end, family, mention, score) are details: the likeliest first, without overlap.
    A mention counts if a person of its family does."""
    order = sorted((i for i, c in enumerate(found) if not c[4] and c[5] > 0), key=lambda i: (-found[i][5], found[i][1]))
    kept: list[int] = []
    for i in order:
        if all(found[i][2] <= found[j][1] or found[j][2] <= found[i][1] for j in kept):
            kept.append(i)
    families = {found[i][3] for i in kept if found[i][0] == PERSON_KIND}
    if families:
        for i, c in enumerate(found):
            if c[4] and c[3] in families and all(c[2] <= found[j][1] or found[j][2] <= c[1] for j in kept):
                kept.append(i)
    return kept


@dataclass(frozen=True)
class Finder:
    """A trained finder, of bounded size: gazetteer, classifier weights and, per kind, the reliabilities of the labelers.

    A candidate's score is the classifier's log odds plus half of the votes' own, at most SWAY: a context that was never seen in
    training is judged by the votes, one that was by its words too.
    """

    gazetteer: Gazetteer
    weights: np.ndarray
    trusts: tuple[Reliabilities, ...]

    def scores(self, kinds: np.ndarray, votes: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Of candidates, one a row; above 0 it is a detail."""
        out = self.weights[features].sum(1)
        for k, trust in enumerate(self.trusts):
            own = kinds == k
            out[own] += np.clip(trust.odds(votes[own]) / 2, -SWAY, SWAY)
        return out

    def spans(self, text: str | None, reader: Reader | None = None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the personal details of a text, in order and without overlap."""
        found: list[Candidate] = (reader or Reader(self.gazetteer)).candidates(text)
        if not found:
            return []
        scores = self.scores(np.array([c.kind for c in found]), np.array([c.votes for c in found]), np.array([c.features for c in found]))
        kept = chosen([(c.kind, c.start, c.end, c.family, c.mention, s) for c, s in zip(found, scores)])
        return sorted((found[i].start, found[i].end, KINDS[found[i].kind]) for i in kept)

    def redacted(self, text: str | None, reader: Reader | None = None) -> str | None:
        """The text with each detail replaced by a placeholder of its kind, such as [PHONE]."""
        if text is None:
            return None
        out, at = [], 0
        for start, end, kind in self.spans(text, reader):
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        return "".join([*out, text[at:]])


def voted(documents: DataFrame, gazetteer: Gazetteer, key: str, text: str) -> DataFrame:
    """(key, candidates): the candidates of each text that has any, with votes and features."""
    shared = documents.sparkSession.sparkContext.broadcast(gazetteer)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            own, offsets, all_found, texts = [], [0], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t and (found := reader.candidates(t)):
                    own.append(i)
                    all_found += found
                    texts += [t[c.start : c.end] for c in found]
                    offsets.append(len(all_found))
            slots = np.array([c.features for c in all_found], dtype=np.int32).ravel()
            columns = [
                pa.array([c.kind for c in all_found], pa.int32()), pa.array([c.start for c in all_found], pa.int32()), pa.array([c.end for c in all_found], pa.int32()),
                pa.array([packed_votes(c.votes) for c in all_found], pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(all_found) + 1, dtype=np.int32) * WIDTH), pa.array(slots)),
                pa.array([c.family for c in all_found], pa.string()), pa.array([c.mention for c in all_found], pa.bool_()), pa.array(texts, pa.string()),
            ]
            rows = pa.StructArray.from_arrays(columns, [c.split()[0] for c in _CANDIDATE.split(", ")])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)], [key, "candidates"])

    schema = f"`{key}` {dict(documents.dtypes)[key]}, candidates array<struct<{_CANDIDATE.replace(' ', ':').replace(',:', ', ')}>>"
    return checkpointed(documents.select(key, text).mapInArrow(read, schema))


def learnt(candidates: DataFrame, gazetteer: Gazetteer, key: str) -> Finder:
    """Reliabilities from the votes on all candidates, and the classifier from a sample of them."""
    flat = candidates.select(key, F.posexplode("candidates").alias("i", "c")).filter(~F.col("c.mention"))
    counted: dict[int, dict[Votes, int]] = {k: {} for k in range(len(KINDS))}
    for r in flat.groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes")).count().collect():  # at most 5 x 3^5 rows
        counted[r["kind"]][unpacked_votes(r["votes"])] = r["count"]
    trusts = tuple(reliabilities(counted[k]) for k in range(len(KINDS)))
    # By hash: only the sample reaches the driver.
    shares = {k: 1.0 if sum(v.values()) <= TRAIN_SAMPLE else 0.95 * TRAIN_SAMPLE / sum(v.values()) for k, v in counted.items()}
    limit = F.element_at(F.array(*[F.lit(int(shares[k] * (1 << 32)) + 1) for k in range(len(KINDS))]), F.col("c.kind") + 1)
    drawn = flat.filter(F.pmod(F.xxhash64(F.col(key), "i"), F.lit(1 << 32)) < limit).select("c.kind", "c.votes", "c.features")
    sample = drawn.limit(len(KINDS) * TRAIN_SAMPLE).toArrow()
    if not sample.num_rows:
        return Finder(gazetteer, train(np.zeros((0, WIDTH), dtype=np.int64), np.zeros(0)), trusts)
    slots = sample.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.int64)
    targets = [trusts[k].chance(unpacked_votes(v)) for k, v in zip(sample.column("kind").to_pylist(), sample.column("votes").to_pylist())]
    return Finder(gazetteer, train(slots, np.array(targets)), trusts)


def gazetteer_of(members: DataFrame, name: str = "full_name") -> Gazetteer:
    known = members.select(name).filter(F.col(name).isNotNull()).limit(MAX_MEMBERS + 1).collect()
    if len(known) > MAX_MEMBERS:
        raise ValueError(f"more than {MAX_MEMBERS} members")
    return Gazetteer.of([r[0] for r in known])


def fit(documents: DataFrame, members: DataFrame, key: str = "doc_id", text: str = "text", name: str = "full_name") -> Finder:
    """Votes over all documents, reliabilities, and the classifier. No documents give a finder that finds nothing."""
    gazetteer = gazetteer_of(members, name)
    return learnt(voted(documents, gazetteer, key, text), gazetteer, key)


def judged(candidates: DataFrame, finder: Finder, key: str) -> DataFrame:
    """(key, kind, found_text), distinct, of stored candidates."""
    shared = candidates.sparkSession.sparkContext.broadcast(Finder(Gazetteer(), finder.weights, finder.trusts))  # no names are needed
    key_type = dict(candidates.dtypes)[key]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            features = flat.field("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            votes = flat.field("votes").to_numpy(zero_copy_only=False)[:, None] // _POWERS % 3 - 1
            scores = shared.value.scores(flat.field("kind").to_numpy(zero_copy_only=False), votes, features)
            columns = [flat.field(c).to_pylist() for c in ("kind", "start", "end", "family", "mention")]
            found = list(zip(*columns, scores.tolist()))
            own, kept = [], []
            for i in range(len(batch)):
                a, b = offsets[i], offsets[i + 1]
                best = chosen(found[a:b])
                own += [i] * len(best)
                kept += [int(a) + j for j in best]
            kinds = pa.array([KINDS[found[j][0]] for j in kept], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), kinds, flat.field("found").take(pa.array(kept, pa.int64()))], [key, "kind", "found_text"])

    return candidates.mapInArrow(judge, f"`{key}` {key_type}, kind string, found_text string").distinct()


def personal_details(documents: DataFrame, members: DataFrame, key: str = "doc_id", text: str = "text", name: str = "full_name") -> DataFrame:
    """(key, kind, found_text), distinct: each detail exactly as it stands. Null and empty texts hold none. Texts are read once."""
    gazetteer = gazetteer_of(members, name)
    candidates = voted(documents, gazetteer, key, text)
    return judged(candidates, learnt(candidates, gazetteer, key), key)


def found_details(documents: DataFrame, finder: Finder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """personal_details by a finder that was trained before."""
    return judged(voted(documents, finder.gazetteer, key, text), finder, key)


def redact(documents: DataFrame, finder: Finder, text: str = "text") -> DataFrame:
    """documents with every detail in `text` replaced by a placeholder; other columns as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(finder)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value.gazetteer)
        for texts in batches:
            yield texts.map(lambda t: shared.value.redacted(t, reader))

    return documents.withColumn(text, clean(F.col(text)))
