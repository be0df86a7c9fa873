"""BM25 over an inverted index, or straight from token arrays for one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import BM25_B, BM25_K1
from trackloom.functions.text import tokens_of


def postings(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, term, tf); counted map-side, so a frequent term is not gathered anywhere."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, df) over the whole corpus."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def document_lengths(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, dl); a document without tokens counts, with 0."""
    return docs.select(key, F.size(tokens).alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avgdl); an empty corpus has avgdl 1."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def _occurrences(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def idf(n: Column, df: Column) -> Column:
    """1 + ln((n - df + 0.5) / (df + 0.5)); negative for very frequent terms."""
    return 1.0 + F.log((n - df + 0.5) / (df + 0.5))


def term_weight(idf_: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf_ * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * (dl / avgdl)))


def bm25_scores(docs: DataFrame, key: str, tokens: str, query: str, candidates: DataFrame | None = None) -> DataFrame:
    """(key, bm25) of all documents, or of the candidates (a df with the key), 0 where no query term occurs.

    A repeated query token counts repeatedly. One pass counts the corpus (n, lengths and each term's df: one row); the scores
    are then column arithmetic over the token arrays, so nothing is shuffled but the candidates' join.
    """
    asked = tokens_of(query)
    terms = list(dict.fromkeys(asked))
    tf = {t: _occurrences(tokens, t) for t in terms}
    stats = docs.agg(
        F.count("*").alias("n"), F.coalesce(F.avg(F.size(tokens)), F.lit(1.0)).alias("avgdl"),
        *[F.count_if(F.array_contains(tokens, t)).alias(f"df{i}") for i, t in enumerate(terms)],
    ).first()
    scoped = docs.select(key, tokens)
    if candidates is not None:
        scoped = scoped.join(candidates.select(key), key, "left_semi")
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        if stats[f"df{i}"]:
            weight = term_weight(idf(F.lit(float(stats["n"])), F.lit(float(stats[f"df{i}"]))), tf[t], F.size(tokens), F.lit(float(stats["avgdl"] or 1.0)))
            score = score + asked.count(t) * weight
    return scoped.select(key, score.alias("bm25"))


def bm25_from_index(index: DataFrame, lengths: DataFrame, key: str, query: str) -> DataFrame:
    """(key, bm25) of the documents that hold a query term, from a stored index."""
    spark, asked = index.sparkSession, tokens_of(query)
    wanted = spark.createDataFrame([(t, asked.count(t)) for t in dict.fromkeys(asked)], "term string, times int")
    hits = index.join(F.broadcast(wanted), "term")  # one row per query term
    frequency = F.broadcast(document_frequency(hits.select(key, "term")))
    scored = hits.join(frequency, "term").join(lengths, key).crossJoin(F.broadcast(corpus_stats(lengths)))  # one row
    weight = F.col("times") * term_weight(idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return scored.groupBy(key).agg(F.sum(weight).alias("bm25"))


def bm25_stored(index: DataFrame, frequencies: DataFrame, corpus: tuple[int, float], docs: DataFrame, key: str, query: str) -> DataFrame:
    """(key, bm25) of those of docs (key, dl) that hold a query term, from stored postings (term, key, tf) sorted by term: the terms
    reach the scan as a filter, so only their row groups are read. corpus: documents and their mean length."""
    asked = tokens_of(query)
    terms = list(dict.fromkeys(asked))
    known = {r["term"]: r["df"] for r in frequencies.filter(F.col("term").isin(terms)).collect()}  # one row per query term
    n, mean = corpus
    score = F.lit(0.0)
    for t, df in known.items():
        score = F.when(F.col("term") == t, asked.count(t) * term_weight(idf(F.lit(float(n)), F.lit(float(df))), F.col("tf"), F.col("dl"), F.lit(float(mean or 1.0)))).otherwise(score)
    return index.filter(F.col("term").isin(terms)).join(docs, key).groupBy(key).agg(F.sum(score).alias("bm25"))


def max_normalized(scores: DataFrame, score: str = "bm25") -> DataFrame:
    """score over the largest of all rows; a largest of 0 counts as 1. A negative largest turns signs round, as division does."""
    top = scores.agg(F.max(score).alias("_max"))
    return scores.crossJoin(F.broadcast(top)).withColumn(score, F.col(score) / F.when(F.col("_max") == 0, 1.0).otherwise(F.col("_max"))).drop("_max")  # one row


def ranked(scores: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best with their rank from 1; scores that agree to nine places tie, and ties go to the smaller key, so that the
    order in which terms are summed does not matter. Only k rows reach the window."""
    order = [F.round(score, 9).desc(), F.asc(key)]
    best = scores.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
