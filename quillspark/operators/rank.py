"""Keyword scoring, federated merge, hybrid retrieval and deterministic top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import dot
from . import retrieval


def topk(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Global top-k in a total order (TakeOrderedAndProject: k rows per task reach the driver's merge)."""
    return df.orderBy(*order).limit(k)


def topk_per(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """Top-k per key with its rank; the rank filter is pushed below the shuffle as a window group limit."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def corpus_topk(docs: DataFrame, topic: str, title: str, body: list[str], date: str, key: str, k: int = 10) -> DataFrame:
    """Keyword-scored corpus scan: 3 for a topic word in the title, 1 elsewhere; words match as substrings."""
    hay = F.concat_ws(" ", F.coalesce(title, F.lit("")), *[F.coalesce(c, F.lit("")) for c in body])
    score = tx.overlap_score(tx.words(F.lit(topic)), F.coalesce(title, F.lit("")), hay, 3, 1)
    return topk(docs.withColumn("score", score).where("score > 0"), k, F.col("score").desc(), F.coalesce(F.col(date).cast("string"), F.lit("")).desc(), F.col(key))


def full_text_scored(papers: DataFrame, topic: str) -> DataFrame:
    """Public full-text papers with a topic word: 5 in the title, 2 in the abstract, and 100 for the full text."""
    words = tx.words(F.lit(topic))
    base = papers.where("evidence_state = 'full-text' and owner_id is null")
    score = tx.overlap_score(words, F.coalesce("title", F.lit("")), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))), 5, 2)
    return base.withColumn("word_score", score).where((F.col("word_score") > 0) | (F.size(words) == 0)).withColumn("score", F.col("word_score") + 100).drop("word_score")


def merge_ranked(lists: DataFrame, topic: str) -> DataFrame:
    """One row per key (identifier, else title) out of several ranked lists; ``seq`` is the place in their concatenation.

    Full text beats the rest and the first full text stays; among the others the most cited wins, the first of equals.
    The result keeps the key's first place, so ties sort by first appearance.
    """
    words = tx.words(F.lit(topic))
    key = F.lower(F.trim(tx.falsy_chain(F.col("doi"), F.col("title"))))
    full = F.coalesce(F.col("evidence_state") == "full-text", F.lit(False))
    base = tx.overlap_score(words, F.coalesce("title", F.lit("")), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))), 3, 1) + F.when(full, 100).otherwise(0)
    rows = lists.withColumn("key", key).where("key <> ''").withColumn("is_full", F.when(full, 1).otherwise(0)).withColumn("total", F.greatest(F.coalesce("score", F.lit(0)), base)).withColumn("cites", F.coalesce("citation_count", F.lit(0)))
    # An aggregate with map-side combine instead of a window: a hot key never meets in one task.
    order = F.struct(F.col("is_full"), F.when(F.col("is_full") == 1, 0).otherwise(F.col("cites")).alias("c"), (-F.col("seq")).alias("first"))
    best = rows.groupBy("key").agg(F.max_by(F.struct("id", "is_full", "total", "cites", "origin"), order).alias("w"), F.min("seq").alias("first_seq"))
    return best.select("key", "w.*", "first_seq")


def federated_topk(lists: DataFrame, topic: str, k: int = 10, full_text_only: bool = False) -> DataFrame:
    merged = merge_ranked(lists, topic)
    if full_text_only:
        merged = merged.where("is_full = 1")
    return topk(merged, k, F.col("is_full").desc(), F.col("total").desc(), F.col("cites").desc(), F.col("first_seq"))


@dataclass(frozen=True)
class Weights:
    dense: float = 0.55
    lexical: float = 0.45
    section: float = 0.65
    background: float = 0.65
    overlap: float = 0.12


def hybrid_score(pairs: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """pairs (question, question_vector, text, section, embedding) -> kind, hybrid_score.

    Words and types that were computed before the two sides met are used: columns q_words, t_words, kind.
    """
    q, t = F.col("_q"), F.col("_t")
    kind = F.col("kind")
    have = set(pairs.columns)
    df = pairs.withColumn("_q", F.col("q_words") if "q_words" in have else tx.content_words(F.col("question"))).withColumn("_t", F.col("t_words") if "t_words" in have else tx.content_words(F.col("text")))
    df = df if "kind" in have else df.withColumn("kind", retrieval.classify(F.col("question")))
    shared = F.size(F.array_intersect(q, t))
    lexical = shared / F.greatest(F.size(q), F.lit(1))
    from ..functions import vocabulary as V

    first = tx.label_hit(F.col("section"), kind, V.PRIMARY_SECTIONS)
    second = tx.label_hit(F.col("section"), kind, V.SECONDARY_SECTIONS)
    low = F.lower(F.coalesce("section", F.lit("")))
    boost = F.when(first, weights.section).when(second, weights.section * 0.4).otherwise(0.0) - F.when(~kind.isin("general", "metadata") & tx.any_contains(low, V.BACKGROUND_SECTIONS), weights.background).otherwise(0.0)
    return df.withColumn("hybrid_score", weights.dense * dot(F.col("question_vector"), F.col("embedding")) + weights.lexical * lexical + boost + weights.overlap * shared).drop("_q", "_t")


def hybrid_retrieve(pairs: DataFrame, query_keys: list[str], k: int = 6, weights: Weights = Weights(), ties: list[str] | None = None) -> DataFrame:
    """Top-k chunks of each query; equal scores keep the chunk order."""
    return topk_per(hybrid_score(pairs, weights), query_keys, k, F.col("hybrid_score").desc(), *[F.col(c) for c in (ties or ["chunk_index"])])


def rerank(ranked: DataFrame, k: int = 6) -> DataFrame:
    """The fallback of the cross-encoder: the first k stay as they are."""
    return ranked.where(F.col("rank") <= k).withColumn("reranker", F.lit("hybrid-fallback"))
