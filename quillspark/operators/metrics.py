"""Ranking quality, latency and library measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query_metrics(ranked: DataFrame, query: str, relevant: str, expected: str) -> DataFrame:
    """ranked (query, rank from 1, relevant 0/1, expected = number of relevant items) -> measures of each query."""
    r, rel = F.col("rank"), F.col(relevant)
    gain = lambda k: F.sum(F.when(r <= k, rel / F.log2(r + 1)).otherwise(0.0))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.first(expected), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    hit = lambda k: F.max(F.when(r <= k, rel).otherwise(0)).cast("double")
    n = F.first(expected)
    return ranked.groupBy(query).agg(
        hit(1).alias("hit_1"), hit(3).alias("hit_3"), hit(5).alias("hit_5"), hit(10).alias("hit_10"),
        F.coalesce(1.0 / F.min(F.when(rel == 1, r)), F.lit(0.0)).alias("rr"),
        F.when(n == 0, 1.0).otherwise(gain(5) / ideal(5)).alias("ndcg_5"),
        F.when(n == 0, 1.0).otherwise(gain(10) / ideal(10)).alias("ndcg_10"),
        (F.sum(F.when(r <= 5, rel).otherwise(0)) / F.count_if(r <= 5)).alias("precision_5"),
        F.coalesce(F.try_divide(F.sum(F.when(r <= 5, rel).otherwise(0)).cast("double"), n.cast("double")), F.lit(0.0)).alias("recall_5"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    cols = ["hit_1", "hit_3", "hit_5", "hit_10", "rr", "ndcg_5", "ndcg_10", "precision_5", "recall_5"]
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in cols])


def golden_metrics(per_query: DataFrame) -> DataFrame:
    """The fourteen means of a golden set.

    per_query: answerable, supported, coverage (share of the expected facts in the evidence) and the columns of
    ``per_query_metrics`` (null for questions without an answer). Unsupported questions cover no fact. Rates with an
    empty denominator have their defined values: 0 for support, 1 for abstention.
    """
    a, s = F.col("answerable"), F.col("supported")
    cols = ["hit_1", "hit_3", "hit_5", "hit_10", "rr", "ndcg_5", "ndcg_10", "precision_5", "recall_5"]
    share = lambda n, d, empty: F.round(F.coalesce(F.try_divide(F.count_if(n), F.count_if(d)), F.lit(empty)), 6)
    return per_query.agg(
        F.count("*").alias("queries"), *[F.round(F.avg(F.when(a, F.col(c))), 6).alias(c) for c in cols],
        share(a & s, a, 0.0).alias("answerable_support"), F.round(F.avg(F.when(a, F.when(s, F.col("coverage")).otherwise(0.0))), 6).alias("fact_coverage"),
        share(~a & s, ~a, 0.0).alias("unanswerable_support"), share(~a & ~s, ~s, 1.0).alias("abstention_precision"), share(~a & ~s, ~a, 1.0).alias("abstention_recall"),
    )


def latency_summary(df: DataFrame, key: str, value: str, parts: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentile p is the value at place floor(p * (n - 1)) of the sorted values, without interpolation.

    Places come from counts of distinct values, so no key's values are gathered in one task.
    """
    from pyspark.sql import Window

    v = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy("v")
    run = v.withColumn("upto", F.sum("c").over(w))
    n = v.groupBy(key).agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    j = run.join(n, key)
    places = [F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col("v"))).alias(f"p{int(p * 100)}") for p in parts]
    return j.groupBy(key).agg(F.first("n").alias("n"), F.first("least").alias("least"), F.first("most").alias("most"), *places)


def library_metrics(papers: DataFrame) -> DataFrame:
    full = F.coalesce(F.col("evidence_state") == "full-text", F.lit(False))
    total = F.count("*")
    return papers.agg(total.alias("total"), F.count_if(full).alias("full_text"), F.coalesce(F.sum("citation_count"), F.lit(0)).alias("citations"), F.coalesce(F.round(F.try_divide(F.count_if(full) * 100.0, total)), F.lit(0.0)).cast("int").alias("percent"))
