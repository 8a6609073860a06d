"""Heuristic analysis of a paper and summaries of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocabulary as V
from ..functions.vectors import dot


def _marked(s: Column, words: str) -> Column:
    return s.rlike(rf"(?i)\b({words})\b")


def _cleaned(found: Column, lead: str) -> Column:
    """The first three distinct sentences of more than 25 characters, without their lead-in."""
    plain = F.transform(found, lambda s: tx.collapse(F.regexp_replace(s, rf"(?i)^({lead})\s*", "")))
    return F.slice(F.array_distinct(F.filter(plain, lambda s: F.length(s) > 25)), 1, 3)


def heuristic_analysis(papers: DataFrame, title: str, text: str) -> DataFrame:
    """Adds summary, method_sentences, strengths, weaknesses, domain and confidence.

    Only what the text itself says is returned: where the reference fills a gap with a fixed phrase, the column is
    empty and ``domain`` tells which phrase would apply (in the order of the fixed domain list).
    """
    t = F.coalesce(F.col(title), F.lit(""))
    body = tx.collapse(F.coalesce(F.col(text), F.lit("")))
    body = F.when(body == "", F.concat(F.lit("Academic publication titled: "), t, F.lit("."))).otherwise(body)
    df = papers.withColumn("_body", body).withColumn("_s", tx.sentences(F.col("_body"), 18))
    flags = tx.domain_flags(F.concat_ws(" ", t, F.col("_body")))
    domain = F.lit("general")
    for d in reversed(list(V.DOMAINS)):
        domain = F.when(flags[f"is_{d}"], d).otherwise(domain)
    strong = F.filter("_s", lambda s: _marked(s, V.STRENGTH_WORDS) & ~_marked(s, "however|limitation|bottleneck"))
    weak = F.filter("_s", lambda s: _marked(s, V.LIMIT_WORDS))
    summary = F.when(F.length("_body") > 40, F.when(F.size("_s") > 0, F.array_join(F.slice("_s", 1, 5), " ")).otherwise(F.substring("_body", 1, 500))).otherwise(F.concat(F.lit("Academic study addressing "), t, F.lit(".")))
    return df.select(
        *papers.columns,
        summary.alias("analysis_summary"),
        F.array_join(F.slice(F.filter("_s", lambda s: _marked(s, V.METHOD_WORDS)), 1, 2), " ").alias("method_sentences"),
        _cleaned(strong, "furthermore|moreover|in addition|additionally|also|here,").alias("strengths"),
        _cleaned(weak, r"however\s*,|nonetheless\s*,|nevertheless\s*,|yet\s*,").alias("weaknesses"),
        domain.alias("domain"),
        F.when(F.length("_body") > 300, 0.85).otherwise(0.70).alias("confidence"),
    )


def paper_terms(title: Column, summary: Column) -> Column:
    return tx.collection_words(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))


def shared_terms(papers: DataFrame, group: str, paper: str, title: str, summary: str, k: int = 10) -> DataFrame:
    """group, terms: the longest terms that all papers of a group have (papers without terms are left out)."""
    t = papers.select(group, paper, paper_terms(F.col(title), F.col(summary)).alias("terms")).where(F.size("terms") > 0)
    n = t.groupBy(group).agg(F.countDistinct(paper).alias("papers"))
    per = t.select(group, paper, F.explode("terms").alias("term")).groupBy(group, "term").agg(F.countDistinct(paper).alias("df"))
    common = per.join(n, group).where("df = papers")
    ranked = common.groupBy(group).agg(F.sort_array(F.collect_list(F.struct((-F.length("term")).alias("l"), "term"))).alias("t"))  # terms all papers share: no more than one paper has
    return ranked.select(group, F.transform(F.slice("t", 1, k), lambda x: x["term"]).alias("terms"))


def term_document_frequency(papers: DataFrame, title: str, summary: str) -> DataFrame:
    return papers.select(F.explode(paper_terms(F.col(title), F.col(summary))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def publication_years(papers: DataFrame, year: str) -> DataFrame:
    """year (text), n, percent of the fullest year; null and 0 are left out."""
    per = papers.where(F.col(year) != 0).groupBy(F.col(year).cast("string").alias("year")).agg(F.count("*").alias("n"))
    most = per.agg(F.greatest(F.max("n"), F.lit(1)).alias("most"))
    return per.join(F.broadcast(most)).select("year", "n", F.round(F.col("n") / F.col("most") * 100).cast("int").alias("percent"))  # one row


def similarity_edges(items: DataFrame, group: str, key: str, vector: str, least: float = 0.25) -> DataFrame:
    """group, a < b, weight of the pairs within one request (2 to about 20 items) whose inner product is ``least`` or more."""
    x, y = items.alias("x"), items.alias("y")
    pairs = x.join(y, (F.col(f"x.{group}") == F.col(f"y.{group}")) & (F.col(f"x.{key}") < F.col(f"y.{key}")))
    w = dot(F.col(f"x.{vector}"), F.col(f"y.{vector}"))
    return pairs.select(F.col(f"x.{group}").alias(group), F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b"), w.alias("_w")).where(F.col("_w") >= least).select(group, "a", "b", F.round("_w", 4).alias("weight"))


def is_placeholder(strengths: Column) -> Column:
    """Whether any stored strength is a placeholder phrase."""
    return F.coalesce(F.exists(strengths, lambda s: tx.any_contains(s, V.PLACEHOLDERS)), F.lit(False))


def repair_analyses(stored: DataFrame, papers: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """stored (key, strengths, confidence): placeholder rows are computed anew from the paper, missing ones added, the rest stay."""
    good = stored.where(~is_placeholder(F.col("strengths"))).select(key, "strengths", "confidence", F.lit(False).alias("repaired"))
    rest = papers.join(good.select(key), key, "left_anti")
    new = heuristic_analysis(rest.select(key, title, text), title, text)
    return good.unionByName(new.select(key, "strengths", "confidence", F.lit(True).alias("repaired")))


def titled_edges(edges: DataFrame, nodes: DataFrame, key: str, title: str) -> DataFrame:
    """Edges with the titles of both ends; a missing node leaves its title null."""
    side = lambda c: nodes.select(F.col(key).alias(c), F.col(title).alias(f"{c}_title"))
    return edges.join(side("a"), "a", "left").join(side("b"), "b", "left")
