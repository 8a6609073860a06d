"""Query of problem 2: one row per author named in a packed field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import split_packed
from ..session import load, spread


def author_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = load(spark, sf_dir, "papers").select(F.lit("papers").alias("tbl"), F.col("id").alias("record_key"), "authors", "source")
    inputs = load(spark, sf_dir, "paper_inputs").select(F.lit("paper_inputs").alias("tbl"), F.col("input_id").alias("record_key"), "authors", F.col("client").alias("source"))
    rows = papers.unionByName(inputs).where(F.length(F.trim("authors")) > 0).distinct()
    return split_packed(rows, ["tbl", "record_key"], "authors", "source")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, record_key, pos (from 1), author. Rows that repeat whole count once."""
    return author_rows(spark, sf_dir).withColumnRenamed("piece", "author").distinct()


QUERIES = {"p2_found": p2_found}
