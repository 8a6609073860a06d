"""Word windows and section-aware chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocabulary as V

WINDOW_WORDS = 220


def word_windows(df: DataFrame, keys: list[str], text: str, size: int = WINDOW_WORDS) -> DataFrame:
    """keys, chunk_index, text: windows of ``size`` words; texts without a word give none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    w = df.select(*keys, words.alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.size("_w"), F.lit(size))
    return w.select(*keys, "_w", F.posexplode(starts).alias("chunk_index", "_s")).select(*keys, "chunk_index", F.array_join(F.slice("_w", F.col("_s"), size), " ").alias("text"))


def section_chunks(pages: DataFrame, keys: list[str], text: str, page: str | None = None, size: int = WINDOW_WORDS) -> DataFrame:
    """keys, section, chunk_index (from 0 over the text), text.

    The text is parted before heading lines; a short first line names the section and leaves the body.
    """
    norm = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"))
    parts = F.split(norm, rf"(?im)\n\s*(?=(?:{V.HEADINGS})\s*(?:\n|$))")
    s = pages.select(*keys, F.posexplode(parts).alias("_part", "_raw"))
    paras = F.filter(F.transform(F.split("_raw", r"\n"), lambda p: F.trim(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))), lambda p: p != "")
    s = s.withColumn("_p", paras).where(F.size("_p") > 0)
    first = F.element_at("_p", 1)
    named = F.size(F.filter(F.split(first, r"(?U)\s+"), lambda w: w != "")) <= 12
    raw = F.when(named, F.trim(F.substring(first, 1, 100))).otherwise("Body")
    s = s.withColumn("section", tx.title_case(raw)).withColumn("section", F.when(F.col("section").rlike(r"(?i)^P\s*A\s*G\s*E\s*\|?\s*\d+$"), "Body").otherwise(F.col("section")))
    s = s.withColumn("_body", F.array_join(F.when(F.col("section") != "Body", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0)))).otherwise(F.col("_p")), " "))
    w = word_windows(s, [*keys, "_part", "section"], "_body", size).withColumnRenamed("chunk_index", "_window")
    grouped = w.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_part", "_window", "section", "text"))).alias("_c"))  # the chunks of one text
    return grouped.select(*keys, F.posexplode("_c").alias("chunk_index", "_x")).select(*keys, "_x.section", "chunk_index", "_x.text")
