"""Best representative of each duplicate group, field by field.

The rows of one work form a group. For every field the rows are ranked by a window: completeness first,
then trust, then recency, then the key, so the order is total; the top row survives. How far a source is
trusted is learned: the share of its abstracts that are whole. The rank filter is
pushed below the shuffle (a window group limit), so a group of any size keeps one row per task.

Defined results: groups of one row have no survivor; a field that no row of the group holds in full has
none either; null and blank values never survive; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, stored

# The forms of the full-text state and the values that stand for "no abstract" or "no venue".
FULL_TEXT = ("full-text", "private-upload")
NO_ABSTRACT = r"(?i)^\s*(no abstract( available)?|abstract (not|un)available|n/?a|none|null|-+)?\s*\.?\s*$"
NO_VENUE = r"(?i)^\s*(unknown|n/?a|none|null|-+)?\s*$"


def full_text(state: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(state)), r"[\s_]+", "-").isin(*FULL_TEXT)


def top(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group in a total order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_rank = 1").drop("_rank")


SMALL_WORDS = ("of", "on", "in", "and", "the", "for", "to", "de", "et")  # fixed values: never abbreviations
LEAST_USES = 3  # times a word must stand in titles to be a word


def venue_quality(rows: DataFrame) -> DataFrame:
    """id, venue_score: how surely the venue is written in full and spelled right; null if it is not.

    A full form is in title case, without an abbreviation (a short word that no title uses), an ampersand, a
    leading article or a turned order. A spelling is right if each of its words is usual among the full forms of the corpus: at least
    as frequent as any word one letter away would need to be for it to be a slip of that word.
    """
    v = F.trim(F.col("venue"))
    words = F.split(v, r"\s+")
    shaped = rows.where(v.isNotNull() & ~v.rlike(NO_VENUE)).select("id", v.alias("venue"))
    full = shaped.where((F.size(words) >= 3) & ~v.rlike(r"[.&,;:]") & ~v.rlike(r"^(?i:the)\s") & v.rlike(r"^\p{Lu}\p{Ll}") & ~v.rlike(r"(?:^|\s)(?!(?:of|on|in|and|the|for|to|de|et)\b)\p{Ll}\S*") & ~v.rlike(r"\b\p{Lu}{2,}"))
    forms = stored(full.groupBy("venue").agg(F.count("*").alias("n")))
    # A short word is an abbreviation unless the titles of the corpus use it as a word.
    brief = forms.select("venue", F.explode(F.split("venue", r"\s+")).alias("w")).where("length(w) <= 4").select("venue", F.lower("w").alias("w")).where(~F.col("w").isin(*SMALL_WORDS))
    titles = F.col("title") if "title" in rows.columns else F.lit("")
    plain = rows.select(F.explode(F.regexp_extract_all(F.lower(titles), F.lit(r"[\p{L}]+"), F.lit(0))).alias("w")).where("length(w) <= 4").groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_USES)
    forms = stored(forms.join(brief.join(plain, "w", "left_anti").select("venue").distinct(), "venue", "left_anti"))
    # Words are compared within places: the same venue with one word misspelled has all other words in common.
    spots = forms.select("venue", "n", F.posexplode(F.split("venue", r"\s+")).alias("at", "word")).withColumn("rest", F.xxhash64(F.concat_ws(" ", F.slice(F.split("venue", r"\s+"), F.lit(1), F.col("at"))), F.concat_ws(" ", F.expr(r"slice(split(venue, '\\s+'), at + 2, size(split(venue, '\\s+')))"))))
    word_n = spots.groupBy("word").agg(F.sum("n").alias("word_n"))
    spots = spots.join(word_n, "word")
    x, y = spots.alias("x"), spots.alias("y")
    slips = (
        x.join(y, (F.col("x.rest") == F.col("y.rest")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.word") != F.col("y.word")))
        .where((F.levenshtein(F.col("x.word"), F.col("y.word")) <= 2) & (F.col("x.word_n") < F.col("y.word_n")))
        .select(F.col("x.venue").alias("venue"))
        .distinct()
    )
    # A word seen in a single form and near a much more usual word is a slip even where the right form is absent.
    rare = spots.groupBy("word").agg(F.countDistinct("venue").alias("forms"), F.max("word_n").alias("word_n"), F.min("venue").alias("venue")).where((F.col("forms") == 1) & (F.length("word") >= 4))
    # Two words one edit apart share a form with one letter left out, so this is an equi-join.
    shorter = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
    r = rare.select(F.col("word").alias("r_word"), F.col("word_n").alias("r_n"), "venue", F.explode(shorter(F.col("word"))).alias("form"))
    u = word_n.where(F.length("word") >= 4).select(F.col("word").alias("u_word"), F.col("word_n").alias("u_n"), F.explode(shorter(F.col("word"))).alias("form"))
    near = r.join(u, "form").where((F.col("r_word") != F.col("u_word")) & (F.col("u_n") > 3 * F.col("r_n")) & (F.levenshtein("r_word", "u_word") <= 2)).select("venue").distinct()
    right = forms.join(slips, "venue", "left_anti").join(near, "venue", "left_anti")
    return full.join(right, "venue").select("id", F.col("n").alias("venue_score"))


def fullest(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """group and ``fields`` of the row with most filled fields, the latest and then the least id among equals; a field it lacks comes from the next row that has it."""
    filled = sum((F.length(F.trim(F.col(c).cast("string"))) > 0).cast("int") if c != "year" else (F.coalesce(F.col(c), F.lit(0)) != 0).cast("int") for c in fields)
    order = F.struct(F.coalesce(filled, F.lit(0)).alias("n"), F.col("created_at"), F.col("id"))
    has = lambda c: (F.col(c) != 0) if c == "year" else F.length(F.trim(F.col(c))) > 0
    return rows.groupBy(group).agg(*[F.max_by(F.when(has(c), F.col(c)), F.when(has(c), order)).alias(c) for c in fields])


def best_rows(groups: DataFrame, papers: DataFrame, inputs: DataFrame, judged: DataFrame) -> DataFrame:
    """group_id, field_name, record_key.

    ``groups``: id, group_id of papers rows in groups of two or more; ``judged``: record_key, is_cut of papers' abstracts.
    """
    source = F.col("source") if "source" in judged.columns else F.lit(None).cast("string")  # without sources all are trusted alike
    # The verdicts and the venues are stored apart: one plan of all took the driver's memory.
    cuts = stored(judged.where("tbl = 'papers'").select(F.col("record_key").alias("id"), "is_cut", source.alias("source")))
    release(papers.sparkSession)
    venues = stored(venue_quality(papers))
    release(papers.sparkSession)
    trust = cuts.groupBy("source").agg(F.avg((~F.col("is_cut")).cast("double")).alias("trust"))  # a row per source
    cuts = cuts.join(trust, cuts.source.eqNullSafe(trust.source), "left").select("id", "is_cut", "trust")
    # What the ranks need of a text is taken before the joins, so no text is shuffled.
    abstract = F.trim("abstract")
    own = papers.select("id", F.length(abstract).alias("chars"), F.coalesce(~abstract.rlike(NO_ABSTRACT), F.lit(False)).alias("present"), full_text(F.col("evidence_state")).alias("full_text"), "created_at")
    rows = stored(
        own.join(groups, "id")
        .join(cuts, "id", "left")
        .join(venues, "id", "left")
        .select("id", "group_id", "chars", (F.col("present") & ~F.coalesce("is_cut", F.lit(False))).alias("whole"), "venue_score", "full_text", "created_at", "trust")
    )
    recent = (F.col("trust").desc_nulls_last(), F.col("created_at").desc(), F.col("id"))
    abstract = top(rows.where("whole"), "group_id", F.col("chars").desc(), *recent).select("group_id", F.lit("abstract").alias("field_name"), F.col("id").alias("record_key"))
    venue = top(rows.where("venue_score is not null"), "group_id", F.col("venue_score").desc(), *recent).select("group_id", F.lit("venue").alias("field_name"), F.col("id").alias("record_key"))
    state = top(rows.where("full_text"), "group_id", *recent).select("group_id", F.lit("evidence_state").alias("field_name"), F.col("id").alias("record_key"))
    counts = inputs.where("citation_count > 0").select("input_id", "id", "submitted_at", "received_at").join(groups, "id")
    count = top(counts, "group_id", F.col("submitted_at").desc(), F.col("received_at").desc(), F.col("input_id")).select("group_id", F.lit("citation_count").alias("field_name"), F.col("input_id").alias("record_key"))
    return abstract.unionByName(venue).unionByName(state).unionByName(count)
