"""Evaluation texts that leak into training text.

A distributed positional inverted index over the training corpus. Every document is tokenised once: the
postings (term, document, position) of the terms that the test items use are stored in the shared folder,
each with the term that follows. All later steps read them. Adjacent pairs of item terms are counted over
all documents; every window of ``least`` consecutive item words is anchored at its rarest pair, so every
possible leak holds an anchor. The postings that meet an anchor give alignments (document, item, offset);
for these alone the items' lists, shifted by the offset, are intersected with the postings of the document,
and a run of ``least`` consecutive positions is a leak.

``proximity`` also finds passages with words put in, left out or replaced: it anchors windows of ``core``
words, intersects the lists around each alignment's offset and chains runs of three words or more with at
most ``gap`` other words between them, in document and item.

No step knows a cap. Defined results: null, empty and short texts leak nothing; an item with fewer than
``least`` words cannot leak; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread, stored

LEAST_WORDS = 12
CORE_WORDS, GAP_WORDS, RUN_WORDS = 6, 3, 3  # of proximity matches
SENT_ROWS = 200_000  # tables of items with more rows than this are shuffled instead of broadcast


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case; marks belong to the letter before them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), F.lit(0))


def _sent(df: DataFrame) -> DataFrame:
    """To be broadcast if its counted rows allow."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def item_terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, pos, term, next) with numbered terms, and the vocabulary (word, term); both stored."""
    words = stored(items.select("item_id", "text").where("text is not null").distinct().select("item_id", F.posexplode(words_of(F.col("text"))).alias("pos", "word")))
    vocabulary = stored(words.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    terms = words.join(vocabulary, "word").select("item_id", "pos", "term")
    after = Window.partitionBy("item_id").orderBy("pos")  # one item's words
    return stored(terms.withColumn("next", F.lead("term").over(after))), vocabulary


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, pos, term, next of every document word that some item uses; stored. The only pass over the texts."""
    w = words_of(F.col("text"))
    pairs = docs.select("doc_id", w.alias("w")).select("doc_id", F.posexplode(F.arrays_zip(F.col("w").alias("word"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("after"))).alias("pos", "p"))
    flat = pairs.select("doc_id", "pos", F.col("p.word").alias("word"), F.col("p.after").alias("after"))
    known = _sent(vocabulary)
    return stored(flat.join(known, "word").join(known.select(F.col("word").alias("after"), F.col("term").alias("next")), "after", "left").select("doc_id", "pos", "term", "next"))


def anchors(terms: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """item_id, pos, term, next: the rarest adjacent pair of each window of ``least`` words, the first among equals; stored."""
    pairs = terms.where("next is not null").select("item_id", "pos", "term", "next")
    seen = index.where("next is not null").groupBy("term", "next").agg(F.count("*").alias("n"))
    w = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, least - 2)
    ranked = pairs.join(seen, ["term", "next"], "left").withColumn("rank", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("pos")))
    best = ranked.select("item_id", F.min("rank").over(w).alias("best"), F.count("*").over(w).alias("room")).where(F.col("room") == least - 1).where("best.n > 0")  # a pair no document holds rules its windows out
    return stored(best.select("item_id", F.col("best.pos").alias("pos")).distinct().join(pairs, ["item_id", "pos"]))


def alignments(index: DataFrame, at: DataFrame) -> DataFrame:
    """doc_id, item_id, offset at which an anchor stands in a document; stored."""
    return stored(index.join(_sent(at.select("item_id", "term", "next", F.col("pos").alias("item_pos"))), ["term", "next"]).select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("offset")).distinct())


def runs(index: DataFrame, terms: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, item_id, offset, item_start, words: the runs of positions at which the shifted lists meet."""
    due = hits.join(_sent(terms.select("item_id", F.col("pos").alias("item_pos"), "term")), "item_id").withColumn("pos", F.col("item_pos") + F.col("offset"))
    own = index.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "pos", "term")
    met = due.join(own, ["doc_id", "pos", "term"]).select("doc_id", "item_id", "offset", "item_pos").distinct()  # repeated rows of a document
    place = Window.partitionBy("doc_id", "item_id", "offset").orderBy("item_pos")  # at most the words of one item
    return met.withColumn("island", F.col("item_pos") - F.row_number().over(place)).groupBy("doc_id", "item_id", "offset", "island").agg(F.min("item_pos").alias("item_start"), F.count("*").alias("words")).drop("island")


def _indexed(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    terms, vocabulary = item_terms(items)
    return postings(spread(docs.select("doc_id", "text").where("text is not null")), vocabulary), terms


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, item_id, start_word, words: the longest exact run of item words in the document, the first among equals."""
    index, terms = _indexed(docs, items)
    long = runs(index, terms, alignments(index, anchors(terms, index, least))).where(F.col("words") >= least)
    best = long.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("words"), (-(F.col("item_start") + F.col("offset"))).alias("at"))).alias("r"))
    return best.select("doc_id", "item_id", (-F.col("r.at")).cast("long").alias("start_word"), F.col("r.words").cast("long").alias("words"))


def proximity(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS, core: int = CORE_WORDS, gap: int = GAP_WORDS) -> DataFrame:
    """doc_id, item_id, start_word, end_word (exclusive), words: the passage with most agreeing words, at least ``least``.

    The agreeing words stand in runs of three or more (``RUN_WORDS``), at least one of ``core``, with at most ``gap``
    other words between two runs, in the document and in the item.
    """
    index, terms = _indexed(docs, items)
    hits = alignments(index, anchors(terms, index, core))
    # Words put in or left out move the offset: the lists are intersected at all offsets near a hit.
    reach = (least // RUN_WORDS) * gap
    around = hits.withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).select("doc_id", "item_id", (F.col("offset") + F.col("d")).alias("offset")).distinct()
    found = runs(index, terms, around).where(F.col("words") >= RUN_WORDS).withColumn("doc_start", F.col("item_start") + F.col("offset"))
    # A run within a longer one at another offset (repeated words) does not break a chain.
    place = Window.partitionBy("doc_id", "item_id").orderBy("doc_start", F.col("words").desc(), "item_start")  # runs of one item in one document
    doc_end, item_end = F.col("doc_start") + F.col("words"), F.col("item_start") + F.col("words")
    covered = F.coalesce(F.max(F.struct(doc_end.alias("e"))).over(place.rowsBetween(Window.unboundedPreceding, -1))["e"] >= doc_end, F.lit(False))
    free = found.withColumn("covered", covered).where(~F.col("covered")).drop("covered")
    before = lambda c: F.lag(c).over(place)
    to_doc, to_item = F.col("doc_start") - before(doc_end), F.col("item_start") - before(item_end)
    new = F.when(to_doc.between(-RUN_WORDS, gap) & to_item.between(-RUN_WORDS, gap), 0).otherwise(1)
    chained = free.withColumn("new", new).withColumn("over", F.when(F.col("new") == 0, F.greatest(F.lit(0), -to_doc, -to_item)).otherwise(0)).withColumn("chain", F.sum("new").over(place))
    chains = chained.groupBy("doc_id", "item_id", "chain").agg(F.sum(F.col("words") - F.col("over")).alias("words"), F.max("words").alias("longest"), F.min("doc_start").alias("start"), F.max(doc_end).alias("end")).where((F.col("words") >= least) & (F.col("longest") >= core))
    best = chains.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", (-F.col("start")).alias("at"), "end")).alias("r"))
    return best.select("doc_id", "item_id", (-F.col("r.at")).cast("long").alias("start_word"), F.col("r.end").cast("long").alias("end_word"), F.col("r.words").cast("long").alias("words"))
