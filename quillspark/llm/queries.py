"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import split_packed
from ..session import load, stored
from . import bpe, leakage, matching, names, scans, sentences, survivors, truncation, vectors


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = load(spark, sf_dir, "papers").select(F.lit("papers").alias("tbl"), F.col("id").alias("record_key"), "source", F.col("abstract").alias("text"))
    inputs = load(spark, sf_dir, "paper_inputs").select(F.lit("paper_inputs").alias("tbl"), F.col("input_id").alias("record_key"), F.col("client").alias("source"), F.col("summary").alias("text"))
    return papers.unionByName(inputs)


def _work_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = load(spark, sf_dir, "papers").select(F.concat(F.lit("p:"), "id").alias("nid"), "title", "authors", F.col("year").cast("string").alias("date"), "doi")
    records = load(spark, sf_dir, "provider_records").select(F.concat(F.lit("r:"), "id").alias("nid"), "title", F.col("authors_raw").alias("authors"), F.col("published_date").alias("date"), "doi")
    return papers.unionByName(records)


LEVELS = (0.5, 0.7, 0.9, 0.95, 0.99)


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, record_id, confidence: of the pair itself, or of the surest path of links between the two (in steps of ``LEVELS``), whichever is higher."""
    nodes, scored, reps, known = matching.works(_work_rows(spark, sf_dir))
    papers = nodes.where("nid like 'p:%'").select(F.expr("substring(nid, 3)").alias("paper_id"), "work", F.col("rep").alias("rep_p"))
    records = nodes.where("nid like 'r:%'").select(F.expr("substring(nid, 3)").alias("record_id"), "work", F.col("rep").alias("rep_r"))
    pairs = stored(papers.join(records, "work").select("paper_id", "record_id", "rep_p", "rep_r", F.least("rep_p", "rep_r").alias("a"), F.greatest("rep_p", "rep_r").alias("b")))
    levels = matching.linked_at(scored, LEVELS)
    side = lambda p: levels.select(F.col("id").alias(p), "level", "comp")
    paths = pairs.select("a", "b").where("a <> b").distinct().join(side("a"), "a").join(side("b"), ["b", "level", "comp"]).groupBy("a", "b").agg(F.max("level").alias("path"))
    equal = reps.select(F.col("rep").alias("a"), known.of_equals().alias("equal"))
    joined = pairs.join(scored, ["a", "b"], "left").join(paths, ["a", "b"], "left").join(equal, "a", "left")
    confidence = F.when(F.col("a") == F.col("b"), F.col("equal")).otherwise(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.coalesce("path", F.lit(0.0))))
    return joined.groupBy("paper_id", "record_id").agg(F.round(F.max(confidence), 6).alias("confidence"))


def p1_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """up_to, pairs, probability, agree: pairs the classifier was not fitted on, by its calibrated text probability, and how many have equal identifiers."""
    known = matching.works(_work_rows(spark, sf_dir))[3]
    return spark.createDataFrame(known.reliability, "up_to double, pairs long, probability double, agree double")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, record_id of one work."""
    nodes = matching.works(_work_rows(spark, sf_dir))[0]
    papers = nodes.where("nid like 'p:%'").select(F.expr("substring(nid, 3)").alias("paper_id"), "work").distinct()
    records = nodes.where("nid like 'r:%'").select(F.expr("substring(nid, 3)").alias("record_id"), "work").distinct()
    return papers.join(records, "work").select("paper_id", "record_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, record_key of records whose text was cut within a word or a sentence."""
    return truncation.judged(_texts(spark, sf_dir)).where("is_cut").select("tbl", "record_key").distinct()


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table and source (client): records, cut records, share."""
    return truncation.cut_rates(truncation.judged(_texts(spark, sf_dir)))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, group_id (the smallest id) of papers rows whose work has two rows or more."""
    nodes = matching.works(_work_rows(spark, sf_dir))[0]  # records take part, as in p1: rows may meet only through one
    papers = nodes.where("nid like 'p:%'").select(F.expr("substring(nid, 3)").alias("id"), "work").distinct()
    groups = papers.groupBy("work").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return stored(papers.join(groups, "work").select("id", "group_id"))


def _best_rows(spark: SparkSession, sf_dir: str, groups: DataFrame) -> DataFrame:
    papers, inputs = load(spark, sf_dir, "papers"), load(spark, sf_dir, "paper_inputs")
    texts = papers.select(F.lit("papers").alias("tbl"), F.col("id").alias("record_key"), "source", F.col("abstract").alias("text"))
    return survivors.best_rows(groups, papers, inputs, truncation.judged(texts)).select("group_id", "field_name", "record_key").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, field_name, record_key of the row that holds the best value."""
    return _best_rows(spark, sf_dir, _groups(spark, sf_dir))


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One built record per group: the fullest row's title, authors, year and DOI, and the best abstract, venue, state and citation count."""
    groups = _groups(spark, sf_dir)
    best = stored(_best_rows(spark, sf_dir, groups))
    papers = load(spark, sf_dir, "papers").distinct()
    base = survivors.fullest(papers.join(groups, "id"), "group_id", ["title", "authors", "year", "doi"])
    values = best.where("field_name <> 'citation_count'").join(papers.select(F.col("id").alias("record_key"), "abstract", "venue", "evidence_state"), "record_key")
    counts = load(spark, sf_dir, "paper_inputs").where("citation_count > 0").groupBy(F.col("input_id").alias("record_key")).agg(F.max("citation_count").alias("citation_count"))
    pick = lambda c: F.max(F.when(F.col("field_name") == c, F.col(c))).alias(c)
    fields = values.groupBy("group_id").agg(pick("abstract"), pick("venue"), pick("evidence_state"))
    cited = best.where("field_name = 'citation_count'").join(counts, "record_key").select("group_id", "citation_count")
    return base.join(fields, "group_id", "left").join(cited, "group_id", "left")


def _author_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = load(spark, sf_dir, "papers").select("id", "authors", "source").where(F.length(F.trim("authors")) > 0).distinct()
    authors = split_packed(papers, ["id"], "authors", "source").groupBy(F.col("piece").alias("name")).agg(F.count("*").alias("n"))
    return names.person_entities(authors)


def _venue_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    venues = load(spark, sf_dir, "papers").where(F.length(F.trim("venue")) > 0).groupBy(F.col("venue").alias("name")).agg(F.count("*").alias("n"))
    return names.venue_entities(venues)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, name_a, name_b: two spellings of one person or venue."""
    return names.spelling_pairs(_author_entities(spark, sf_dir), "author").unionByName(names.spelling_pairs(_venue_entities(spark, sf_dir), "venue"))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, name, entity, confidence: one row per spelling."""
    columns = lambda kind: [F.lit(kind).alias("kind"), "name", "entity", F.round("confidence", 6).alias("confidence")]
    return _author_entities(spark, sf_dir).select(*columns("author")).unionByName(_venue_entities(spark, sf_dir).select(*columns("venue")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_a < chunk_b, one among the other's 5 most similar by cosine."""
    return vectors.neighbour_pairs(vectors.nearest(load(spark, sf_dir, "document_chunks"), "id", "embedding", 384))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.with_titles(load(spark, sf_dir, "paper_documents"), load(spark, sf_dir, "document_chunks"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, record_key, item_kind, line_no, repaired."""
    return scans.repairs(_scanned(spark, sf_dir)).select("tbl", "record_key", "item_kind", "line_no", "repaired").distinct()


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, record_key, paragraph_no, text: the repaired text as continuous paragraphs."""
    records = stored(_scanned(spark, sf_dir))
    return scans.reflowed(records, scans.repairs(records))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids by byte_bpe_50k."""
    return bpe.encode_corpus(load(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id: at least 12 consecutive item words stand in the document."""
    return leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def p9_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_word, words: the longest exact run of every leak."""
    return leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_word, end_word, words of passages that agree with gaps, exact ones included."""
    return leakage.proximity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_char, end_char of every sentence."""
    return sentences.sentence_spans(load(spark, sf_dir, "documents"), "doc_id", "text").distinct()


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p1_reliability": p1_reliability, "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_survivors": p4_survivors, "p5_found": p5_found, "p5_entities": p5_entities, "p6_found": p6_found, "p7_found": p7_found, "p7_text": p7_text, "p8_ids": p8_ids, "p9_found": p9_found, "p9_matches": p9_matches, "p9_near": p9_near, "p10_found": p10_found}
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*')"
ORACLES: dict[str, str] = {
    "p9_found": f"""with d as (select doc_id, {_WORDS} as w from documents where text is not null), b as (select item_id, {_WORDS} as w from benchmark where text is not null),
 dg as (select doc_id, array_to_string(w[i : i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
 bg as (select distinct item_id, array_to_string(w[i : i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from b))
select distinct doc_id, item_id from dg join bg using (g)""",
    "p9_matches": f"""with d as (select doc_id, {_WORDS} as w from documents where text is not null), b as (select distinct item_id, {_WORDS} as w from benchmark where text is not null),
 dg as (select doc_id, array_to_string(w[i : i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
 bg as (select distinct item_id, array_to_string(w[i : i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from b)),
 hit as (select distinct doc_id, item_id from dg join bg using (g)),
 dw as (select doc_id, unnest(w) as t, unnest(range(0, len(w))) as p from d where doc_id in (select doc_id from hit)),
 bw as (select item_id, unnest(w) as t, unnest(range(0, len(w))) as p from b),
 met as (select hit.doc_id, hit.item_id, dw.p - bw.p as o, bw.p as p from hit join dw using (doc_id) join bw on bw.item_id = hit.item_id and bw.t = dw.t),
 isle as (select *, p - row_number() over (partition by doc_id, item_id, o order by p) as k from met),
 run as (select doc_id, item_id, o + min(p) as start_word, count(*) as words from isle group by doc_id, item_id, o, k)
select doc_id, item_id, cast(start_word as bigint) as start_word, cast(words as bigint) as words from run where words >= 12
 qualify row_number() over (partition by doc_id, item_id order by words desc, start_word) = 1""",
}
