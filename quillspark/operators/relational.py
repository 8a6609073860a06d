"""Relational glue: visibility, de-duplication, upserts, cascades, conditional inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import falsy_chain


def visible_to(papers: DataFrame, user: Column, owner: str = "owner_id") -> DataFrame:
    return papers.where(F.col(owner).isNull() | (F.col(owner) == user))


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in a total order; a window group limit keeps one row per task and key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def keep_most_cited(df: DataFrame, *order: str) -> DataFrame:
    """One row per identifier or title: the most cited, the first of equals."""
    keyed = df.withColumn("key", F.lower(F.trim(falsy_chain(F.col("doi"), F.col("title"))))).where("key <> ''")
    w = Window.partitionBy("key").orderBy(F.coalesce("citation_count", F.lit(0)).desc(), *order)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``base`` with ``columns`` overwritten where ``updates`` has the key, and the new keys added. One row per key in updates."""
    u = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = base.join(u, base[key] == u["_key"], "full_outer")
    rest = [c for c in base.columns if c != key and c not in columns]
    is_new = F.col(key).isNull()
    return j.select(F.coalesce(key, "_key").alias(key), *rest, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], is_new.alias("inserted"))


def replace_by(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` replaced: running it again changes nothing."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_unless(base: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose ``on`` values are not in ``base`` yet."""
    return rows.join(base.select(*on).distinct(), on, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], root: str, doomed: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables without the doomed root keys and without what hangs from them.

    links: (child table, its foreign key, parent table, the parent's key), parents first; ``doomed`` has the root's key.
    """
    gone = {root: doomed}
    out = dict(tables)
    key = doomed.columns[0]
    out[root] = tables[root].join(doomed, key, "left_anti")
    for child, fk, parent, pk in links:
        lost = gone[parent].select(F.col(gone[parent].columns[0]).alias(fk)).distinct()
        gone[child] = tables[child].join(lost, fk, "left_semi").select("id") if "id" in tables[child].columns else tables[child].join(lost, fk, "left_semi")
        out[child] = tables[child].join(lost, fk, "left_anti")
    return out


def uploads_to_register(files: DataFrame, papers: DataFrame) -> DataFrame:
    """files (owner_id, content) not yet known: external_id is the first 16 hex digits of the content's SHA-256."""
    f = files.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256)).withColumn("external_id", F.substring("content_hash", 1, 16))
    return insert_unless(papers, f.dropDuplicates(["external_id", "owner_id"]), ["external_id", "owner_id"])


def persist_results(results: DataFrame, papers: DataFrame) -> DataFrame:
    """external_id, paper_id, inserted, evidence_state, citation_count: what a list of search results leaves in the store.

    results: seq (a total order), id, doi, title, pdf_url, citation_count. A result is the stored paper with its id,
    else the newest one with its external id (identifier, else id, else title), else a new paper whose state depends on
    whether it has a file. Of several results for one paper the last sets the citations, the first the state.
    """
    r = results.withColumn("external_id", falsy_chain(F.col("doi"), F.col("id"), F.col("title")))
    known = papers.select(F.col("id").alias("by_id"), F.col("evidence_state").alias("id_state"))
    newest = papers.where("external_id is not null").groupBy("external_id").agg(F.max_by(F.struct("id", "evidence_state"), F.struct("created_at", "id")).alias("newest"))
    j = r.join(known, r["id"] == known["by_id"], "left").join(newest, "external_id", "left")
    j = j.withColumn("paper_id", F.coalesce("by_id", "newest.id"))
    initial = F.when(F.length(F.coalesce("pdf_url", F.lit(""))) > 0, "processing").otherwise("metadata-only")
    state = F.when(F.col("by_id").isNotNull(), F.col("id_state")).when(F.col("newest").isNotNull(), F.col("newest.evidence_state")).otherwise(initial)
    j = j.withColumn("target", F.coalesce("paper_id", F.concat(F.lit("new:"), "external_id"))).withColumn("state", state)
    out = j.where("target is not null").groupBy("target").agg(F.max_by("external_id", "seq").alias("external_id"), F.first("paper_id").alias("paper_id"), F.min_by("state", "seq").alias("evidence_state"), F.max_by(F.coalesce("citation_count", F.lit(0)), F.col("seq")).alias("citation_count"))
    return out.select("external_id", "paper_id", F.col("paper_id").isNull().alias("inserted"), "evidence_state", "citation_count")
