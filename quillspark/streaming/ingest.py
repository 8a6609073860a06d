"""Incremental ingestion with Structured Streaming.

Messages are read from a folder of JSON lines (at least once); every sink replaces what a document wrote before,
so a message processed twice leaves the same tables. A failed message goes to a dead-letter table with its reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import hash_embedding
from ..operators.chunking import section_chunks
from ..operators.analysis import heuristic_analysis

MESSAGE = "job_id string, job_type string, paper_id string, document_id string, filename string, content string, title string"
JOB_TYPES = ("CORPUS_FULL_TEXT_INGESTION", "PAPER_PROCESSING")


def messages(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream of job messages; lines that are no JSON become rows without a job type."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path)
    arrived = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"), F.sha2("value", 256).alias("digest"))
    return raw.select(F.from_json("value", MESSAGE).alias("m"), "value", arrived.alias("arrived")).select("m.*", F.col("value").alias("raw"), "arrived")


def last_of(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key that arrived last (time and path of its file, then its digest: a total order)."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.col("arrived")).alias("_row")).select("_row.*")


def triage(batch: DataFrame) -> DataFrame:
    """Adds reason: why a message cannot be processed, null if it can."""
    text = tx.normalize_text(F.col("content"))
    reason = (
        F.when(F.col("job_type").isNull() | F.col("document_id").isNull(), "unreadable message")
        .when(~F.col("job_type").isin(*JOB_TYPES), "unknown job type")
        .when(F.length(F.trim(text)) == 0, "no text")
    )
    return batch.withColumn("reason", reason).withColumn("content", text)


def derive(good: DataFrame) -> dict[str, DataFrame]:
    """documents, chunks and analyses of the messages of one batch; the last message of a document counts."""
    last = last_of(good, "document_id")
    docs = last.select(
        F.col("document_id").alias("id"), "paper_id", "filename", "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"),
        F.coalesce(F.nullif("title", F.lit("")), tx.first_title(F.col("content"), F.coalesce("filename", F.lit("")))).alias("title"), tx.first_authors(F.col("content")).alias("authors"), tx.first_venue(F.col("content")).alias("venue"), "arrived",
    )
    chunks = section_chunks(docs.withColumnRenamed("id", "document_id"), ["document_id"], "content").withColumn("embedding", hash_embedding("text"))
    by_paper = last_of(docs.where("paper_id is not null"), "paper_id")
    analyses = heuristic_analysis(by_paper.select("paper_id", "title", "content"), "title", "content").drop("content", "title")
    return {"documents": docs.drop("arrived"), "document_chunks": chunks, "paper_analyses": analyses}


def replace_rows(df: DataFrame, path: str, key: str) -> None:
    """Replace the rows of the keys in ``df``: rows lie in folders by a hash of the key, and only touched folders are rewritten."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    new = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(32)).cast("int")).persist()
    if exists:
        touched = new.select("bucket").distinct()
        old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(touched), "bucket", "left_semi").join(new.select(key).distinct(), key, "left_anti")  # at most 32 rows
        staged = f"{path}.staged"
        old.unionByName(new).write.mode("overwrite").partitionBy("bucket").parquet(staged)  # read fully before the folders are swapped
        out = spark.read.schema(new.schema).parquet(staged)
    else:
        out = new
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    new.unpersist()


def process_batch(target: str) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function: tables, job states and dead letters under ``target``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        seen = triage(batch).persist()
        good = seen.where("reason is null")
        if not good.isEmpty():
            tables = derive(good)
            replace_rows(tables["documents"], f"{target}/documents", "id")
            replace_rows(tables["document_chunks"], f"{target}/document_chunks", "document_id")
            replace_rows(tables["paper_analyses"], f"{target}/paper_analyses", "paper_id")
        status = seen.select(F.coalesce("job_id", F.sha2("raw", 256)).alias("id"), F.when(F.col("reason").isNull(), "COMPLETED").otherwise("FAILED").alias("status"), F.when(F.col("reason").isNull(), 100).otherwise(0).alias("progress"), F.substring("reason", 1, 500).alias("error"), F.lit(batch_id).alias("batch"), "arrived")
        replace_rows(last_of(status, "id").drop("arrived"), f"{target}/background_jobs", "id")
        bad = seen.where("reason is not null").select(F.sha2("raw", 256).alias("id"), "raw", "reason")
        if not bad.isEmpty():
            replace_rows(bad.dropDuplicates(["id"]), f"{target}/dead_letters", "id")
        seen.unpersist()

    return run


def ingest(spark: SparkSession, inbox: str, target: str, checkpoint: str, per_trigger: int = 100):
    """Process everything that lies in the inbox, then stop; run it again for what has arrived since."""
    return messages(spark, inbox, per_trigger).writeStream.foreachBatch(process_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

