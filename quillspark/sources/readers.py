"""Sources and sinks: strict CSV, tolerant JSONL, recorded provider responses, binary objects, pages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as tx
from ..operators.relational import keep_first

CSV_COLUMNS = ["id", "title", "category", "category_code", "published_date", "updated_date", "authors", "first_author", "summary", "summary_word_count"]
CORPUS_SCHEMA = "id string, source string, title string, category string, category_code string, published_date string, updated_date string, authors_raw string, first_author string, summary string, summary_word_count int, content_hash string"
PROVIDER_SCHEMA = "id string, title string, summary string, authors_raw string, published_date string, venue string, doi string, citation_count int, url string, pdf_url string, source string, open_access boolean"


def read_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw corpus; the whole job fails on a missing column, an extra cell or a blank required cell.

    The header of one file gives the columns; every other file's header is checked against it.
    """
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [c.lstrip("﻿") for c in header.columns]
    missing = sorted(set(CSV_COLUMNS) - set(names))
    if missing:
        raise ValueError(f"Missing required CSV columns: {', '.join(missing)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)
    blank = F.lit(False)
    for c in CSV_COLUMNS:
        blank = blank | (F.length(F.trim(F.coalesce(c, F.lit("")))) == 0)
    return raw.withColumn("id", F.when(blank, F.raise_error(F.lit("Missing value in a required CSV column"))).otherwise(F.col("id")))


def normalize_corpus(raw: DataFrame) -> DataFrame:
    summary = tx.collapse(F.col("summary"))
    return raw.select(
        F.trim("id").alias("id"), F.lit("arxiv").alias("source"), tx.collapse(F.col("title")).alias("title"), F.trim("category").alias("category"), F.trim("category_code").alias("category_code"),
        tx.parse_mdy(F.col("published_date")).alias("published_date"), tx.parse_mdy(F.col("updated_date")).alias("updated_date"), F.trim("authors").alias("authors_raw"), F.trim("first_author").alias("first_author"),
        summary.alias("summary"), F.size(F.filter(F.split(summary, " "), lambda w: w != "")).alias("summary_word_count"), F.sha2(summary.cast("binary"), 256).alias("content_hash"),
    )


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False, key: str = "id", order: str | None = None) -> tuple[int, int]:
    """Rows written and duplicates skipped. The old output survives a failure: the new one is staged and then renamed."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path
    target = hpath(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    # Without an order the row that stands first in the files stays (by file, then place), however they are split.
    counted = Observation()
    seq = df.observe(counted, F.count(F.lit(1)).alias("rows")).withColumn("_seq", F.col(order) if order else F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("n")))
    staged = f"{path}.staged"
    fs.delete(hpath(staged), True)
    try:
        keep_first(seq, key, "_seq").drop("_seq").write.json(staged)
    except BaseException:
        fs.delete(hpath(staged), True)
        raise
    if fs.exists(target):
        fs.rename(target, hpath(f"{path}.old"))
    fs.rename(hpath(staged), target)
    fs.delete(hpath(f"{path}.old"), True)
    written = spark.read.schema("id string").json(path).count()
    return written, counted.get["rows"] - written


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Malformed lines are skipped; a missing file is empty."""
    try:
        return spark.read.schema(CORPUS_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], CORPUS_SCHEMA)
        raise


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Stored objects with the checks on size and magic number; page counts need a PDF library and are left to the caller.

    Spark lists no files without bytes, so an empty object is a missing one.
    """
    raw = spark.read.format("binaryFile").load(path)
    return raw.withColumn("problem", F.when(F.length("content") == 0, "empty").when(F.length("content") > 25 * 1024 * 1024, "too large").when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "not a PDF"))


def pages_to_text(pages: DataFrame, doc: str = "doc", page: str = "page_no", text: str = "text") -> DataFrame:
    """One normalised text per document, its pages in order, and the page count."""
    p = pages.select(doc, page, F.trim(tx.normalize_text(F.col(text))).alias("t"))
    return p.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page, "t"))), lambda s: s["t"]), "\n").alias("content"), F.count("*").alias("page_count"))


# ---- recorded provider responses ----
OPENALEX_SCHEMA = (
    "id string, title string, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, publication_date string, doi string, cited_by_count int, "
    "primary_location struct<source:struct<display_name:string>>, locations array<struct<is_oa:boolean,landing_page_url:string,pdf_url:string>>, open_access struct<is_oa:boolean>"
)
SEMANTIC_SCHEMA = "paperId string, title string, abstract string, authors array<struct<name:string>>, year int, venue string, externalIds struct<DOI:string>, citationCount int, url string, openAccessPdf struct<url:string>"


class _Recorded(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("limit", "50"))
        self.field = options.get("field", "results")

    def _open(self):
        """The file system of the folder (local, HDFS, S3), and the folder in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self):
        from pyarrow import fs

        store, path = self._open()
        found = [i.path for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".json")]
        return [InputPartition(p) for p in sorted(found)] or [InputPartition("")]

    def read(self, partition):
        if not partition.value:
            return
        with self._open()[0].open_input_file(partition.value) as f:
            text = f.read().decode("utf-8")
        try:
            pages = [json.loads(text)]
        except ValueError:  # a page on each line
            pages = [json.loads(line) for line in text.splitlines() if line.strip()]
        for n, page in enumerate(pages):
            for i, item in enumerate((page.get(self.field) or [])[: self.limit]):
                yield f"{partition.value.rpartition('/')[2]}#{n}" if n else partition.value.rpartition("/")[2], i, json.dumps(item)


class RecordedResponses(DataSource):
    """A folder of recorded response pages, a partition for each file; at most ``limit`` items of a page."""

    @classmethod
    def name(cls) -> str:
        return "recorded_responses"

    def schema(self) -> str:
        return "page string, place int, item string"

    def reader(self, schema):
        return _Recorded(self.options)


def read_recorded(spark: SparkSession, path: str, field: str = "results", limit: int = 50) -> DataFrame:
    spark.dataSource.register(RecordedResponses)
    return spark.read.format("recorded_responses").option("path", path).option("field", field).option("limit", str(limit)).load()


def inverted_index_text(index: Column) -> Column:
    """The text of a word -> positions map: one word per position (the least), in order; empty keys and negative positions drop out."""
    entries = F.filter(F.map_entries(index), lambda e: (e["key"] != "") & e["value"].isNotNull())
    spots = F.flatten(F.transform(entries, lambda e: F.transform(F.filter(e["value"], lambda p: p >= 0), lambda p: F.struct(p.alias("p"), F.trim(e["key"]).alias("w")))))
    ordered = F.array_sort(spots)
    # Each array is evaluated once; a place keeps its first word.
    before = F.concat(F.array(F.lit(None).cast("struct<p:int,w:string>")), ordered)
    firsts = F.zip_with(ordered, F.slice(before, 1, F.size(ordered)), lambda s, b: F.when(b.isNull() | (b["p"] != s["p"]), s["w"]))
    return F.coalesce(F.array_join(firsts, " "), F.lit(""))


def from_openalex(items: DataFrame) -> DataFrame:
    best = F.coalesce(F.get(F.filter("locations", lambda l: l["is_oa"]), F.lit(0)), F.get("locations", F.lit(0)))
    names = F.array_join(F.transform("authorships", lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), ", ")
    return items.select(
        F.element_at(F.split(F.coalesce("id", F.lit("")), "/"), -1).alias("id"), tx.falsy_chain(F.col("title"), F.lit("Untitled paper")).alias("title"), inverted_index_text(F.col("abstract_inverted_index")).alias("summary"),
        F.coalesce(names, F.lit("")).alias("authors_raw"), F.col("publication_date").alias("published_date"), F.col("primary_location.source.display_name").alias("venue"), "doi", F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"),
        tx.falsy_chain(F.col("doi"), best["landing_page_url"]).alias("url"), best["pdf_url"].alias("pdf_url"), F.lit("OpenAlex").alias("source"), F.coalesce("open_access.is_oa", F.lit(False)).alias("open_access"),
    )


def from_semantic_scholar(items: DataFrame) -> DataFrame:
    return items.select(
        tx.falsy_chain(F.col("paperId"), F.col("externalIds.DOI"), F.col("title")).alias("id"), tx.falsy_chain(F.col("title"), F.lit("Untitled paper")).alias("title"), F.coalesce("abstract", F.lit("")).alias("summary"),
        F.coalesce(F.array_join(F.transform("authors", lambda a: F.coalesce(a["name"], F.lit(""))), ", "), F.lit("")).alias("authors_raw"), F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string")).alias("published_date"), "venue",
        F.col("externalIds.DOI").alias("doi"), F.coalesce("citationCount", F.lit(0)).alias("citation_count"), "url", F.col("openAccessPdf.url").alias("pdf_url"), F.lit("Semantic Scholar").alias("source"), (F.length(F.coalesce("openAccessPdf.url", F.lit(""))) > 0).alias("open_access"),
    )


def provider_union(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
