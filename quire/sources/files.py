"""Readers of library files: books, pages, enrichment, outlines, patches and rejects, and facts about files.

All of them read through Spark's sources, so any file system that Spark knows will do.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx

PAGE = "physicalPage INT, printedPage INT, fullText STRING, title STRING, summary STRING, section STRING, unit STRING, searchable BOOLEAN, needsOcr BOOLEAN"
BOOK = f"id STRING, title STRING, subject STRING, track STRING, branch STRING, year INT, pageCount INT, source STRUCT<fileName:STRING,bytes:BIGINT,checksum:STRING>, pages ARRAY<STRUCT<{', '.join(f'{n}:{t}' for n, t in (x.split(' ') for x in PAGE.split(', ')))}>>"
PATCH = "bookId STRING, physicalPage INT, title STRING, summary STRING, section STRING, unit STRING, educationalPurpose STRING, fullText STRING, note STRING"
REJECTS = "at STRING, count INT, rejects ARRAY<STRUCT<source:STRING,bookId:STRING,physicalPage:INT,field:STRING,code:STRING,value:STRING>>"
ENRICHED = "unit:STRING,section:STRING,title:STRING,summary:STRING,pageType:STRING,educationalPurpose:STRING,vocabulary:ARRAY<STRING>,verifiedNumbers:ARRAY<STRING>"


def json_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON; a file that doesn't parse stops the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON; files that don't parse and paths that don't exist give no rows."""
    try:
        read = spark.read.schema(f"{schema}, _corrupt STRING").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return read.where("_corrupt is null").drop("_corrupt")


def first_readable(spark: SparkSession, *paths: str) -> DataFrame:
    """The first Parquet table of several layouts that is there: shards first, then the whole index."""
    for path in paths[:-1]:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return spark.read.parquet(paths[-1])


def catalog_pages(books: DataFrame) -> DataFrame:
    """One row per page of nested books; ids that aren't plain and pages without a number go, of equal pages the last stays."""
    rows = books.where(F.col("id").rlike("(?i)^[a-z0-9][a-z0-9-]{1,80}$")).select(F.col("id").alias("book_id"), F.posexplode("pages").alias("at", "page"))
    last = rows.where("page.physicalPage > 0").groupBy("book_id", F.col("page.physicalPage").alias("physical_page")).agg(F.max(F.struct("at", "page")).alias("m"))
    page = lambda name: F.col(f"m.page.{name}")
    return last.select("book_id", "physical_page", page("printedPage").alias("printed_page"), page("fullText").alias("text"), page("title").alias("title"), page("summary").alias("summary"), page("section").alias("section"), page("unit").alias("unit"))


def enrichment(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, physical_page, fields) of files of schema version 1 whose name is their book's id."""
    files = json_tolerant(spark, path, f"schemaVersion INT, bookId STRING, pages MAP<STRING,STRUCT<{ENRICHED}>>")
    named = files.withColumn("_file", F.regexp_extract(F.input_file_name(), "([^/]+)\\.json$", 1)).where("schemaVersion = 1 and bookId = _file")
    return named.select(F.col("bookId").alias("book_id"), F.explode("pages").alias("page", "extra")).select("book_id", tx.parse_int(F.col("page")).alias("physical_page"), "extra.*")


def whole_texts(spark: SparkSession, path: str, suffix: str = "md") -> DataFrame:
    """(book_id, value): each file as one text, under its name without the suffix."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), f"([^/]+)\\.{suffix}$", 1).alias("book_id"), "value")


def patch_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(patches, errors): entries of files that hold an array or ``{patches: []}``; reject files are left out, files that don't parse are errors.

    Each entry has its file, its priority (generated files 0, reviewed ones 1) and its place in the file.
    """
    files = spark.read.text(path, wholetext=True).withColumn("source", F.element_at(F.split(F.input_file_name(), "/"), -1)).where("source not like 'rejected-%'")
    kind = f"array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ') for x in PATCH.split(', ')))}>>"
    inner = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.patches"))
    parsed = files.withColumn("entries", F.from_json(inner, kind))
    rows = parsed.select("source", F.when(F.col("source").startswith("generated-"), 0).otherwise(1).alias("priority"), F.posexplode("entries").alias("position", "e")).select("source", "priority", "position", "e.*")
    return rows, parsed.where("entries is null").select("source", F.lit("UNREADABLE").alias("code"))


def patch_values(entries: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Patch entries as (book_id, physical_page, field, value, source, priority, position); fields: name in the file to column."""
    long = entries.select(F.col("bookId").alias("book_id"), F.col("physicalPage").alias("physical_page"), "source", "priority", "position", F.explode(F.array(*(F.struct(F.lit(to).alias("field"), F.col(c).alias("value")) for c, to in fields.items()))).alias("f"))
    return long.select("book_id", "physical_page", "f.field", "f.value", "source", "priority", "position").where("value is not null")


def reject_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, physical_page, field, tries) over all reject files."""
    rows = json_tolerant(spark, path, REJECTS).select(F.explode("rejects").alias("r")).select("r.*")
    return rows.groupBy(F.col("bookId").alias("book_id"), F.col("physicalPage").alias("physical_page"), "field").agg(F.count("*").alias("tries"))


def file_facts(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(file_name, bytes, mtime) of files, with ``digest`` also their SHA-256 and whether they begin like a PDF; contents are read only then."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    facts = [name, F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")]
    return files.select(*facts, *([F.sha2("content", 256).alias("digest"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf")] if digest else []))


def readers_of(spark: SparkSession, code_path: str, layers: DataFrame) -> DataFrame:
    """(layer, readers): how many code files name each layer. layers: layer, a word; files and layers meet by equal words."""
    words = spark.read.text(code_path, wholetext=True).select(F.input_file_name().alias("file"), F.explode(F.array_distinct(F.split("value", "[^A-Za-z0-9_-]+"))).alias("layer"))
    return layers.join(words, "layer", "left").groupBy("layer").agg(F.countDistinct("file").alias("readers"))
