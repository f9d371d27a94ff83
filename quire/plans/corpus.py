"""The book and page tables that the operators work on, made from a table of documents.

A source is a book, and its documents in order of their ids are its pages. Both the DataFrames here and ``BASE`` (the
same views as common table expressions) define the columns; a change in one needs the other.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import grams, search
from quire.operators.numbering import numbered
from quire.sources import tables

#: A number that differs from book to book, for Spark and DuckDB alike: what the tables lack is made up by it.
TURN = "ascii(right(book_id, 1))"

# fixed values: the types a page may have
PAGE_TYPES = ("divider", "lesson_content", "parallel_text", "boxed_recap", "matching", "exercises", "glossary", "contents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table: documents numbered within their book, written once in order of book and page and read from there.

    Texts move when the table is written, and in no query: a filter on books or pages reaches the scan and skips row groups.
    """
    path = f"{sf_dir}/documents.parquet"

    def make() -> DataFrame:
        documents = spark.read.parquet(path).select(F.col("source").alias("book_id"), "doc_id", "text", "lang").where("doc_id is not null")
        return numbered(documents, "book_id", "doc_id", name="physical_page", laid=True).select("book_id", "physical_page", "doc_id", "text", "lang")

    return described(tables.derived(spark, "pages", [path], make))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable view of all pages, folded once and laid out by book and stretch of pages, as the page table is already."""

    def view() -> DataFrame:
        held = pages(spark, sf_dir)
        return grams.stretched(search.view(held, search.FIELDS), grams.span_for(held.count()), laid=True)

    return tables.derived(spark, "folded", [f"{sf_dir}/documents.parquet"], view, grams.KEYS)


def described(docs: DataFrame) -> DataFrame:
    """The columns that every query reads, made up where the documents lack them. docs: book_id, physical_page, doc_id, text, lang."""
    types = F.array(*map(F.lit, PAGE_TYPES))
    return docs.select(
        "book_id", "physical_page", F.when(F.col("physical_page") > 4, F.col("physical_page") - 4).alias("printed_page"), "doc_id", "text", "lang",
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 90).alias("title"), F.substring("text", 1, 200).alias("summary"), F.col("lang").alias("section"),
        F.concat(F.lit("unit "), F.floor(F.col("physical_page") / 25).cast("string")).alias("unit"),
        F.when(F.col("doc_id") % 3 == 0, "read the page and answer").otherwise(F.substring("text", 1, 60)).alias("purpose"),
        F.when(F.col("doc_id") % 50 == 0, "cover").otherwise(F.get(types, (F.col("doc_id") % 8).cast("int"))).alias("page_type"),
        F.length("text").alias("text_length"), (F.length("text") >= 20).alias("searchable"), (F.length("text") < 20).alias("needs_ocr"),
    )


def books(pages: DataFrame) -> DataFrame:
    """One row per book: aggregates over its pages."""
    return pages.groupBy("book_id").agg(
        F.min("lang").alias("track"), F.count("*").alias("page_count"), F.count_if("searchable").alias("searchable_page_count"), F.max("physical_page").alias("last_page"),
    ).select(
        "book_id", F.concat(F.lit("Book "), "book_id").alias("title"), F.concat(F.lit("subject "), F.right("book_id", F.lit(1))).alias("subject"), "track", "page_count", "searchable_page_count",
        (F.col("page_count") + F.when(F.expr(f"{TURN} % 7 = 0"), 1).otherwise(0)).alias("declared_count"), "last_page",
    )


def index(pages: DataFrame) -> DataFrame:
    """The indexed layer: pages with gaps, shortened texts and stale flags, so that the consistency checks have findings."""
    half = F.substring("text", F.lit(1), F.floor(F.col("text_length") / 2).cast("int"))
    text = F.when(F.col("doc_id") % 41 == 0, half).when(F.col("doc_id") % 89 == 0, "").otherwise(F.col("text"))
    return pages.where(F.col("doc_id") % 37 != 0).withColumn("text", text).withColumn("searchable", F.when(F.col("doc_id") % 43 == 0, ~F.col("searchable")).otherwise(F.col("searchable")))


#: The same views for DuckDB.
BASE = """
WITH pages_ AS (
  SELECT source AS book_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS physical_page, doc_id, text, lang FROM documents),
p AS (
  SELECT book_id, physical_page, CASE WHEN physical_page > 4 THEN physical_page - 4 END AS printed_page, doc_id, text, lang,
    substr(split_part(text, chr(10), 1), 1, 90) AS title, substr(text, 1, 200) AS summary, lang AS section, 'unit ' || CAST(physical_page // 25 AS VARCHAR) AS unit,
    CASE WHEN doc_id % 3 = 0 THEN 'read the page and answer' ELSE substr(text, 1, 60) END AS purpose,
    CASE WHEN doc_id % 50 = 0 THEN 'cover' ELSE ['divider', 'lesson_content', 'parallel_text', 'boxed_recap', 'matching', 'exercises', 'glossary', 'contents'][doc_id % 8 + 1] END AS page_type,
    CAST(length(text) AS INTEGER) AS text_length, length(text) >= 20 AS searchable, length(text) < 20 AS needs_ocr
  FROM pages_),
b AS (
  SELECT book_id, 'Book ' || book_id AS title, 'subject ' || right(book_id, 1) AS subject, min(lang) AS track, count(*) AS page_count,
    count(*) FILTER (WHERE searchable) AS searchable_page_count, count(*) + CASE WHEN ascii(right(book_id, 1)) % 7 = 0 THEN 1 ELSE 0 END AS declared_count, max(physical_page) AS last_page
  FROM p GROUP BY book_id),
x AS (
  SELECT * REPLACE (CASE WHEN doc_id % 41 = 0 THEN substr(text, 1, text_length // 2) WHEN doc_id % 89 = 0 THEN '' ELSE text END AS text,
    CASE WHEN doc_id % 43 = 0 THEN NOT searchable ELSE searchable END AS searchable)
  FROM p WHERE doc_id % 37 <> 0)
"""


class Registry:
    """Named queries and, where SQL can express them, their DuckDB twins."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, sql: str | None = None, base: bool = True):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = (BASE if base else "") + sql
            return f

        return register
