"""Writers: tables, single books, shards with bounded files, reports and outlines. Spark's committers make each write atomic."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_index(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").partitionBy("book_id").parquet(path)


def write_books(docs: DataFrame, path: str) -> None:
    """Replace the partitions of the books in ``docs`` and leave the other books as they are."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


def write_shards(docs: DataFrame, path: str, rows: int = 250) -> None:
    """Files of at most ``rows`` rows in order of book and page; an empty table is an error."""
    if docs.isEmpty():
        raise ValueError("there is nothing to write")
    docs.repartitionByRange("book_id", "physical_page").sortWithinPartitions("book_id", "physical_page").write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def write_shard_tables(docs: DataFrame, terms, path: str, rows: int = 250) -> None:
    """The shards and what stands beside them: meta (each page's shard and place), printed, lookup (term, df, start) and manifest.

    docs: book_id, physical_page, printed_page, title, text; terms: a Column of each page's terms.
    """
    if docs.isEmpty():
        raise ValueError("there is nothing to write")
    from quire.operators import inverted
    from quire.operators.numbering import numbered

    books = docs.groupBy("book_id").agg(F.count("*").alias("pages"))
    before = Window.orderBy("book_id").rowsBetween(Window.unboundedPreceding, -1)  # a row per book
    starts = books.select("book_id", F.coalesce(F.sum("pages").over(before), F.lit(0)).alias("_start"))
    placed = numbered(docs.select("book_id", "physical_page", "printed_page", "title"), "book_id", "physical_page", name="_at").join(starts, "book_id")
    inverted.shard_pointers(placed, F.col("_start") + F.col("_at") - 1, rows).drop("_start", "_at").write.mode("overwrite").parquet(f"{path}/meta")
    write_shards(docs, f"{path}/docs", rows)
    inverted.printed_map(docs).write.mode("overwrite").parquet(f"{path}/printed")
    inverted.offsets(inverted.document_frequency(docs, terms)).write.mode("overwrite").parquet(f"{path}/lookup")
    books.agg(F.count("*").alias("books"), F.sum("pages").alias("pages"), F.ceil(F.sum("pages") / rows).alias("shards")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_patches(accepted: DataFrame, path: str) -> DataFrame:
    """Append accepted values, one folder per book named after it and its first and last page; returns (book_id, file).

    A name that is taken already gets the next number behind it, so that earlier patches stay. accepted: book_id, physical_page and more.
    """
    pad = lambda c: F.lpad(c.cast("string"), 4, "0")
    spans = accepted.groupBy("book_id").agg(F.min("physical_page").alias("a"), F.max("physical_page").alias("b"))
    named = spans.select("book_id", F.concat_ws("-", F.lit("enrich"), "book_id", pad(F.col("a")), pad(F.col("b"))).alias("base"))
    try:
        taken = accepted.sparkSession.read.json(path).select(F.regexp_extract("file", "^(.*?)(?:-b([0-9]+))?$", 1).alias("base"), F.regexp_extract("file", "-b([0-9]+)$", 1).alias("n")).distinct()
    except AnalysisException:
        taken = accepted.sparkSession.createDataFrame([], "base string, n string")
    last = taken.groupBy("base").agg(F.max(F.coalesce(F.expr("try_cast(n as int)"), F.lit(0))).alias("n"))
    files = named.join(last, "base", "left").select("book_id", F.when(F.col("n").isNull(), F.col("base")).otherwise(F.concat(F.col("base"), F.lit("-b"), (F.col("n") + 1).cast("string"))).alias("file"))
    chosen = [tuple(r) for r in files.collect()]  # a row per book; settled before the folder changes
    held = accepted.sparkSession.createDataFrame(chosen, "book_id string, file string")
    accepted.join(held, "book_id").write.mode("append").partitionBy("file").json(path)
    return held


def patch_report(outcomes: DataFrame, rejects: DataFrame) -> DataFrame:
    """(kind, name, n): outcomes by state and field, and rejects by code."""
    by = lambda rows, kind, name: rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return by(outcomes, "state", F.col("state")).unionByName(by(outcomes.where("state = 'pending'"), "pending", F.col("field"))).unionByName(by(rejects, "reject", F.col("code")))


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def manifest(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """(book_id, file_name, bytes, mtime, pages) for the freshness check; facts: file_name, bytes, mtime."""
    counts = pages.groupBy("book_id").agg(F.count("*").alias("pages"))
    return counts.join(facts.withColumn("book_id", F.regexp_extract("file_name", "^(.*)\\.[a-z]+$", 1)), "book_id", "left")


def outlines(pages: DataFrame) -> DataFrame:
    """(book_id, value): an outline in Markdown for each book, a heading per page in order; a book's headings are one row."""
    printed = F.when(F.col("printed_page").isNotNull(), F.concat(F.lit(" (printed "), F.col("printed_page").cast("string"), F.lit(")"))).otherwise("")
    label = lambda name: F.concat(F.lit(f"\n- **{name}**: "), F.coalesce(F.regexp_replace(F.col(name), "[\r\n]+", " "), F.lit("")))
    entry = F.concat(F.lit("### Page "), F.col("physical_page").cast("string"), printed, label("title"), label("description"))
    rows = pages.select("book_id", "physical_page", entry.alias("entry")).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("physical_page", "entry"))).alias("e"))
    return rows.select("book_id", F.concat(F.lit("# "), "book_id", F.lit("\n\n"), F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n"), F.lit("\n")).alias("value"))


def write_outlines(pages: DataFrame, path: str) -> None:
    outlines(pages).write.mode("overwrite").partitionBy("book_id").text(path)
