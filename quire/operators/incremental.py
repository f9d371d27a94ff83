"""An inverted index that follows its books: only what a change touches is computed and written.

Layout under one folder: ``postings`` by book (term, doc_id), ``terms`` by the terms' first character (term, df, inside: where
its postings begin among that character's), and ``leads`` (lead, total). A refresh reads the stale books' old and new postings,
sums them up as signed deltas, and writes new rows for the touched first characters and the stale books alone, by dynamic
partition overwrite. What it will write is stored first, as whole values and not as differences, so that an interrupted
refresh is finished by the next call and no delta counts twice.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PENDING = "pending"


def _lead(term: str = "term") -> Column:
    return F.ascii(term)  # the first code point, so that leads are in order as terms are


def _placed(frequencies: DataFrame) -> DataFrame:
    """(lead, term, df, inside) of (term, df); a first character's terms are ranked in ranges of their second one, which are summed up."""
    keyed = frequencies.select(_lead().alias("lead"), F.substring("term", 1, 2).alias("_two"), "term", "df")
    sums = keyed.groupBy("lead", "_two").agg(F.sum("df").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lead").orderBy("_two").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("df").over(Window.partitionBy("lead", "_two").orderBy("term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = keyed.withColumn("_inside", inside).join(sums.select("lead", "_two", before.alias("_before")), ["lead", "_two"])
    return both.select("lead", "term", "df", (F.col("_before") + F.col("_inside")).alias("inside"))


def _postings(docs: DataFrame, terms: Column) -> DataFrame:
    return docs.select("book_id", F.explode(F.array_distinct(terms)).alias("term"), "doc_id")


def _write(rows: DataFrame, path: str, by: str, dynamic: bool = False) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(by).parquet(path)


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _there(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def build(docs: DataFrame, terms: Column, path: str) -> None:
    """Write the whole index. docs: book_id, doc_id and what ``terms`` reads; a null book or term has no place in it."""
    spark = docs.sparkSession
    _write(_postings(docs.where("book_id is not null"), terms).repartition("book_id", F.pmod(F.xxhash64("doc_id"), F.lit(16))), f"{path}/postings", "book_id")
    held = spark.read.schema("term string, doc_id long, book_id string").parquet(f"{path}/postings")
    _write(_placed(held.groupBy("term").agg(F.count("*").alias("df"))).repartition("lead"), f"{path}/terms", "lead")
    _write_leads(spark, path)


def _write_leads(spark: SparkSession, path: str) -> None:
    totals = spark.read.schema("term string, df long, inside long, lead int").parquet(f"{path}/terms").groupBy("lead").agg(F.sum("df").alias("total"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/leads")


def postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, doc_id long, book_id string").parquet(f"{path}/postings")


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, start): where each term's postings begin if all terms lie in code point order; leads are few, so their sums are one small window."""
    leads = spark.read.parquet(f"{path}/leads")
    starts = leads.select("lead", F.coalesce(F.sum("total").over(Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rows = spark.read.schema("term string, df long, inside long, lead int").parquet(f"{path}/terms")
    return rows.join(starts, "lead").select("term", "df", (F.col("_start") + F.col("inside")).alias("start"))


def deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """(term, change): by how much each term's document frequency changes; 0 is left out. old and new: postings of the stale books."""
    signed = old.select("term", F.lit(-1).alias("n")).unionByName(new.select("term", F.lit(1).alias("n")))
    return signed.groupBy("term").agg(F.sum("n").alias("change")).where("change <> 0")


def refresh(docs: DataFrame, stale: DataFrame, terms: Column, path: str) -> None:
    """Bring the index up to date for the books in ``stale`` (book_id), whose pages are what ``docs`` now holds of them; a book without pages goes.

    Books that aren't stale keep their files. docs may hold other books too; they aren't read if it is laid out by book.
    """
    spark = docs.sparkSession
    finish(spark, path)
    books = stale.select("book_id").where("book_id is not null").distinct()
    new = _postings(docs.join(books, "book_id", "left_semi"), terms)
    old = postings(spark, path).join(books, "book_id", "left_semi")
    pending = f"{path}/{PENDING}"
    _write(new.repartition("book_id", F.pmod(F.xxhash64("doc_id"), F.lit(16))), f"{pending}/postings", "book_id")
    made = spark.read.schema("term string, doc_id long, book_id string").parquet(f"{pending}/postings")
    changed = deltas(old, made)
    changed.write.mode("overwrite").parquet(f"{pending}/deltas")
    changed = spark.read.parquet(f"{pending}/deltas")
    touched = changed.select(_lead().alias("lead")).distinct()
    before = spark.read.schema("term string, df long, inside long, lead int").parquet(f"{path}/terms").join(touched, "lead", "left_semi")
    after = before.select("term", "df").unionByName(changed.select("term", F.col("change").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
    _write(_placed(after.where("df > 0")).repartition("lead"), f"{pending}/terms", "lead")
    kept = spark.read.schema("term string, df long, inside long, lead int").parquet(f"{pending}/terms").select("lead").distinct()
    touched.join(kept, "lead", "left_anti").select(F.concat(F.lit("terms/lead="), "lead").alias("gone")).unionByName(
        old.select("book_id").distinct().join(made.select("book_id").distinct(), "book_id", "left_anti").select(F.concat(F.lit("postings/book_id="), "book_id").alias("gone"))
    ).write.mode("overwrite").parquet(f"{pending}/gone")  # the last to be written: from here on the refresh can be finished
    finish(spark, path)


def finish(spark: SparkSession, path: str) -> None:
    """Put a pending refresh in its place; one that wasn't stored to its end is dropped. Doing it again changes nothing."""
    pending = f"{path}/{PENDING}"
    if not _there(spark, pending):
        return
    if _there(spark, f"{pending}/gone/_SUCCESS"):
        for name, by, schema in (("postings", "book_id", "term string, doc_id long, book_id string"), ("terms", "lead", "term string, df long, inside long, lead int")):
            try:
                rows = spark.read.schema(schema).parquet(f"{pending}/{name}")
                _write(rows, f"{path}/{name}", by, dynamic=True)
            except AnalysisException as e:  # nothing is left of what was touched
                if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
        for row in spark.read.parquet(f"{pending}/gone").toLocalIterator():  # a name for each partition that is empty now
            _delete(spark, f"{path}/{row['gone']}")
        _write_leads(spark, path)
    _delete(spark, pending)
