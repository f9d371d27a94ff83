"""Pages behind shard pointers: a slim table says in which shard a page lies, and only that shard's files are opened.

Layout under one folder: ``docs`` by volume, in order of shards, and ``meta`` (book_id, physical_page, shard, shard_offset and the
slim columns) by bucket of books. A volume is ``VOLUME`` shards, so that folders stay few. Reads go from the pointers to the
volumes, whose partitions Spark prunes while it runs, and inside them to the row groups that may hold the wanted shards.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import inverted
from quire.operators.numbering import numbered

BUCKETS = 64
VOLUME = 256
#: Rows of pointers up to which they are sent to all tasks, so that shards are pruned; more are joined by a shuffle.
FEW = 100_000


def bucket(book: Column) -> Column:
    return F.pmod(F.xxhash64(book), F.lit(BUCKETS)).cast("int")


def volume(shard: Column) -> Column:
    return F.floor(shard / VOLUME).cast("int")


def write(docs: DataFrame, path: str, slim: list[str], rows: int = 250) -> None:
    """Write pages and pointers. docs: book_id, physical_page and more; slim: further columns that the pointers bear.

    Shards have ``rows`` pages each, in order of book and page. A page number that a book has twice keeps both rows.
    """
    if docs.isEmpty():
        raise ValueError("there is nothing to write")
    counts = docs.groupBy("book_id").agg(F.count("*").alias("pages"))
    before = Window.orderBy("book_id").rowsBetween(Window.unboundedPreceding, -1)  # a row per book
    starts = counts.select("book_id", F.coalesce(F.sum("pages").over(before), F.lit(0)).alias("_start"))
    places = numbered(docs.select("book_id", "physical_page", *slim), "book_id", "physical_page", name="_at").join(starts, "book_id")
    pointed = inverted.shard_pointers(places, F.col("_start") + F.col("_at") - 1, rows).drop("_start", "_at")
    meta = pointed.withColumn("bucket", bucket(F.col("book_id")))
    meta.repartition("bucket", F.floor(F.col("physical_page") / 65536)).sortWithinPartitions("book_id", "physical_page").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/meta")
    held = docs.sparkSession.read.parquet(f"{path}/meta").groupBy("book_id", "physical_page").agg(F.min("shard").alias("shard"))
    placed = docs.join(held, ["book_id", "physical_page"]).withColumn("volume", volume(F.col("shard")))
    placed.repartition("volume").sortWithinPartitions("volume", "shard", "book_id", "physical_page").write.mode("overwrite").partitionBy("volume").parquet(f"{path}/docs")


def pointers(spark: SparkSession, path: str, book_id: str | None = None) -> DataFrame:
    """The slim table; with a book its bucket alone is read."""
    meta = spark.read.parquet(f"{path}/meta")
    if book_id is None:
        return meta.drop("bucket")
    number = spark.range(1).select(bucket(F.lit(book_id))).first()[0]
    return meta.where((F.col("bucket") == number) & (F.col("book_id") == book_id)).drop("bucket")


def read(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Whole pages of the pointers ``wanted`` (book_id, physical_page, shard); shards that hold none of them aren't opened."""
    keys = wanted.select("book_id", "physical_page", "shard", volume(F.col("shard")).alias("volume")).distinct()
    docs, some = spark.read.parquet(f"{path}/docs"), keys.take(FEW + 1)
    few = len(some) <= FEW
    if few and some:  # row groups outside are skipped
        docs = docs.where(F.col("shard").between(min(r["shard"] for r in some), max(r["shard"] for r in some)))
    return docs.join(F.broadcast(keys) if few else keys, ["book_id", "physical_page", "shard", "volume"], "left_semi").drop("volume")


def page(spark: SparkSession, path: str, book_id: str, physical_page: int, whole: str | None = None) -> DataFrame:
    """One page through its pointer; where the shards can't be read, from the ``whole`` index."""
    try:
        return read(spark, path, pointers(spark, path, book_id).where(F.col("physical_page") == physical_page))
    except AnalysisException as e:
        if whole is None or e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.read.parquet(whole).where((F.col("book_id") == book_id) & (F.col("physical_page") == physical_page))
