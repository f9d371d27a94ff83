"""Inverted index: document frequency, postings, offsets of a sorted layout, keywords and shard pointers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_frequency(docs: DataFrame, terms: Column) -> DataFrame:
    """(term, df): in how many rows each term occurs; counted before the shuffle, so a frequent term is no hot key."""
    return docs.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def distinct_terms(docs: DataFrame, terms: Column, key: str) -> DataFrame:
    """(key, term): the terms of each key, every one once; repeats go inside a row before they are shuffled."""
    return docs.select(key, F.explode(F.array_distinct(terms)).alias("term")).distinct()


def postings(docs: DataFrame, terms: Column, key: str = "doc_id", span: int = 1 << 16) -> DataFrame:
    """(term, key): one row per posting, sorted within partitions by term and key.

    A term's postings stay rows; they are dealt out by the term and by stretches of ``span`` whole-number keys, so that a
    frequent term's list lies in many tasks and the texts are read once.
    """
    rows = docs.select(F.explode(F.array_distinct(terms)).alias("term"), key)
    return rows.repartition("term", F.floor(F.col(key) / span)).sortWithinPartitions("term", key)


def first_postings(docs: DataFrame, terms: Column, key: str = "doc_id") -> DataFrame:
    """(term, df, first_doc, last_doc) for a term's directory entry."""
    rows = docs.select(F.explode(F.array_distinct(terms)).alias("term"), key)
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.min(key).alias("first_doc"), F.max(key).alias("last_doc"))


def with_global(frequencies: DataFrame, known: DataFrame) -> DataFrame:
    """(term, df): the df of ``known`` (term, df) where it has the term, else the own one."""
    return frequencies.join(known.select("term", F.col("df").alias("_df")), "term", "left").select("term", F.coalesce("_df", "df").alias("df"))


def offsets(frequencies: DataFrame, prefix: int = 2) -> DataFrame:
    """(term, df, start): where each term's postings begin if all terms lie in code point order.

    Terms are grouped by their first ``prefix`` characters, whose sums are few; only inside a group is there a window over terms.
    """
    keyed = frequencies.withColumn("_k", F.substring("term", 1, prefix))
    groups = keyed.groupBy("_k").agg(F.sum("df").alias("_n"))
    before = groups.select("_k", F.coalesce(F.sum("_n").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("df").over(Window.partitionBy("_k").orderBy("term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed.withColumn("_inside", inside).join(before, "_k").select("term", "df", (F.col("_start") + F.col("_inside")).alias("start"))


def keywords_by_count(docs: DataFrame, words: Column, count: int = 10, key: str = "doc_id") -> DataFrame:
    """(key, keyword, n, rank): each row's ``count`` most frequent words, longer ones first among equals, then the one that comes first.

    Words of digits alone go after the choice, so that such a row has fewer.
    """
    rows = docs.select(key, F.posexplode(words).alias("at", "keyword")).groupBy(key, "keyword").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), F.desc(F.length("keyword")), "at")
    return rows.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= count) & ~F.col("keyword").rlike("^[0-9]+$")).select(key, "keyword", "n", "rank")


def shard_pointers(rows: DataFrame, position: Column, size: int = 250) -> DataFrame:
    """Each row's shard and its place in it."""
    return rows.withColumn("shard", F.floor(position / size).cast("int")).withColumn("shard_offset", (position % size).cast("int"))


def printed_map(pages: DataFrame) -> DataFrame:
    """(book_id, printed_page, physical_page): the last physical page that bears each printed number."""
    return pages.where("printed_page is not null").groupBy("book_id", "printed_page").agg(F.max("physical_page").alias("physical_page"))
