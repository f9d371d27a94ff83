"""Literal duplicates between and inside books, first occurrences, and descriptions that drifted to a neighbour page."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.numbering import numbered


def signature(text: Column, least: int = 200) -> Column:
    """SHA-1 of the folded text with its numbers masked; null for texts of less than ``least`` characters."""
    return tx.once(F.regexp_replace(tx.rule_fold(text), "[0-9٠-٩۰-۹]+", "#"), lambda folded: F.when(F.length(folded) >= least, F.sha1(folded)))


def cross_book_pairs(pages: DataFrame, min_shared: int = 3) -> DataFrame:
    """(left, right, shared): pairs of books with at least ``min_shared`` texts in common.

    Pages are first reduced to one row per text and book, so a text that thousands of pages repeat is paired once per pair of books.
    """
    return shared_pairs(pages.select("book_id", signature(F.col("text")).alias("s")), min_shared)


def shared_pairs(signed: DataFrame, min_shared: int = 3) -> DataFrame:
    """``cross_book_pairs`` of pages whose signatures are known. signed: book_id, s."""
    once = signed.where("s is not null").groupBy("s", "book_id").agg(F.lit(1).alias("one"))
    left, right = once.select("s", F.col("book_id").alias("left")), once.select("s", F.col("book_id").alias("right"))
    return left.join(right, "s").where("left < right").groupBy("left", "right").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)


def pair_offsets(pages: DataFrame, min_shared: int = 1) -> DataFrame:
    """(left, right, offset): upper median of the difference between the two books' shared pages, the first page of each text."""
    once = pages.select("book_id", "physical_page", signature(F.col("text")).alias("s")).where("s is not null").groupBy("s", "book_id").agg(F.min("physical_page").alias("page"))
    both = once.select("s", F.col("book_id").alias("left"), F.col("page").alias("a")).join(once.select("s", F.col("book_id").alias("right"), F.col("page").alias("b")), "s").where("left < right")
    values = both.groupBy("left", "right", (F.col("b") - F.col("a")).alias("d")).agg(F.count("*").alias("k"))
    upto = values.withColumn("upto", F.sum("k").over(Window.partitionBy("left", "right").orderBy("d")))
    n = both.groupBy(F.col("left").alias("_l"), F.col("right").alias("_r")).agg(F.count("*").alias("n"))
    joined = upto.join(n, (F.col("left") == F.col("_l")) & (F.col("right") == F.col("_r")))
    return joined.where((F.col("n") >= min_shared) & (F.col("upto") > F.floor(F.col("n") / 2))).groupBy("left", "right").agg(F.min("d").alias("offset"))


def repeated(pages: DataFrame, column: str, more_than: int = 1, key: str = "doc_id") -> DataFrame:
    """(book_id, key, n): every member of a value that more than ``more_than`` pages of a book share."""
    rows = pages.where(F.coalesce(F.col(column), F.lit("")) != "").select("book_id", key, F.col(column).alias("v"))
    counts = rows.groupBy("book_id", "v").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    return rows.join(counts, ["book_id", "v"]).select("book_id", key, "n")


def first_occurrences(pages: DataFrame, least: int = 6, key: str = "doc_id") -> DataFrame:
    """(key, at, line): the lines of each page that didn't occur on it before; shorter ones are all kept."""
    lines = pages.select(key, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    k = tx.compact_key(F.col("line"))
    return lines.withColumn("k", F.when(F.length(k) >= least, k).otherwise(F.concat(F.lit("\n"), F.col("at").cast("string")))).groupBy(key, "k").agg(F.min(F.struct("at", "line")).alias("f")).select(key, "f.at", "f.line")


def drifted(pages: DataFrame, own_most: float = 0.34, near_least: float = 0.67) -> DataFrame:
    """(book_id, physical_page): titles of three long words or more that the neighbours' texts prove and the page's own doesn't.

    Titles that their own page doesn't prove go to the neighbours by page number, and texts stay: what is found there comes back.
    """
    keys = ["book_id", "physical_page"]
    head = F.slice(F.array_distinct(F.filter(F.split(tx.word_fold(F.col("title")), " "), lambda w: F.length(w) >= 4)), 1, 6)
    seen = lambda text: F.filter("head", lambda w: F.contains(text, w))
    own = tx.once(tx.word_fold(F.col("text")), lambda t: F.when(t != "", F.size(seen(t)) / F.size("head")))
    asked = pages.select(*keys, head.alias("head"), "text").where(F.size("head") >= 3).where(own < own_most).drop("text")
    near = asked.select(*keys, "head", F.explode(F.array(F.col("physical_page") - 1, F.col("physical_page") + 1)).alias("near"))
    met = near.join(pages.select("book_id", F.col("physical_page").alias("near"), "text"), ["book_id", "near"])
    found = met.select(*keys, "head", tx.once(tx.word_fold(F.col("text")), seen).alias("seen")).groupBy(*keys, "head").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"))
    return found.where(F.size("seen") / F.size("head") >= near_least).select(*keys)


def contiguous_runs(rows: DataFrame, group: str, number: str, least: int = 4) -> DataFrame:
    """(group, first, last, size): runs of consecutive distinct numbers of at least ``least``."""
    distinct = rows.select(group, F.col(number).cast("long").alias("n")).distinct()
    ranked = numbered(distinct, group, "n", name="at")
    runs = ranked.withColumn("island", F.col("n") - F.col("at")).groupBy(group, "island").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("size"))
    return runs.where(F.col("size") >= least).select(group, "first", "last", "size")
