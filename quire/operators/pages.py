"""Catalog, page reads, page numbers, ranges and neighbours."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx


def subjects(books: DataFrame) -> DataFrame:
    """Distinct subjects that aren't empty, sorted."""
    return books.where("subject <> ''").select("subject").distinct().orderBy("subject")


def totals(books: DataFrame) -> DataFrame:
    """Books, pages, searchable pages and subjects of a catalog."""
    return books.agg(
        F.count("*").alias("books"), F.sum(F.coalesce("page_count", F.lit(0))).alias("pages"), F.sum(F.coalesce("searchable_page_count", F.lit(0))).alias("searchable_pages"), F.countDistinct("subject").alias("subjects"),
    )


def health(pages: DataFrame, status: Column, kinds: tuple) -> DataFrame:
    """Counts of pages, searchable pages and of each status, absent ones as 0."""
    return pages.select("searchable", status.alias("s")).agg(
        F.count("*").alias("pages"), F.count_if("searchable").alias("searchable"), *(F.count_if(F.col("s") == k).alias(k.replace("-", "_")) for k in kinds),
    )


def freshness(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(book_id, state): fresh, stale if size or time differ or the file is gone, unknown if no file is named."""
    both = manifest.join(found.select(F.col("file_name").alias("_f"), F.col("bytes").alias("_b"), F.col("mtime").alias("_m")), F.col("file_name") == F.col("_f"), "left")
    same = (F.col("bytes") == F.col("_b")) & (F.col("mtime") == F.col("_m"))
    return both.select("book_id", F.when(F.col("file_name").isNull() | (F.col("file_name") == ""), "unknown").when(F.coalesce(same, F.lit(False)), "fresh").otherwise("stale").alias("state"))


def read(pages: DataFrame, book_id: str, physical_page: int, *columns: str) -> DataFrame:
    return pages.where((F.col("book_id") == book_id) & (F.col("physical_page") == physical_page)).select(*columns)


def locate(pages: DataFrame) -> DataFrame:
    """(book_id, printed_page, physical_page): the physical page of each printed number, null unless it is the only one."""
    return pages.where("printed_page is not null").groupBy("book_id", "printed_page").agg(F.when(F.count("*") == 1, F.max("physical_page")).alias("physical_page"))


def resolve(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(request_id, resolved, status) of requests (request_id, book_id, physical, printed); a physical number wins.

    OK, PAGE_REQUIRED, PAGE_NOT_FOUND, AMBIGUOUS_PRINTED_PAGE, or PAGE_NUMBER_CONFLICT if both numbers are given and disagree.
    """
    known = pages.select("book_id", "physical_page", "printed_page")
    by = lambda asked, column: (
        requests.where(asked)
        .join(known.withColumnRenamed("book_id", "_b"), (F.col("book_id") == F.col("_b")) & (F.col(column) == F.col("physical_page" if column == "physical" else "printed_page")), "left")
        .groupBy("request_id", "physical", "printed")
        .agg(F.count("physical_page").alias("n"), F.max("physical_page").alias("page"), F.max("printed_page").alias("number"))
    )
    found = by(F.col("physical").isNotNull(), "physical").unionByName(by(F.col("physical").isNull() & F.col("printed").isNotNull(), "printed"))
    clash = F.col("printed").isNotNull() & ~F.col("number").eqNullSafe(F.col("printed"))
    status = F.when(F.col("n") > 1, "AMBIGUOUS_PRINTED_PAGE").when(F.col("n") == 0, "PAGE_NOT_FOUND").when(clash, "PAGE_NUMBER_CONFLICT").otherwise("OK")
    done = found.select("request_id", status.alias("status"), F.when(status == "OK", F.col("page")).alias("resolved"))
    none = requests.where("physical is null and printed is null").select("request_id", F.lit("PAGE_REQUIRED").alias("status"), F.lit(None).cast("int").alias("resolved"))
    return done.unionByName(none)


def resolve_book(requests: DataFrame, books: DataFrame) -> DataFrame:
    """(request_id, book_id): the book whose folded title or subject equals the folded query; null unless it is the only one. requests: request_id, query."""
    keys = books.select("book_id", F.explode(F.array(*(tx.fold(F.col(c)) for c in ("title", "subject")))).alias("_key")).distinct()
    ends = keys.groupBy("_key").agg(F.when(F.min("book_id") == F.max("book_id"), F.min("book_id")).alias("book_id"))
    return requests.select("request_id", tx.fold(F.col("query")).alias("_key")).join(ends, "_key", "left").select("request_id", "book_id")


def page_map(pages: DataFrame, status: Column) -> DataFrame:
    """A book's map: numbers, where the printed one comes from, title, type, status and whether the page can be searched."""
    source = F.when(F.col("printed_page").isNotNull(), "stored").otherwise("unverified")
    return pages.select("book_id", "physical_page", "printed_page", source.alias("printed_page_source"), "title", "page_type", status.alias("evidence_status"), "searchable")


def full_page(index: DataFrame, stored: DataFrame, books: DataFrame, columns: list[str]) -> DataFrame:
    """The indexed rows with the stored page's ``columns`` in their place, whether the indexed text differs, and the page numbers next to it.

    Pages that one side lacks have no row.
    """
    held = stored.select("book_id", "physical_page", "text", *(F.col(c).alias(f"_s_{c}") for c in columns))
    both = index.withColumnRenamed("text", "_indexed").join(held, ["book_id", "physical_page"]).join(books.select("book_id", "page_count"), "book_id")
    page = F.col("physical_page")
    kept = [F.coalesce(f"_s_{c}", c).alias(c) for c in columns]
    return both.select("book_id", page, "text", *kept, (~F.col("_indexed").eqNullSafe(F.col("text"))).alias("indexed_text_differs"), F.when(page > 1, page - 1).alias("previous"), F.when(page < F.col("page_count"), page + 1).alias("next"))


def outline_map(pages: DataFrame, most: int = 60_000) -> DataFrame:
    """(book_id, physical_page, line): a line per page, in order, while a book's lines fit into ``most`` characters.

    A line has 8 characters at least, so only the first ``most`` / 8 pages of a book are looked at.
    """
    printed = F.when(F.col("printed_page").isNotNull() & (F.col("printed_page") != F.col("physical_page")), F.concat(F.lit(" (printed "), F.col("printed_page").cast("string"), F.lit(")"))).otherwise("")
    label = F.concat(F.lit("page "), F.col("physical_page").cast("string"), printed, F.lit(": "), F.coalesce(F.expr("nullif(title, '')"), F.col("page_type"), F.lit("page")))
    rows = pages.where(F.col("physical_page") <= most // 8).select("book_id", "physical_page", label.alias("line"))
    order = Window.partitionBy("book_id").orderBy("physical_page")
    used = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = rows.withColumn("over", (used + F.length("line") > most).cast("int"))
    return over.withColumn("stop", F.max("over").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("stop = 0").select("book_id", "physical_page", "line")


def in_range(pages: DataFrame, number: str, first: int, last: int) -> DataFrame:
    """Pages whose ``number`` lies in the range; order by that number, then by the physical page."""
    if last < first:
        raise ValueError("the range ends before it begins")
    return pages.where(F.col(number).between(first, last)).orderBy("book_id", number, "physical_page")


def missing_ranges(pages: DataFrame, number: str, first: int, last: int, group: str = "book_id") -> DataFrame:
    """(group, first_missing, last_missing): the gaps of each group's distinct numbers in [first, last], head and tail included."""
    present = pages.where(F.col(number).between(first, last)).select(group, F.col(number).alias("n")).distinct()
    edges = pages.select(group).distinct().select(group, F.explode(F.array(F.lit(first - 1), F.lit(last + 1))).alias("n"))
    order = Window.partitionBy(group).orderBy("n")
    gaps = present.unionByName(edges).withColumn("before", F.lag("n").over(order)).where(F.col("n") - F.col("before") > 1)
    return gaps.select(group, (F.col("before") + 1).alias("first_missing"), (F.col("n") - 1).alias("last_missing"))


def neighbours(pages: DataFrame, physical_page: int) -> DataFrame:
    """Of every book the page and the real pages next to it."""
    return pages.where(F.abs(F.col("physical_page") - physical_page) <= 1)


def previous_and_next(pages: DataFrame, books: DataFrame) -> DataFrame:
    """Page numbers one less and one more, inside 1 and the book's page count, whether the pages exist or not."""
    both = pages.join(books.select("book_id", "page_count"), "book_id")
    page = F.col("physical_page")
    return both.select("book_id", page, F.when(page > 1, page - 1).alias("previous"), F.when(page < F.col("page_count"), page + 1).alias("next"))


def batch(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A slice of ordered rows with total, returned and next_offset."""
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # total is one row
    end = F.least(F.lit(offset + limit), F.col("total"))
    return part.withColumn("returned", end - offset).withColumn("next_offset", F.when(end < F.col("total"), end))
