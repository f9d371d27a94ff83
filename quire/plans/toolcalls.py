"""The library's tools, called by ``spark.sql`` as table functions; they join the queries of ``library``."""

from pyspark.sql import functions as F

from quire.plans import corpus
from quire.plans.library import R, _joined, _search_sql
from quire.sources import tools


def _call(spark, sf, tool, **arguments):
    p = corpus.pages(spark, sf)
    tools.register(spark, p, corpus.books(p), corpus.folded(spark, sf) if tool == "search_books" else None)
    return tools.call(spark, tool, **arguments)


@R.add("SELECT book_id, title, subject, track, page_count FROM b WHERE contains(lower(subject || ' ' || title), 'subject 1') AND track = 'de'")
def tool_list_books(spark, sf):
    return _call(spark, sf, "list_books", subject="SUBJECT 1", track="DE")


@R.add("SELECT CAST(NULL AS VARCHAR) AS code, book_id, physical_page, printed_page, title, page_type FROM p WHERE book_id = 'src3'")
def tool_get_book(spark, sf):
    return _call(spark, sf, "get_book", book="src3")


@R.add(_search_sql(["that", "with"], "all", columns=", CAST(NULL AS VARCHAR) AS code"))
def tool_search_books(spark, sf):
    return _joined(_call(spark, sf, "search_books", query="That WITH", match="all"))


@R.add("SELECT CAST(NULL AS VARCHAR) AS code, book_id, physical_page, printed_page, title, text FROM p WHERE book_id = 'src3' AND printed_page = 2")
def tool_read_page(spark, sf):
    return _call(spark, sf, "read_page", book="src3", printed=2)


@R.add("SELECT CAST(NULL AS VARCHAR) AS code, book_id, physical_page, printed_page, title, text FROM p WHERE book_id = 'src3' AND physical_page BETWEEN 4 AND 6")
def tool_page_neighbors(spark, sf):
    return _call(spark, sf, "get_page_neighbors", book="src3", physical=5)


@R.add("SELECT CAST(NULL AS VARCHAR) AS code, book_id, physical_page, printed_page, title, text FROM p WHERE book_id = 'src3' AND printed_page BETWEEN 2 AND 9")
def tool_read_pages_range(spark, sf):
    return _call(spark, sf, "read_pages_range", book="src3", printed_from=2, printed_to=9)


@R.add("SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h']) AS asked, unnest(['EMPTY_QUERY', 'INVALID_BOOK_ID', 'BOOK_NOT_FOUND', 'PAGE_REQUIRED', 'PAGE_NOT_FOUND', 'PAGE_NUMBER_CONFLICT', 'AMBIGUOUS_PAGE_RANGE', 'INVALID_PAGE_RANGE']) AS code FROM (SELECT count(*) AS n FROM p) WHERE n > 0")
def tool_refusals(spark, sf):
    """Each refusal once, by one statement over several calls."""
    _call(spark, sf, "search_books", query="")
    asked = {
        "a": "search_books(' ')", "b": "get_book('no such: id')", "c": "get_book('src-none')", "d": "read_page('src3')", "e": "read_page('src3', physical => 100000000)", "f": "read_page('src3', physical => 5, printed => 3)",
        "g": "read_pages_range('src3', physical_from => 1, printed_to => 2)", "h": "read_pages_range('src3', physical_from => 3, physical_to => 2)",
    }
    return spark.sql(" UNION ALL ".join(f"SELECT '{k}' AS asked, code FROM {tools.PREFIX}{call}" for k, call in asked.items())).select("asked", F.col("code"))
