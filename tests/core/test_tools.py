"""The tools as SQL table functions: answers, refusals and edge cases on a small library."""

from pyspark.sql import functions as F

from quire.operators import search
from quire.sources import tools


def test_tools_and_their_codes(spark):
    rows = [("aa", 1, None, "One", "the first page"), ("aa", 2, 7, "Two", None), ("aa", 3, 7, "Three", "a THIRD page"), ("aa", 4, 9, None, "last"), ("bb", 1, 1, "Other", "the first page of bb"), (None, 1, 1, "x", "lost")]
    pages = spark.createDataFrame(rows, "book_id string, physical_page int, printed_page int, title string, text string").withColumns({c: F.lit(None).cast("string") for c in ("summary", "unit", "section", "purpose", "page_type")})
    books = spark.createDataFrame([("aa", "Alpha", "Maths", "de", 4), ("bb", "Beta", "Art", None, 1)], "book_id string, title string, subject string, track string, page_count long")
    names = tools.register(spark, pages, books, search.view(pages, search.FIELDS), "t_")
    assert names == [f"t_{n}" for n in tools.TOOLS]
    call = lambda tool, **args: tools.call(spark, tool, "t_", **args).collect()
    code = lambda tool, **args: [r["code"] for r in call(tool, **args)]
    assert [r["book_id"] for r in call("list_books", subject="alpha")] == ["aa"] and [r["book_id"] for r in call("list_books", track="General")] == ["bb"] and len(call("list_books")) == 2
    assert [(r["code"], r["physical_page"]) for r in call("get_book", book="bb")] == [(None, 1)]
    found = lambda **args: sorted((r["book_id"], r["physical_page"], r["matched_terms"], r["matched_in"]) for r in call("search_books", **args))
    assert found(query="First PAGE", match="phrase") == [("aa", 1, ["first page"], ["text"]), ("bb", 1, ["first page"], ["text"])]
    assert found(query="third zzz") == [("aa", 3, ["third"], ["text"])] and found(query="th") == [("aa", 1, ["th"], ["text"]), ("aa", 3, ["th"], ["text", "title"]), ("bb", 1, ["th"], ["text", "title"])]
    assert found(query="third zzz", match="all") == [] and found(query="page", book="bb", subject="art") == [("bb", 1, ["page"], ["text"])]
    assert [(r["physical_page"], r["text"]) for r in call("read_page", book="aa", printed=9)] == [(4, "last")] and [r["text"] for r in call("read_page", book="aa", physical=2, printed=7)] == [None]
    assert sorted(r["physical_page"] for r in call("get_page_neighbors", book="aa", physical=1)) == [1, 2] and sorted(r["physical_page"] for r in call("read_pages_range", book="aa", printed_from=7, printed_to=8)) == [2, 3]
    assert code("search_books", query=" ") == code("search_books", query=None) == ["EMPTY_QUERY"] and code("get_book", book="a") == code("get_book", book=None) == ["INVALID_BOOK_ID"] and code("get_book", book="cc") == ["BOOK_NOT_FOUND"]
    assert code("read_page", book="aa") == ["PAGE_REQUIRED"] and code("read_page", book="aa", printed=7) == ["AMBIGUOUS_PRINTED_PAGE"] and code("read_page", book="aa", physical=9) == ["PAGE_NOT_FOUND"]
    assert code("read_page", book="aa", physical=1, printed=7) == ["PAGE_NUMBER_CONFLICT"] and code("get_page_neighbors", book="zz", physical=1) == ["BOOK_NOT_FOUND"]
    assert code("read_pages_range", book="aa", physical_from=1, printed_to=2) == ["AMBIGUOUS_PAGE_RANGE"] and code("read_pages_range", book="aa", physical_from=2) == code("read_pages_range", book="aa", physical_from=2, physical_to=1) == ["INVALID_PAGE_RANGE"]
    assert code("open_all") == ["UNKNOWN_TOOL"]
    assert spark.sql("SELECT b.book_id, p.physical_page FROM t_books b, LATERAL t_get_book(b.book_id) p").count() == 5
