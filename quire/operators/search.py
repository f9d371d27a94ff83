"""Filtered substring search over pages, with stable order and paging.

A view is a DataFrame of ``book_id``, ``physical_page`` and folded text fields. The terms of one query are constants, so the
search is a projection and a filter in one scan; a batch of queries is one automaton that runs over each text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import arabic
from quire.functions import text as tx
from quire.operators import patterns

FIELDS = ("text", "title", "summary", "unit", "section", "purpose")
#: All fields that a page may be searched by; those that a table lacks are left out of its view.
ALL_FIELDS = ("text", "title", "summary", "unit", "section", "outline_summary", "purpose", "glossary", "glossary_refs", "vocabulary", "figures", "activities", "exercises", "notes")


def view(pages: DataFrame, fields: tuple | None = None) -> DataFrame:
    """The folded fields of every page, arrays, maps and structs as JSON: the form in which a library that is searched often should be stored.

    Fields are brought into NFKC first. That step is a Python function, which is handed only the values that NFKC may change.
    """
    kinds = dict(pages.dtypes)
    text = lambda f: F.col(f) if kinds[f] == "string" else F.to_json(f) if kinds[f].startswith(("array", "map", "struct")) else F.col(f).cast("string")
    return pages.select("book_id", "physical_page", *(arabic.fold_nfkc(text(f)).alias(f) for f in fields or [f for f in ALL_FIELDS if f in kinds]))


def allowed(subject: str = "", track: str = "") -> Column:
    """Whether a book's subject or title holds ``subject`` and its track equals ``track``, folded; empty: no filter."""
    fold = lambda s: tx.fold(F.lit(s))
    ok = F.lit(True)
    if subject:
        ok &= tx.fold(F.concat_ws(" ", "subject", "title")).contains(fold(subject))
    if track:
        ok &= tx.fold(F.coalesce(F.expr("nullif(track, '')"), F.lit("general"))) == fold(track)
    return ok


def tracked(track: str) -> Column:
    """Whether a book is of the track, folded, and no supplementary one; a book without track is of the general one. books: track, supplementary."""
    return (tx.fold(F.coalesce(F.expr("nullif(track, '')"), F.lit("general"))) == F.lit(tx.fold_query(track))) & ~F.coalesce("supplementary", F.lit(False))


def terms_of(query: str, match: str) -> list[str]:
    """The query, folded as the fields are, as one phrase or its words."""
    folded = tx.fold_query(query)
    return [w for w in ([folded] if match == "phrase" else folded.split()) if w]


def search(pages_view: DataFrame, books: DataFrame, query: str, match: str = "any", book_id: str = "", subject: str = "", track: str = "", fields: tuple | None = None) -> DataFrame:
    """(book_id, physical_page, matched_terms, matched_in) of every page where any, all or the phrase of the terms occur.

    A term matches a field by containment. An unknown ``match`` behaves as any; a blank query finds nothing. matched_terms keeps
    the query's order and repeats, matched_in lists each field once in order of first match.
    """
    terms = terms_of(query, match)
    fields = fields or [f for f in ALL_FIELDS if f in pages_view.columns]
    rows = pages_view.where(F.col("book_id") == book_id) if book_id else pages_view
    if subject or track:
        rows = rows.join(books.where(allowed(subject, track)).select("book_id"), "book_id", "left_semi")
    if not terms:
        return rows.limit(0).select("book_id", "physical_page", F.array().cast("array<string>").alias("matched_terms"), F.array().cast("array<string>").alias("matched_in"))
    in_any = [F.coalesce(F.greatest(*(F.col(f).contains(t).cast("int") for f in fields)), F.lit(0)) > 0 if len(fields) > 1 else F.col(fields[0]).contains(t) for t in terms]
    hit = in_any[0]
    for c in in_any[1:]:
        hit = hit & c if match == "all" else hit | c
    found = F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in zip(in_any, terms, strict=True))))
    where = F.array_distinct(F.array_compact(F.array(*(F.when(F.col(f).contains(t), F.lit(f)) for t in terms for f in fields))))
    return rows.where(hit).select("book_id", "physical_page", found.alias("matched_terms"), where.alias("matched_in"))


def asked(pages_view: DataFrame, books: DataFrame, query: str | None, **options) -> DataFrame:
    """``search`` for callers that must hear of a blank query: ValueError EMPTY_QUERY."""
    if not (query or "").strip():
        raise ValueError("EMPTY_QUERY")
    return search(pages_view, books, query, **options)


def window(hits: DataFrame, offset: int = 0, limit: int = 8) -> DataFrame:
    """One page of hits in order of book and page; offsets below 0 and limits below 1 are raised."""
    return hits.orderBy("book_id", "physical_page").offset(max(0, offset)).limit(max(1, limit))


def paged(hits: DataFrame, offset: int = 0, limit: int = 8) -> DataFrame:
    """``window`` with total and next_offset (null at the end); the total is an aggregate of one row, so nothing is sorted for it."""
    offset, limit = max(0, offset), max(1, limit)
    total = hits.agg(F.count("*").alias("total"))
    following = F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit))
    return window(hits, offset, limit).join(F.broadcast(total)).withColumn("next_offset", following)  # total is one row


def batch(pages: DataFrame, queries: DataFrame, key: str, query: str, text: str = "text", page_key: str = "doc_id") -> DataFrame:
    """(page_key, key) for every page whose text holds the query's as a substring; all queries are looked for in one pass over the pages.

    The empty query matches every page with a text. Equal queries have a row each.
    """
    asked = queries.select(F.col(key).alias("_q"), F.col(query).alias("_text"))
    found = patterns.contained(pages.select(F.col(page_key).alias("_p"), F.col(text).alias("_body")), asked, "_body", "_text")
    return found.join(asked, "_text").select(F.col("_p").alias(page_key), F.col("_q").alias(key)).distinct()
