"""Queries over stored layouts: the incremental index and the pages behind shard pointers; they join those of ``library``."""

from pyspark.sql import functions as F

from quire.operators import incremental, inverted
from quire.plans import corpus
from quire.plans import sqltext as s
from quire.plans.library import R, _EVIDENCE, _evidence, _terms
from quire.sources import shards, tables

_STALE = ("src2", "src5", "src7")


def _changed(p):
    """The library after a change of three books: pages gone, texts longer, and one book without pages."""
    d, book = F.col("doc_id"), F.col("book_id")
    kept = p.where(~(book.eqNullSafe("src2") & (d % 2 == 0)) & ~book.eqNullSafe("src7"))
    return kept.withColumn("text", F.when(book == "src5", F.concat("text", F.lit(" freshly added words of "), "book_id")).otherwise(F.col("text")))


_NOW = f", n AS (SELECT * REPLACE (CASE WHEN book_id = 'src5' THEN text || ' freshly added words of ' || book_id ELSE text END AS text) FROM p WHERE NOT (book_id = 'src2' AND doc_id % 2 = 0) AND book_id <> 'src7'), t AS (SELECT DISTINCT book_id, doc_id, unnest({s.tokens('text')}) AS term FROM n)"


def _refreshed(spark, sf) -> str:
    """An index of the library, built and then refreshed for the stale books alone; its folder."""
    path = f"{tables.shared_folder(spark)}/index"
    p = corpus.pages(spark, sf)
    incremental.build(p.select("book_id", "doc_id", "text"), _terms(), path)
    stale = corpus.books(p).where(F.col("book_id").isin(*_STALE)).select("book_id")
    incremental.refresh(_changed(p).select("book_id", "doc_id", "text"), stale, _terms(), path)
    return path


@R.add(_NOW + ", f AS (SELECT term, count(*) AS df FROM t GROUP BY term) SELECT term, df, CAST(sum(df) OVER (ORDER BY term ROWS UNBOUNDED PRECEDING) - df AS BIGINT) AS start FROM f")
def idx_refreshed_offsets(spark, sf):
    return incremental.offsets(spark, _refreshed(spark, sf))


@R.add(_NOW + " SELECT book_id, term, doc_id FROM t")
def idx_refreshed_postings(spark, sf):
    return incremental.postings(spark, _refreshed(spark, sf)).select("book_id", "term", "doc_id")


@R.add(_NOW.replace(", n AS", f", o AS (SELECT DISTINCT doc_id, unnest({s.tokens('text')}) AS term FROM p), n AS") + ", c AS (SELECT term, count(*) AS k FROM t GROUP BY term), e AS (SELECT term, count(*) AS k FROM o GROUP BY term) SELECT coalesce(c.term, e.term) AS term, coalesce(c.k, 0) - coalesce(e.k, 0) AS change FROM c FULL JOIN e ON c.term = e.term WHERE coalesce(c.k, 0) <> coalesce(e.k, 0)")
def idx_deltas(spark, sf):
    p = corpus.pages(spark, sf)
    stale = F.col("book_id").isin(*_STALE)
    terms = lambda rows: inverted.distinct_terms(rows.where(stale), _terms(), "doc_id")
    return incremental.deltas(terms(p), terms(_changed(p)))


_SLIM = ["printed_page", "title", "summary", "section", "unit", "page_type", "purpose", "searchable", "needs_ocr", "text_length", "evidence_status"]


def _shards(spark, sf) -> str:
    """The library behind shard pointers, of 16 pages each; written once."""
    key = ("shards", spark.sparkContext.applicationId, sf, str(tables.stamp(spark, f"{sf}/documents.parquet")))
    if key not in _folders or not tables.is_there(spark, f"{_folders[key]}/docs/_SUCCESS"):
        path = f"{tables.shared_folder(spark)}/shards"
        shards.write(corpus.pages(spark, sf).withColumn("evidence_status", _evidence()), path, _SLIM, 16)
        _folders[key] = path
    return _folders[key]


_folders: dict[tuple, str] = {}
_PLACES = f", e AS (SELECT *, {_EVIDENCE}, CAST(row_number() OVER (ORDER BY book_id, physical_page) - 1 AS BIGINT) AS pos FROM p)"


@R.add(_PLACES + f" SELECT book_id, physical_page, {', '.join(_SLIM)}, CAST(pos // 16 AS INTEGER) AS shard, CAST(pos % 16 AS INTEGER) AS shard_offset FROM e")
def shard_meta(spark, sf):
    return shards.pointers(spark, _shards(spark, sf))


@R.add(_PLACES + " SELECT book_id, physical_page, doc_id, text, evidence_status, CAST(pos // 16 AS INTEGER) AS shard FROM e WHERE book_id = 'src3' AND physical_page = 5")
def shard_page_point(spark, sf):
    return shards.page(spark, _shards(spark, sf), "src3", 5).select("book_id", "physical_page", "doc_id", "text", "evidence_status", "shard")


@R.add(_PLACES + " SELECT book_id, physical_page, text FROM e WHERE searchable AND title LIKE '%and%' AND book_id IN ('src1', 'src4')")
def shard_pages_by_meta(spark, sf):
    """Whole pages that the slim table alone chooses."""
    path = _shards(spark, sf)
    wanted = shards.pointers(spark, path).where(F.col("searchable") & F.contains("title", F.lit("and")) & F.col("book_id").isin("src1", "src4"))
    return shards.read(spark, path, wanted).select("book_id", "physical_page", "text")
