"""Page audit and retrieval probes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.numbering import numbered

_PLACEHOLDER = "(?i)^(untitled|no title|page|continued)\\b"
_JUNK = "(?i)(\\.indb|undefined|null null|\\[object)"


def meta_problems(title: Column, summary: Column) -> Column:
    """Codes of weak, placeholder and junk descriptions."""
    t, s = tx.strip(F.coalesce(title, F.lit(""))), tx.strip(F.coalesce(summary, F.lit("")))
    return F.array_compact(
        F.array(
            F.when(F.length(t) < 4, "WEAK_TITLE").when(t.rlike(_PLACEHOLDER), "PLACEHOLDER_TITLE"), F.when(F.length(s) < 40, "WEAK_SUMMARY").when(s.rlike(_PLACEHOLDER), "PLACEHOLDER_SUMMARY"),
            F.when(F.concat_ws(" ", t, s).rlike(_JUNK), "JUNK_META"), F.when((t == s) & (t != ""), "TITLE_EQUALS_SUMMARY"),
        )
    )


KEYS = ["book_id", "physical_page"]


def issues(pages: DataFrame, index: DataFrame, bridge: DataFrame, outlines: DataFrame, short: int = 40, weak: int = 20) -> DataFrame:
    """(book_id, physical_page, code): one row per issue of books, pages and their rows in two derived layers; a book's own issues bear page 0.

    pages: keys, text, title, summary, searchable, needs_ocr, ocr_status. bridge: the pages' copy, keys, text, title and
    summary. index: keys, title, summary, searchable, preview, n_terms. outlines: book_id, entries.
    """
    t = tx.strip(F.coalesce("text", F.lit("")))
    line, title, summary = tx.flat(t), tx.flat(F.coalesce("title", F.lit(""))), tx.flat(F.coalesce("summary", F.lit("")))
    copied = lambda c: (F.length(line) >= short) & (c != "") & line.startswith(F.substring(c, 1, 60))
    held = pages.select(
        *KEYS, "title", "summary", "searchable", "text", t.alias("t"), F.length(t).alias("n"), copied(summary).alias("dump_summary"), copied(title).alias("dump_title"),
        F.coalesce("needs_ocr", F.lit(False)).alias("flag"), (F.coalesce("ocr_status", F.lit("")) == "").alias("unread"),
    )
    copy = bridge.select(*KEYS, F.lit(True).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in ("text", "title", "summary")))
    doc = index.select(*KEYS, F.lit(True).alias("_d"), *(F.col(c).alias(f"_d_{c}") for c in ("title", "summary", "searchable", "preview", "n_terms")))
    both = held.join(copy, KEYS, "left").join(doc, KEYS, "left")
    stale = ~(F.col("_b_text").eqNullSafe(F.col("text")) & F.col("_b_title").eqNullSafe(F.col("title")) & F.col("_b_summary").eqNullSafe(F.col("summary")))
    found, full = F.col("_d").isNotNull(), F.col("n") >= short
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    codes = {
        "NO_TEXT": ~full & F.col("flag"), "NO_TEXT_BUT_NOT_FLAGGED": ~full & ~F.col("flag"), "SEARCHABLE_FLAG_MISMATCH": F.col("searchable") != (F.col("n") > 0), "NEEDSOCR_FLAG_STALE": full & F.col("flag"),
        "OCR_STATUS_MISSING": ~F.col("flag") & F.col("unread"), "DUMP_SUMMARY": F.col("dump_summary"), "DUMP_TITLE": F.col("dump_title"),
        "INDEX_PAGE_MISSING": F.col("_b").isNull(), "INDEX_PAGE_STALE": F.col("_b").isNotNull() & stale, "SEARCH_DOC_MISSING": ~found,
        "SEARCH_DOC_WEAK_META": found & ((size("_d_title") <= 2) | (size("_d_summary") < weak)), "SEARCH_DOC_FLAG_MISMATCH": found & (F.col("_d_searchable") != (F.col("n") > 0)),
        "SEARCH_DOC_EMPTY_PREVIEW": found & full & (tx.strip(F.coalesce("_d_preview", F.lit(""))) == ""), "SEARCH_DOC_NO_TERMS": found & full & (F.coalesce("_d_n_terms", F.lit(0)) == 0),
    }
    own = both.select(*KEYS, F.explode(F.concat(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in codes.items()))), meta_problems(F.col("title"), F.col("summary")))).alias("code"))
    one = lambda rows, code, page=F.col("physical_page"): rows.select("book_id", page.cast("int").alias("physical_page"), F.lit(code).alias("code"))
    counts = pages.groupBy("book_id").agg(F.count("*").alias("pages"))
    drawn = counts.join(outlines.select("book_id", "entries"), "book_id", "left")
    zero = F.lit(0)
    parts = [
        own, one(counts.join(bridge.select("book_id").distinct(), "book_id", "left_anti"), "INDEX_BOOK_MISSING", zero), one(drawn.where("coalesce(entries, 0) <> pages"), "OUTLINE_COUNT_MISMATCH", zero),
        one(pages.join(outlines.where("entries > 0").select("book_id"), "book_id", "left_anti"), "OUTLINE_FILE_MISSING"), one(index.join(pages.select(*KEYS), KEYS, "left_anti"), "SEARCH_DOC_ORPHAN"),
    ]
    for column, code, more in (("summary", "DUP_SUMMARY_SAME_BOOK", 1), ("title", "DUP_TITLE_SAME_BOOK", 3)):
        folded = pages.select(*KEYS, tx.flat(F.coalesce(column, F.lit(""))).alias("v")).where("v <> ''")
        often = folded.groupBy("book_id", "v").agg(F.count("*").alias("k")).where(F.col("k") > more)
        parts.append(one(folded.join(often, ["book_id", "v"]), code))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Counters of an audit: the codes that each of them counts.
COUNTERS = {
    "no_text": ("NO_TEXT", "NO_TEXT_BUT_NOT_FLAGGED"), "placeholders": ("PLACEHOLDER_TITLE", "PLACEHOLDER_SUMMARY"), "weak_summaries": ("WEAK_SUMMARY", "PLACEHOLDER_SUMMARY"), "weak_titles": ("WEAK_TITLE", "PLACEHOLDER_TITLE"),
    "junk_meta": ("JUNK_META",), "dump_titles": ("DUMP_TITLE",), "dump_summaries": ("DUMP_SUMMARY",), "flag_mismatches": ("SEARCHABLE_FLAG_MISMATCH", "NEEDSOCR_FLAG_STALE"), "dup_summaries": ("DUP_SUMMARY_SAME_BOOK",),
    "dup_titles": ("DUP_TITLE_SAME_BOOK",), "index_mismatches": ("INDEX_PAGE_STALE",), "missing_docs": ("SEARCH_DOC_MISSING",), "weak_docs": ("SEARCH_DOC_WEAK_META",), "missing_outlines": ("OUTLINE_FILE_MISSING",),
}


def audit_statistics(pages: DataFrame, found: DataFrame, short: int = 40) -> DataFrame:
    """One row: books, pages, searchable, vision, and the ``COUNTERS`` of the issues found."""
    size = pages.agg(F.countDistinct("book_id").alias("books"), F.count("*").alias("pages"), F.count_if(F.length(tx.strip(F.col("text"))) >= short).alias("searchable"), F.count_if("needs_ocr").alias("vision"))
    counts = found.agg(*(F.count_if(F.col("code").isin(*codes)).alias(n) for n, codes in COUNTERS.items()))
    return size.join(F.broadcast(counts))  # one row each


def rollup(found: DataFrame) -> DataFrame:
    """(code, book_id, n): issues by code and book, with each code's total under a null book and the grand total under null code."""
    return found.rollup("code", "book_id").agg(F.count("*").alias("n"))


def probe_positions(pages: DataFrame, least_pages: int = 12, least_text: int = 260) -> DataFrame:
    """(book_id, physical_page, position, page_total): pages at fixed shares of each book's long pages; a page is taken once."""
    long = pages.where(F.length("text") >= least_text)
    n = long.groupBy("book_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    ranked = numbered(long.select("book_id", "physical_page"), "book_id", "physical_page", name="at").withColumn("at", F.col("at") - 1).join(n, "book_id")
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("position"), w.alias("at")) for i, (p, w) in enumerate((("late", F.floor(F.col("n") * 0.72)), ("middle", F.floor(F.col("n") * 0.5)), ("last", F.col("n") - 1), ("deep", F.floor(F.col("n") * 0.88))))))
    hit = ranked.withColumn("w", F.array_min(F.filter(wanted, lambda x: x["at"] == F.col("at")))).where("w is not null")
    return hit.select("book_id", "physical_page", F.col("w.position").alias("position"), F.col("n").alias("page_total"))


# fixed values: damaged forms of words; a sentence that has one measures the damage, not the search
SUSPECT = "اال|هللا|االق|واال|حلل|االقتصاد"


def fact_sentence(text: Column, least: int = 60, most: int = 320, page: int = 260, letters: int = 5) -> Column:
    """The sentence with the most distinct long words, and up to 3 points for its length, the first of equals.

    Sentences end in a sentence mark or a line end, and have ``least`` to ``most`` characters; those with damaged signs or
    words, or with fewer than two long words, don't count. Null for texts of less than ``page`` characters and without such a sentence.
    """
    parts = F.split(F.coalesce(text, F.lit("")), "\\n+|(?<=[.!؟?؛;])[ \\t]+")
    good = F.filter(F.transform(parts, tx.flat), lambda s: F.length(s).between(least, most) & ~s.rlike(f"\ufffd|{tx.PRIVATE}"))
    terms = F.transform(good, lambda s, i: F.struct(F.array_distinct(F.filter(F.split(tx.word_fold(s), " "), lambda w: F.length(w) >= letters)).alias("w"), i.alias("at"), s.alias("s")))
    fit = F.filter(terms, lambda x: (F.size(x["w"]) >= 2) & ~F.exists(x["w"], lambda w: w.rlike(SUSPECT)))
    points = F.transform(fit, lambda x: F.struct((-F.size(x["w"]) - F.least(F.lit(3), F.floor(F.length(x["s"]) / 110))).alias("minus"), x["at"].alias("at"), x["s"].alias("s")))
    return F.when(F.length(text) >= page, F.array_min(points)["s"])


def probe_hits(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """(case_id, reached): whether any citation of the case has its book and its physical or printed page."""
    both = cases.alias("c").join(citations.alias("r"), "case_id", "left")
    same = (F.col("c.book_id") == F.col("r.book_id")) & ((F.col("c.physical_page") == F.col("r.physical_page")) | (F.col("c.printed_page") == F.col("r.printed_page")))
    return both.groupBy("case_id").agg(F.coalesce(F.bool_or(same), F.lit(False)).alias("reached"))


def probe_summary(results: DataFrame, share: float = 0.99) -> DataFrame:
    return results.agg(F.count("*").alias("cases"), F.count_if("reached").alias("reached"), F.count_if(F.col("term_hit_ratio") >= share).alias("all_terms"))
