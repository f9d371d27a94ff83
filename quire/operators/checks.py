"""The registered data-quality checks: each turns a measure into findings (book_id, code, severity).

A severity is null where nothing is wrong, and such rows are dropped. Library-wide checks bear the book_id ``library``.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import consistency, duplicates, quality

LIBRARY = "library"
#: Names of units that all books use.
GENERIC_UNIT = "(?i)^(ال)?(فصل|وحدة|درس|باب|مبحث|قسم|lesson|unit|chapter|part|section|introduction|contents)[ ]*([0-9]+|ال[^ ]+)?$"


def found(rows: DataFrame, code: str, *severities: Column) -> DataFrame:
    """One finding for each severity that isn't null."""
    each = rows.select("book_id", F.explode(F.array_compact(F.array(*severities))).alias("severity"))
    return each.select("book_id", F.lit(code).alias("code"), "severity")


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book_id").agg(F.count("*").alias("n"))


def a1_presence(source: DataFrame, index: DataFrame, books: DataFrame) -> DataFrame:
    """Missing pages and pages beyond the source: high; fewer pages than the source: medium; another declared count: low."""
    kept = source.select("book_id", "physical_page", F.lit(1).alias("s")).join(index.select("book_id", "physical_page", F.lit(1).alias("i")), ["book_id", "physical_page"], "full_outer")
    n = kept.groupBy("book_id").agg(F.count("s").alias("source"), F.count("i").alias("index"), F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("beyond"))
    both = n.join(books.select("book_id", "declared_count"), "book_id", "left")
    return found(both, "A1", F.when(F.col("missing") > 0, "high"), F.when(F.col("beyond") > 0, "high"), F.when(F.col("source") > F.col("index"), "medium"), F.when((F.col("source") > 0) & (F.col("declared_count") != F.col("source")), "low"))


def a2_lost(source: DataFrame, index: DataFrame) -> DataFrame:
    return found(counted(consistency.lost_text(source, index)), "A2", F.lit("critical"))


def a3_cut(source: DataFrame, index: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """Lost lines: high above 15 % of the expected text, medium above 5 %, else low."""
    share = F.col("share")
    return found(consistency.losses(source, index, sized=sized).where("pages > 0"), "A3", F.when(share > 0.15, "high").when(share > 0.05, "medium").otherwise("low"))


def a4_corrupt(index: DataFrame) -> DataFrame:
    """Replacement and private characters, broken names: high each; Persian letters, and over 2 % out of range: medium each."""
    grave = [F.when(F.col(c) > 0, "high") for c in ("replacement", "private", "broken_names")]
    return found(quality.corruption(index), "A4", *grave, F.when(F.col("persian") > 0, "medium"), F.when(F.col("out_of_range") > 0.02 * F.col("characters"), "medium"))


def a5_repeated(index: DataFrame) -> DataFrame:
    """A peak above 10 % or a mean above 5 %: medium; above 20 % or 15 %: high."""
    return a5_of(quality.inner_duplication(index))


def a5_of(repeats: DataFrame) -> DataFrame:
    peak, mean = F.col("peak_share"), F.col("mean_share")
    return found(repeats, "A5", F.when((peak > 0.2) | (mean > 0.15), "high").when((peak > 0.1) | (mean > 0.05), "medium"))


def a6_math(index: DataFrame) -> DataFrame:
    share = F.col("share")
    return found(quality.broken_math(index).where("pages > 0"), "A6", F.when(share > 0.3, "high").when(share > 0.1, "medium").otherwise("low"))


def a7_no_text(index: DataFrame) -> DataFrame:
    return found(quality.no_text(index).where("empty > 0"), "A7", F.when((F.col("share") > 0.1) | (F.col("described") > 0), "high").otherwise("medium"))


def a8_status(index: DataFrame, expected: Column, known: tuple) -> DataFrame:
    """Statuses that are no known one, or not what text and source say: high; medium if all are missing and none differs. index: status."""
    missing = ~F.coalesce(F.col("status").isin(*known), F.lit(False))
    n = index.groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if(missing).alias("missing"), F.count_if(~missing & (F.col("status") != expected)).alias("differing"))
    return found(n.where("missing + differing > 0"), "A8", F.when((F.col("missing") == F.col("pages")) & (F.col("differing") == 0), "medium").otherwise("high"))


def b7_leaks(index: DataFrame, fields: list[str]) -> DataFrame:
    n = quality.leaks(index, fields).groupBy("book_id").agg(F.count_if(F.col("leak") == "json").alias("json"))
    return found(n, "B7", F.when(F.col("json") > 0, "critical").otherwise("high"))


def b8_numbers(verdicts: DataFrame) -> DataFrame:
    return found(counted(verdicts.where(F.col("verdict").isin("unverified", "layerless"))), "B8", F.lit("high"))


def b9_types(index: DataFrame, known: tuple) -> DataFrame:
    bad = (F.coalesce(F.col("page_type"), F.lit("")) != "") & ~F.col("page_type").isin(*known)
    n = index.groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if(bad).alias("bad"))
    return found(n.where("bad > 0"), "B9", F.when(F.col("bad") > 0.2 * F.col("pages"), "high").otherwise("medium"))


def b10_misattributed(index: DataFrame, books: DataFrame, fields: list[str], catalog: DataFrame, materials: DataFrame) -> DataFrame:
    """Fields that claim to be of another book: medium, above five of them high; an empty catalogue: high, and books that the materials lack: medium, for the library.

    books: book_id, title; catalog and materials: book_id.
    """
    own = found(counted(quality.claims(index, books.select("book_id", F.col("title").alias("name")), fields)), "B10", F.when(F.col("n") > 5, "high").otherwise("medium"))
    library = lambda n: n.select(F.lit(LIBRARY).alias("book_id"), "n")
    empty = library(catalog.agg(F.count("*").alias("n")))
    gap = library(books.join(materials, "book_id", "left_anti").agg(F.count("*").alias("n")))
    return own.unionByName(found(empty, "B10", F.when(F.col("n") == 0, "high"))).unionByName(found(gap, "B10", F.when(F.col("n") > 0, "medium")))


def b11_unquotable(index: DataFrame, quoted: str) -> DataFrame:
    """Books whose id matches ``quoted`` and that hold pages with replacement or private characters."""
    bad = index.where(F.col("book_id").rlike(quoted) & F.col("text").rlike(f"\ufffd|{tx.PRIVATE}"))
    return found(counted(bad), "B11", F.lit("critical"))


def b14_drifted(index: DataFrame) -> DataFrame:
    return found(counted(duplicates.drifted(index)), "B14", F.lit("medium"))


def c12_boilerplate(index: DataFrame, fields: list[str]) -> DataFrame:
    """The worst share of a field's commonest value: medium above 50 %, high above 90 %."""
    shares = quality.duplicate_share(index, fields[0])
    for f in fields[1:]:
        shares = shares.unionByName(quality.duplicate_share(index, f))
    worst = shares.groupBy("book_id").agg(F.max(F.col("most") / F.col("filled")).alias("share"))
    return found(worst, "C12", F.when(F.col("share") > 0.9, "high").when(F.col("share") > 0.5, "medium"))


def c13_coverage(index: DataFrame) -> DataFrame:
    return c13_of(quality.summary_coverage(index.where(F.length("text") >= 20)))


def c13_of(coverage: DataFrame) -> DataFrame:
    median = F.col("median_coverage")
    return found(coverage, "C13", F.when(median < 0.015, "high").when(median < 0.03, "medium"))


def c14_purpose(index: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """The commonest purpose above 90 %: high; empty purposes above 20 %: medium. measured: book_id, pages, purpose_empty, where they are known."""
    shares = quality.duplicate_share(index, "purpose").select("book_id", (F.col("most") / F.col("filled")).alias("same"))
    rows = (quality.field_quality(index) if measured is None else measured).join(shares, "book_id", "left")
    return found(rows, "C14", F.when(F.col("same") > 0.9, "high").when(F.col("purpose_empty") > 0.2 * F.col("pages"), "medium"))


def c15_units(index: DataFrame, generic: str = GENERIC_UNIT, measured: DataFrame | None = None) -> DataFrame:
    """Units of other books: high; empty units above 30 %: medium. measured: book_id, pages, unit_empty, where they are known."""
    foreign = counted(quality.foreign_units(index, generic=generic))
    rows = (quality.field_quality(index) if measured is None else measured).join(foreign, "book_id", "left")
    return found(rows, "C15", F.when(F.col("n") > 0, "high").when(F.col("unit_empty") > 0.3 * F.col("pages"), "medium"))


def c16_section(index: DataFrame) -> DataFrame:
    return found(quality.field_quality(index).where("section_distinct <= 1 and pages > 1"), "C16", F.when(F.col("pages") > 50, "high").otherwise("medium"))


def c21_book_title(index: DataFrame, books: DataFrame) -> DataFrame:
    rows = quality.title_repetition(index, books).join(counted(index), "book_id").where("as_book_title > 0")
    return found(rows, "C21", F.when(F.col("as_book_title") > 0.3 * F.col("n"), "high").otherwise("medium"))


def d17_guessed(source: DataFrame, index: DataFrame, rules: DataFrame) -> DataFrame:
    return found(counted(consistency.guessed_pages(source, index, rules)), "D17", F.lit("high"))


def d18_stale(layers: DataFrame, outline: DataFrame, index: DataFrame) -> DataFrame:
    """Layers (book_id, layer, hours older than the index): medium; outlines that deny a page's text: high."""
    old = found(counted(layers.where("hours > 0")), "D18", F.lit("medium"))
    return old.unionByName(found(counted(consistency.contradicted(outline, index)), "D18", F.lit("high")))


def d19_structured(totals: DataFrame, enriched: DataFrame) -> DataFrame:
    """No enrichment, and arrays that are empty all through a book: medium each; enrichment that not all books have: medium for the library.

    totals: book_id, zeroed; enriched: book_id.
    """
    marked = totals.join(enriched.select("book_id", F.lit(1).alias("has")).distinct(), "book_id", "left")
    own = found(marked, "D19", F.when(F.col("has").isNull(), "medium"), F.when(F.col("zeroed") != "", "medium"))
    some = marked.agg(F.count_if(F.col("has").isNull()).alias("n")).select(F.lit(LIBRARY).alias("book_id"), "n")
    return own.unionByName(found(some, "D19", F.when(F.col("n") > 0, "medium")))


def d20_checksum(books: DataFrame, digests: DataFrame) -> DataFrame:
    return found(consistency.checksum_findings(books, digests), "D20", F.col("severity"))


def d21_dead(layers: DataFrame, readers: DataFrame) -> DataFrame:
    return found(consistency.dead_layers(layers, readers).select(F.lit(LIBRARY).alias("book_id")), "D21", F.lit("high"))


def d22_duplicated(index: DataFrame, least: int = 3) -> DataFrame:
    return d22_of(duplicates.cross_book_pairs(index, least))


def d22_of(pairs: DataFrame) -> DataFrame:
    return found(pairs.select(F.lit(LIBRARY).alias("book_id")), "D22", F.lit("medium"))


#: The checks whose findings ``of_measures`` reads from one row per book.
MEASURED = ("A4", "A6", "A7", "A8", "B7", "B9", "B11", "C16")


def marks(index: DataFrame, expected: Column, statuses: tuple, types: tuple, quoted: str, fields: list[str]) -> DataFrame:
    """One narrow row per page with all that the ``MEASURED`` checks, A5, C13 and D18 see in it: the one pass over the texts."""
    status, text, far = F.col("status"), F.col("text"), F.col("far")
    blank = lambda c: tx.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    seen = lambda pattern: F.regexp_count("far", F.lit(pattern))
    rows = index.withColumns({"far": tx.beyond_ascii(text), "expected": expected, "bare": F.length(tx.strip(text)), "missing": ~F.coalesce(status.isin(*statuses), F.lit(False))})
    json = [F.coalesce(F.col(f).rlike(tx.SERIALISED), F.lit(False)) for f in fields]
    other = [F.coalesce(F.col(f).rlike(tx.CJK) | F.col(f).rlike(tx.HEBREW), F.lit(False)) for f in fields]
    some = lambda holds: reduce(lambda a, b: a | b, holds)
    return rows.select(
        "book_id", "physical_page", "doc_id", "bare", F.length("text").alias("characters"), seen("\ufffd").alias("replacement"), seen(tx.PRIVATE).alias("private"), quality.broken_names(text, far).alias("broken_names"), seen("[پچژگکی]").alias("persian"), seen(tx.OUT_OF_RANGE).alias("out_of_range"),
        quality.has_broken_math(text).alias("math"), (F.col("bare") == 0).alias("empty"), ((F.col("bare") == 0) & (tx.strip(F.concat_ws("", "title", "summary")) != "")).alias("described"),
        "missing", (~F.col("missing") & (status != F.col("expected"))).alias("differing"), some(json).alias("json"), some(other).alias("foreign_script"),
        ((F.coalesce(F.col("page_type"), F.lit("")) != "") & ~F.col("page_type").isin(*types)).alias("odd_type"), (F.col("book_id").rlike(quoted) & far.rlike(f"\ufffd|{tx.PRIVATE}")).alias("unquotable"),
        "section", blank("purpose").alias("purpose_empty"), blank("unit").alias("unit_empty"), quality.repeated_share(text).alias("repeated"), F.length("summary").alias("summary"),
    )


def measures(marked: DataFrame) -> DataFrame:
    """One row per book with all that the ``MEASURED`` checks count. marked: what ``marks`` gives."""
    told = {"replacement": "replacement", "private": "private", "broken_names": "broken_names", "persian": "persian", "out_of_range": "out_of_range", "characters": "characters"}
    counted = {"math": "math", "empty": "empty", "described": "described", "missing": "status_missing", "differing": "status_differing", "json": "json", "foreign_script": "foreign_script", "odd_type": "odd_types", "unquotable": "unquotable", "purpose_empty": "purpose_empty", "unit_empty": "unit_empty"}
    return marked.groupBy("book_id").agg(
        F.count("*").alias("pages"), *(F.sum(c).alias(n) for c, n in told.items()), *(F.count_if(F.col(c)).alias(n) for c, n in counted.items()), F.min("section").alias("first_section"), F.max("section").alias("last_section"),
    )


def of_measures(measured: DataFrame) -> DataFrame:
    """The findings of the ``MEASURED`` checks; the same as those of each by itself."""
    n = F.col
    share = lambda c, digits=2: tx.round_half_up(n(c) / n("pages"), digits)
    told = (
        ("A4", F.when(n("replacement") > 0, "high")), ("A4", F.when(n("private") > 0, "high")), ("A4", F.when(n("broken_names") > 0, "high")), ("A4", F.when(n("persian") > 0, "medium")), ("A4", F.when(n("out_of_range") > 0.02 * n("characters"), "medium")),
        ("A6", F.when(n("math") > 0, F.when(share("math", 4) > 0.3, "high").when(share("math", 4) > 0.1, "medium").otherwise("low"))), ("A7", F.when(n("empty") > 0, F.when((share("empty") > 0.1) | (n("described") > 0), "high").otherwise("medium"))),
        ("A8", F.when(n("status_missing") + n("status_differing") > 0, F.when((n("status_missing") == n("pages")) & (n("status_differing") == 0), "medium").otherwise("high"))),
        ("B7", F.when(n("json") > 0, "critical").when(n("foreign_script") > 0, "high")), ("B9", F.when(n("odd_types") > 0, F.when(n("odd_types") > 0.2 * n("pages"), "high").otherwise("medium"))), ("B11", F.when(n("unquotable") > 0, "critical")),
        ("C16", F.when(n("first_section").eqNullSafe(n("last_section")) & (n("pages") > 1), F.when(n("pages") > 50, "high").otherwise("medium"))),
    )
    each = F.explode(F.array(*(F.struct(F.lit(code).alias("code"), severity.alias("severity")) for code, severity in told))).alias("f")
    return measured.select("book_id", each).select("book_id", "f.code", "f.severity").where("severity is not null")
