"""Data-quality checks over pages: each returns findings or measures per book; findings roll up into scores and a gate."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import patterns
from quire.operators.numbering import upper_medians

# fixed values: penalty of a finding, share of the points of a check
WEIGHTS = {"critical": 12.0, "high": 6.0, "medium": 2.5, "low": 1.0}
# fixed values: broken forms of one word, and what broken brackets, roots and exponents look like
BROKEN_NAMES = "هللا|هلالا|األله|األه|للهل|الهل|باهلل|اهلل"
BROKEN_MATH = (
    "[0-9٠-٩۰-۹]\\s+[0-9]{1,3}\\s*\\+\\s*[0-9]{1,3}\\s*[\\[(]?\\s*√|\\b[a-zA-Z]\\s*\\^\\s*[0-9]|√\\s*\\]\\s*[0-9]"
    "|[0-9٠-٩۰-۹]\\s*\\^\\s*[0-9٠-٩۰-۹]\\s*\\]|[\\])]\\s*[^\\n]{0,6}?[0-9]{1,3}\\s*[\\[(]"
)


def broken_names(text: Column, far: Column) -> Column:
    """How many broken names a text holds; looked for where what is beyond ASCII has the letter that all of them share."""
    return F.when(far.contains("ه"), F.regexp_count(text, F.lit(BROKEN_NAMES))).when(text.isNotNull(), 0)


def has_broken_math(text: Column) -> Column:
    """Whether ``BROKEN_MATH`` matches: each of its forms has a root, an exponent, or a closing and an opening bracket."""
    may = text.contains("√") | text.contains("^") | ((text.contains("]") | text.contains(")")) & (text.contains("[") | text.contains("(")))
    return may & text.rlike(BROKEN_MATH)


def corruption(pages: DataFrame, group: str = "book_id") -> DataFrame:
    """Counts of replacement, private, Persian and out-of-range characters and of broken names, and the share of those out of range, per book."""
    n = lambda pattern: F.sum(F.regexp_count("far", F.lit(pattern))).alias
    seen = pages.select(group, "text", tx.beyond_ascii(F.col("text")).alias("far"))
    rows = seen.groupBy(group).agg(n("\ufffd")("replacement"), n(tx.PRIVATE)("private"), n("[پچژگکی]")("persian"), F.sum(broken_names(F.col("text"), F.col("far"))).alias("broken_names"), n(tx.OUT_OF_RANGE)("out_of_range"), F.sum(F.length("text")).alias("characters"))
    return rows.withColumn("share", tx.round_half_up(F.col("out_of_range") / F.greatest("characters", F.lit(1)), 4))


def broken_math(pages: DataFrame, group: str = "book_id") -> DataFrame:
    """(group, hits, pages, share): broken brackets, roots and exponents, the pages that hold some, and their share of all pages."""
    rows = pages.select(group, F.regexp_count("text", F.lit(BROKEN_MATH)).alias("n")).groupBy(group).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.count_if(F.col("n") > 0).alias("pages"), F.count("*").alias("all"))
    return rows.select(group, "hits", "pages", tx.round_half_up(F.col("pages") / F.col("all"), 4).alias("share"))


#: Pieces that a page may repeat: how it is cut, the least length of a piece, how many pieces it needs.
PIECES = {"line": ("\n", 12, 4), "clause": ("[.!؟?\\n،؛;]", 30, 2)}


def repeated_share(text: Column, least: int = 20) -> Column:
    """The share of a text's characters in lines or clauses that it repeats, the greater of both; null if it is short or has too few pieces of both kinds."""
    blanks = tx.SPACE.replace("\\n", "")
    bare = {"line": text, "clause": tx.unmarked(text, "".join(c for c in tx.RULE_SIGNS if c not in ".،؛;"))}
    fold = {"line": tx.strip, "clause": lambda x: F.lower(tx.strip(x))}

    def extra(kind: str) -> Column:
        sign, size, few = PIECES[kind]
        pieces = F.filter(F.transform(F.split(F.regexp_replace(bare[kind], f"{blanks}+", " "), sign), fold[kind]), lambda x: F.length(x) >= size)
        both = lambda p: F.length(F.array_join(p, "")) - F.length(F.array_join(F.array_distinct(p), ""))
        return tx.once(pieces, lambda p: F.when(F.size(p) >= few, both(p)))

    return F.when(F.length(text) >= least, F.greatest(*(extra(kind) for kind in PIECES)) / F.length(text))


def inner_duplication(pages: DataFrame, key: str = "doc_id", group: str = "book_id", least: int = 20) -> DataFrame:
    """(group, mean_share, peak_share, pages_over): share of a page's characters in lines or clauses that it repeats, the greater of both.

    Pages of fewer than ``least`` characters don't count, nor do kinds of pieces of which a page has too few. The mean is over
    pages that repeat something. A page's pieces are compared where it lies, and only those of rows that share a key move.
    """
    return mean_repeats(together(pages.select(group, key, repeated_share(F.col("text"), least).alias("repeated")), pages, key, group, least), group)


def together(shares: DataFrame, pages: DataFrame, key: str = "doc_id", group: str = "book_id", least: int = 20) -> DataFrame:
    """Shares of rows (group, key, repeated) as shares of pages: rows of one group, key and length are one page, for which their pieces are put together."""
    again = shares.groupBy(F.col(group).alias("_g"), F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    if again.isEmpty():
        return shares.select(group, key, "repeated")
    same = F.col(group).eqNullSafe(F.col("_g")) & F.col(key).eqNullSafe(F.col("_k"))
    fold = {"line": tx.flat, "clause": tx.rule_fold}
    cut = F.array(*(F.struct(F.lit(kind).alias("kind"), F.transform(F.split("text", sign), fold[kind]).alias("all"), F.lit(size).alias("size"), F.lit(few).alias("few")) for kind, (sign, size, few) in PIECES.items()))
    kinds = pages.join(again, same, "left_semi").where(F.length("text") >= least).select(group, key, F.length("text").alias("length"), F.explode(cut).alias("k"))
    kept = kinds.select(group, key, "length", "k.kind", "k.few", F.expr("filter(k.all, x -> length(x) >= k.size)").alias("pieces")).where(F.size("pieces") >= F.col("few"))
    counts = kept.select(group, key, "length", "kind", F.explode("pieces").alias("piece")).groupBy(group, key, "length", "kind", "piece").agg(F.count("*").alias("n"))
    met = counts.groupBy(group, key, "length", "kind").agg(F.sum((F.col("n") - 1) * F.length("piece")).alias("extra")).groupBy(group, key).agg(F.max(F.col("extra") / F.col("length")).alias("repeated"))
    return shares.join(again, same, "left_anti").select(group, key, "repeated").unionByName(met)


def mean_repeats(shares: DataFrame, group: str = "book_id") -> DataFrame:
    """``inner_duplication`` of pages whose shares are known. shares: group, repeated."""
    share = F.when(F.col("repeated") > 0, F.col("repeated"))
    some = shares.groupBy(group).agg(F.avg(share).alias("mean"), F.max(share).alias("peak"), F.count_if(share > 0.1).alias("pages_over")).where("peak is not null")
    return some.select(group, tx.round_half_up(F.col("mean"), 4).alias("mean_share"), tx.round_half_up(F.col("peak"), 4).alias("peak_share"), "pages_over")


def leaks(pages: DataFrame, fields: list[str], group: str = "book_id") -> DataFrame:
    """(group, field, leak, n): fields that hold serialised JSON or a foreign script."""
    stacked = pages.select(group, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("f")).select(group, "f.*")
    kind = F.when(F.col("value").rlike(tx.SERIALISED), "json").when(F.col("value").rlike(tx.CJK), "cjk").when(F.col("value").rlike(tx.HEBREW), "hebrew")
    return stacked.withColumn("leak", kind).where("leak is not null").groupBy(group, "field", "leak").agg(F.count("*").alias("n"))


def number_verdicts(pages: DataFrame, fields: list[str], allowed: Column, verified: Column) -> DataFrame:
    """(book_id, physical_page, field, number, verdict) for each distinct number of each field.

    proven: of one digit, a page number or in the text; verified: on the list; structural: after a word for a unit; layerless:
    the page has no text; else unverified.
    """
    rows = pages.select("book_id", "physical_page", "text", allowed.alias("own"), verified.alias("ok"), tx.digit_runs(F.col("text")).alias("proof"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("f"))
    rows = rows.select("*", "f.field", "f.value", F.explode(F.array_distinct(tx.digit_runs(F.col("f.value")))).alias("number"))
    structural = F.col("value").rlike("(?i)(unit|lesson|chapter|part|page|الوحدة|الفصل|الدرس)[ ]*[0-9]")
    verdict = (
        F.when((F.length("number") < 2) | F.array_contains("own", F.col("number")) | F.array_contains("proof", F.col("number")), "proven")
        .when(F.array_contains("ok", F.col("number")), "verified").when(structural, "structural").when(tx.strip(F.col("text")) == "", "layerless").otherwise("unverified")
    )
    return rows.select("book_id", "physical_page", "field", "number", verdict.alias("verdict"))


def outside_enumeration(pages: DataFrame, column: str, known: tuple, group: str = "book_id") -> DataFrame:
    """(group, value, n) of values that are not known."""
    return pages.where(~F.coalesce(F.col(column), F.lit("")).isin(*known)).groupBy(group, F.col(column).alias("value")).agg(F.count("*").alias("n"))


def misattribution(pages: DataFrame, names: DataFrame, fields: list[str]) -> DataFrame:
    """(book_id, physical_page, field, other): fields that name another book; the smallest name of each field.

    Names are single words, so pages meet them by an equal word and not all with all. names: book_id, token.
    """
    words = pages.select("book_id", "physical_page", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.array_distinct(F.split(tx.word_fold(F.col(f)), " ")).alias("words")) for f in fields))).alias("f"))
    rows = words.select("book_id", "physical_page", "f.field", F.explode("f.words").alias("token"))
    hits = rows.join(names.select("token", F.col("book_id").alias("owner")), "token").where("owner <> book_id")
    return hits.groupBy("book_id", "physical_page", "field").agg(F.min("owner").alias("other"))


# fixed values: words that a claim opens with, and the article before a name
CLAIM_OPENERS, ARTICLE = ("كتاب", "ملف"), "ال"


def claims(pages: DataFrame, names: DataFrame, fields: list[str], openers: tuple = CLAIM_OPENERS, article: str = ARTICLE) -> DataFrame:
    """(book_id, physical_page, field, other): fields that claim to be of another book and don't name their own; the smallest id of each field.

    A claim is an opener, a blank and a name of one or more words, with or without the article, in the folded field. Names are
    patterns of one automaton. names: book_id, name; blank names are no names.
    """
    folded = names.select(F.col("book_id").alias("owner"), tx.word_fold(F.col("name")).alias("name")).where("name <> ''")
    claim = F.explode(F.array(*(F.concat(F.lit(f" {o} {a}"), "name", F.lit(" ")) for o in openers for a in ("", article))))
    asked = folded.select("owner", claim.alias("pattern")).unionByName(folded.select("owner", F.concat(F.lit(" "), "name", F.lit(" ")).alias("pattern")).withColumn("own", F.lit(True)), allowMissingColumns=True)
    values = pages.select("book_id", "physical_page", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.concat(F.lit(" "), tx.word_fold(F.coalesce(F.col(f), F.lit(""))), F.lit(" ")).alias("value")) for f in fields))).alias("f"))
    met = patterns.contained(values.select("book_id", "physical_page", "f.field", "f.value"), asked, "value", "pattern").join(asked, "pattern")
    by = met.groupBy("book_id", "physical_page", "field").agg(F.min(F.when(F.col("own").isNull() & (F.col("owner") != F.col("book_id")), F.col("owner"))).alias("other"), F.count_if(F.col("own") & (F.col("owner") == F.col("book_id"))).alias("named"))
    return by.where("other is not null and named = 0").drop("named")


def summary_coverage(pages: DataFrame, thin: float = 0.015) -> DataFrame:
    """(book_id, median_coverage, thin): upper median of summary length over text length, and pages below ``thin``."""
    return coverage(pages.where(F.length("text") > 0).select("book_id", (F.length("summary") / F.length("text")).alias("r")), thin)


def coverage(ratio: DataFrame, thin: float = 0.015) -> DataFrame:
    """``summary_coverage`` of pages whose ratios are known. ratio: book_id, r."""
    few = ratio.groupBy("book_id").agg(F.count_if(F.col("r") < thin).alias("thin"))
    middle = upper_medians(ratio, "book_id", F.col("r"), F.floor(F.col("r") * 1000))
    return few.join(middle, "book_id").select("book_id", tx.round_half_up(F.col("median"), 4).alias("median_coverage"), "thin")


def top_values(rows: DataFrame, value: str, most: int = 5, group: str = "book_id") -> DataFrame:
    """(group, rank, value, n): each group's commonest values, of equals the smaller first; null and empty ones don't count."""
    counts = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(group, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", place).where(F.col("rank") <= most).select(group, "rank", "value", "n")


def field_quality(pages: DataFrame) -> DataFrame:
    """Empty, short and distinct purposes, units and sections per book."""
    blank = lambda c: tx.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    return pages.groupBy("book_id").agg(
        F.count("*").alias("pages"), F.count_if(blank("purpose")).alias("purpose_empty"), F.count_if(F.length("purpose") < 60).alias("purpose_short"), F.countDistinct("purpose").alias("purpose_distinct"),
        F.count_if(blank("unit")).alias("unit_empty"), F.countDistinct("unit").alias("unit_distinct"), F.countDistinct("section").alias("section_distinct"),
    )


def no_text(pages: DataFrame) -> DataFrame:
    """(book_id, pages, empty, described, share): pages without text, and how many of them are described all the same."""
    empty = tx.strip(F.col("text")) == ""
    described = empty & (tx.strip(F.concat_ws("", "title", "summary")) != "")
    rows = pages.groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if(empty).alias("empty"), F.count_if(described).alias("described"))
    return rows.withColumn("share", tx.round_half_up(F.col("empty") / F.col("pages")))


def duplicate_share(pages: DataFrame, column: str) -> DataFrame:
    """(book_id, filled, most, share): the share of the most frequent value among those that aren't empty."""
    counts = pages.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy("book_id", column).agg(F.count("*").alias("n"))
    rows = counts.groupBy("book_id").agg(F.sum("n").alias("filled"), F.max("n").alias("most"))
    return rows.withColumn("share", tx.round_half_up(F.col("most") / F.col("filled"), 4))


def title_repetition(pages: DataFrame, books: DataFrame, exempt: tuple = ("divider", "contents")) -> DataFrame:
    """(book_id, titled, as_book_title, most, share): pages whose title is the book's, and the share of the commonest title."""
    folded = pages.select("book_id", "page_type", tx.rule_fold(F.col("title")).alias("t")).where("t <> ''").join(books.select("book_id", tx.rule_fold(F.col("title")).alias("name")), "book_id")
    same = (F.length("t") >= 12) & (F.contains("t", F.col("name")) | F.contains("name", F.col("t"))) & ~F.col("page_type").isin(*exempt)
    counts = folded.groupBy("book_id", "t").agg(F.count("*").alias("n"), F.count_if(same).alias("s")).groupBy("book_id").agg(F.sum("n").alias("titled"), F.sum("s").alias("as_book_title"), F.max("n").alias("most"))
    return counts.withColumn("share", tx.round_half_up(F.col("most") / F.col("titled"), 4))


def foreign_units(pages: DataFrame, proven: float = 0.8, generic: str = "") -> DataFrame:
    """(book_id, physical_page, unit, also_in): units that another book has too and whose words the page doesn't prove.

    generic: a pattern of names that all books use; they aren't judged.
    """
    named = tx.strip(F.col("unit")) != ""
    owners = pages.where(named & ~F.col("unit").rlike(generic) if generic else named).select("unit", "book_id").distinct()
    ends = owners.groupBy("unit").agg(F.min("book_id").alias("low"), F.max("book_id").alias("high"))
    rows = (pages.where(named & ~F.col("unit").rlike(generic)) if generic else pages).join(ends, "unit").where("low <> high")
    words = F.filter(F.split(tx.rule_fold(F.col("unit")), " "), lambda w: F.length(w) >= 3)
    share = tx.once(F.split(tx.rule_fold(F.col("text")), " "), lambda body: F.size(F.array_intersect(words, body)) / F.greatest(F.size(F.array_distinct(words)), F.lit(1)))
    other = F.when(F.col("low") != F.col("book_id"), F.col("low")).otherwise(F.col("high"))
    # names a column of both sides, so that texts are looked at after the join
    return rows.where(F.when(F.col("low") < F.col("high"), share) < proven).select("book_id", "physical_page", "unit", other.alias("also_in"))


def findings(*checks: tuple[DataFrame, str, Column]) -> DataFrame:
    """(book_id, code, severity) of all checks; each gives rows per book, its code and a severity that is null where nothing is wrong."""
    parts = [df.select("book_id", F.lit(code).alias("code"), severity.alias("severity")).where("severity is not null") for df, code, severity in checks]
    return reduce(DataFrame.unionByName, parts)


def book_scores(books: DataFrame, found: DataFrame) -> DataFrame:
    """(book_id, critical, high, medium, low, score): 100 less the weighted findings, at most 80 of them."""
    counts = found.groupBy("book_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in WEIGHTS))
    rows = books.select("book_id").join(counts, "book_id", "left").na.fill(0, list(WEIGHTS))
    penalty = reduce(Column.__add__, (F.col(s) * w for s, w in WEIGHTS.items()))
    return rows.withColumn("score", tx.round_half_up(100 - F.least(F.lit(80.0), penalty)))


def library_score(checks: DataFrame, found: DataFrame, scores: DataFrame) -> DataFrame:
    """(checks, clean, score, book_mean): a check without high or critical findings counts 5 points, with high ones 2.5, with critical ones 0.

    clean counts the checks without any finding; book_mean is the mean of the books' scores.
    """
    worst = found.groupBy("code").agg(F.max(F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "high", 1).otherwise(0)).alias("worst"))
    rows = checks.join(worst, "code", "left").withColumn("points", F.when(F.coalesce("worst", F.lit(0)) == 0, 5.0).when(F.col("worst") == 1, 2.5).otherwise(0.0))
    one = rows.agg(F.count("*").alias("checks"), F.count_if(F.col("worst").isNull()).alias("clean"), tx.round_half_up(F.sum("points") / (F.count("*") * 5) * 100).alias("score"))
    mean = scores.agg(tx.round_half_up(F.avg("score")).alias("book_mean"))
    return one.join(F.broadcast(mean))  # one row each


def ranking(scores: DataFrame) -> DataFrame:
    """Books from the gravest findings down."""
    return scores.orderBy(*(F.desc(s) for s in WEIGHTS), "score", "book_id")


def gate(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(critical, unverified, blocked): the library is blocked by any critical finding or unverified number."""
    a = found.agg(F.count_if(F.col("severity") == "critical").alias("critical"))
    b = verdicts.agg(F.count_if(F.col("verdict") == "unverified").alias("unverified"))
    return a.join(F.broadcast(b)).withColumn("blocked", (F.col("critical") > 0) | (F.col("unverified") > 0))  # one row each
