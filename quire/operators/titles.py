"""Titles that follow one another, and mentions of other books."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.numbering import numbered

#: Points that a title loses after a page of the same title.
LOSS = 3.0


def told_apart(pages: DataFrame) -> DataFrame:
    """(book_id, physical_page, title): a title that equals the one before it gets its page's number.

    Only pages with a searchable text count. What a page is compared with is the title that the page before it was given, so
    that of a run of equal titles every second one gets a number. Titles are compared without white space and vowel marks;
    null ones are empty. Runs are islands: a page's place in its book less its place among the pages of its title is the
    same all through a run; so no window spans a book. pages: book_id, physical_page, title, searchable; pages are unique.
    """
    rows = pages.where("searchable").select("book_id", "physical_page", F.coalesce("title", F.lit("")).alias("title"))
    rows = numbered(rows, "book_id", "physical_page", name="place").withColumn("key", F.sha2(F.concat_ws("\n", "book_id", tx.compact_key(F.col("title"))), 256))
    rows = numbered(rows, "key", "physical_page", name="nth").withColumn("island", F.col("place") - F.col("nth"))
    starts = rows.groupBy("key", "island").agg(F.min("place").alias("start"))
    suffix = F.concat(F.lit(" — page "), F.col("physical_page").cast("string"))
    second = (F.col("place") - F.col("start")) % 2 == 1
    return rows.join(starts, ["key", "island"]).select("book_id", "physical_page", F.when(second, F.concat(F.substring("title", F.lit(1), F.lit(140) - F.length(suffix)), suffix)).otherwise(F.col("title")).alias("title"))


def chained(candidates: DataFrame, span: int = 4096) -> DataFrame:
    """(book_id, physical_page, title): each page's best title, less ``LOSS`` points if the title that the page before was given is the same.

    A page's title depends on the one before it, all through a book, yet each page knows two titles only: its first one, and the
    one that it takes after a page of that title (its next best, or the first one with the page's number). So a page is a function
    from "was I pushed off my first title" to the same of the next page: constant, equal or opposite. The functions of a
    stretch of ``span`` pages are composed, the stretches' results are chained, and each page reads its own; no window spans
    more than a stretch, or the stretches of a book.

    candidates: book_id, physical_page (unique in a book) and titles, an array of (title, points) from the best down; pages
    without a title have an empty or null array, get a null and are like no other. Titles are compared without white space and vowel marks.
    """
    key = lambda c: tx.compact_key(c)
    suffix = F.concat(F.lit(" — page "), F.col("physical_page").cast("string"))
    first = F.get("titles", F.lit(0))
    other = F.get(F.filter("titles", lambda t: key(t["title"]) != key(F.get(F.col("titles"), F.lit(0))["title"])), F.lit(0))
    numbered_ = F.concat(F.substring(first["title"], F.lit(1), F.lit(140) - F.length(suffix)), suffix)
    pushed = F.when(other["points"] > first["points"] - LOSS, other["title"]).otherwise(numbered_)
    rows = candidates.select("book_id", "physical_page", first["title"].alias("first"), pushed.alias("second"))
    rows = numbered(rows, "book_id", "physical_page", name="place").withColumn("stretch", F.floor((F.col("place") - 1) / span))
    # a page's first and second title as the next page sees them, also across stretches
    before = rows.select("book_id", (F.col("place") + 1).alias("place"), key(F.col("first")).alias("_first"), key(F.col("second")).alias("_second"))
    met = rows.join(before, ["book_id", "place"], "left").withColumns({"off": F.coalesce(F.col("_first") == key(F.col("first")), F.lit(False)), "on": F.coalesce(F.col("_second") == key(F.col("first")), F.lit(False))})
    # off, on: whether the page is pushed if the page before it was not, or was
    inside = Window.partitionBy("book_id", "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    state = met.withColumns({"_fixed": F.max(F.when(F.col("off") == F.col("on"), F.struct("place", "off"))).over(inside), "_turns": F.sum((F.col("off") & ~F.col("on")).cast("int")).over(inside)})
    since = F.max(F.when(F.col("off") == F.col("on"), F.struct("place", "_turns"))).over(inside)
    state = state.withColumn("_since", since)
    known = F.when(F.col("_fixed").isNotNull(), F.col("_fixed.off") != ((F.col("_turns") - F.col("_since._turns")) % 2 == 1))  # null: it depends on the stretch before
    state = state.withColumns({"known": known, "odd": F.col("_turns") % 2 == 1})
    ends = state.groupBy("book_id", "stretch").agg(F.max_by(F.struct("known", "odd"), "place").alias("e"))
    past = Window.partitionBy("book_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("book_id").orderBy("stretch")
    ends = ends.withColumn("turns", F.sum(F.col("e.odd").cast("int")).over(upto)).withColumn("set", F.max(F.when(F.col("e.known").isNotNull(), F.struct("stretch", "e.known", "turns"))).over(past))
    turned = (F.col("turns") - F.col("e.odd").cast("int") - F.coalesce("set.turns", F.lit(0))) % 2 == 1
    entry = ends.select("book_id", "stretch", (F.coalesce("set.known", F.lit(False)) != turned).alias("entry"))
    is_pushed = F.coalesce("known", F.col("entry") != F.col("odd"))
    return state.join(entry, ["book_id", "stretch"]).select("book_id", "physical_page", F.when(is_pushed, F.col("second")).otherwise(F.col("first")).alias("title"))


def foreign_mentions(rows: DataFrame, phrases: DataFrame, mention: str = "book|كتاب|مادة|ملف") -> DataFrame:
    """(book_id, physical_page, phrase): rows whose value names another book after a word for book.

    Phrases are 2 to 4 folded words, met by an equal join; a row's first one counts, at one place the longest. Phrases that the
    row's own book has too don't count. rows: book_id, physical_page, value; phrases: book_id, phrase. Null values name nothing.
    """
    said = F.regexp_extract_all(F.lower("value"), F.lit(f"(?:{mention})[ \\t]+([^\\n،.؛:]{{3,80}})"), 1)
    words = rows.select("book_id", "physical_page", F.posexplode(said).alias("at", "part")).withColumn("words", F.split(tx.word_fold(F.col("part")), " ")).where(F.size("words") >= 2)
    gram = lambda i, n: F.when(i + n <= F.size("words"), F.struct(i.alias("i"), F.lit(-n).alias("n"), F.array_join(F.slice("words", i + 1, F.lit(n)), " ").alias("phrase")))
    grams = words.select("book_id", "physical_page", "at", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.array_compact(F.array(gram(i, 2), gram(i, 3), gram(i, 4)))))).alias("g")).select("*", "g.phrase")
    ends = phrases.groupBy("phrase").agg(F.min("book_id").alias("low"), F.max("book_id").alias("high"))
    hits = grams.join(ends, "phrase").where("low <> book_id or high <> book_id").join(phrases.select("book_id", "phrase").distinct(), ["book_id", "phrase"], "left_anti")
    return hits.groupBy("book_id", "physical_page").agg(F.min(F.struct("at", "g.i", "g.n", "phrase")).alias("f")).select("book_id", "physical_page", "f.phrase")


def structured_totals(pages: DataFrame, arrays: dict) -> DataFrame:
    """(book_id, one total per array, zeroed): the summed sizes of arrays per book, and the names of those that are all empty; null arrays count 0."""
    sums = pages.groupBy("book_id").agg(*(F.sum(F.when(c.isNull(), 0).otherwise(F.size(c))).alias(n) for n, c in arrays.items()))
    return sums.withColumn("zeroed", F.concat_ws("+", *(F.when(F.col(n) == 0, n) for n in arrays)))


def damage_decomposition(pages: DataFrame, artefact: str, repair: str) -> DataFrame:
    """(artefact_only, artefact_and_other, other_only): damaged pages by whether one repair would do. pages: text."""
    has, other = F.col("text").rlike(artefact), tx.is_damaged(F.regexp_replace("text", artefact, repair))
    return pages.agg(F.count_if(has & ~other).alias("artefact_only"), F.count_if(has & other).alias("artefact_and_other"), F.count_if(~has & other).alias("other_only"))


def implausible_years(pages: DataFrame, harmless: str = "[()°×=+]") -> DataFrame:
    """(year, pages, harmless): implausible years, how many pages hold them, and on how many a sign of measures stands near."""
    rows = pages.select("text", F.explode(tx.broken_years(F.col("text"))).alias("year"))
    near = F.rlike("text", F.concat(F.lit(f"{harmless}[^\\n]{{0,45}}"), F.col("year").cast("string"), F.lit("[ \\t]*م")))
    return rows.groupBy("year").agg(F.count("*").alias("pages"), F.count_if(near).alias("harmless"))


def keys_not_carried(rows: DataFrame, extra: str, carried: tuple) -> DataFrame:
    """(key, n): keys of a map column that no carried field takes, with their rows."""
    return rows.select(F.explode(F.map_keys(extra)).alias("key")).where(~F.col("key").isin(*carried)).groupBy("key").agg(F.count("*").alias("n"))
