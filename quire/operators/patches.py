"""Ordered, validated corrections of pages: rejects go to a side table, accepted values are merged onto the pages.

patches: book_id, physical_page, field, value, source, priority, position; a later patch has a higher (priority, source,
position). pages: book_id, physical_page and the patched columns.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx

# fixed values: openings of descriptions that describe a book and no page
DEAD_TEMPLATE = "^(نص الصفحه مستخرج من كتاب|صفحه مصوره من كتاب|محتوي الصفحه صفحه (مقدمه|غلاف|فاصله))"

#: Characters to which an accepted value is cut; other fields to 200.
CLIP = {"title": 90, "summary": 600}


def problems(field: Column, value: Column) -> Column:
    """Codes of everything that makes a value unacceptable, as an array."""
    text = tx.flat(value)
    codes = {
        "EMPTY": text == "", "SERIALIZED_JSON": text.rlike(tx.SERIALISED), "CJK": text.rlike(tx.CJK), "U_FFFD": text.contains("�"),
        "DEAD_TEMPLATE": F.translate(text, "ةى", "هي").rlike(DEAD_TEMPLATE), "PRESS_SLAB": text.rlike(tx.PRINTER_SLUG) | text.rlike(tx.PRINTER_STAMP), "TITLE_FOLIO": (field == "title") & text.rlike("^[0-9]{1,4}( |$)"),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in codes.items())))


def warnings(field: Column, value: Column) -> Column:
    """Codes of what is odd but accepted."""
    n = F.length(tx.flat(value))
    return F.array_compact(F.array(F.when((field == "title") & (n > 90), "TITLE_TOO_LONG"), F.when((field == "purpose") & (n < 60), "PURPOSE_SHORT"), F.when((field == "summary") & (n < 40), "SUMMARY_SHORT")))


def validated(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects): accepted values are clipped and bear their warnings; a reject has a row per code and its value's first 160 characters."""
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CLIP.items() for x in kv)), F.col("field")), F.lit(200))
    rows = patches.withColumn("codes", problems(F.col("field"), F.col("value")))
    accepted = rows.where(F.size("codes") == 0).withColumn("warnings", warnings(F.col("field"), F.col("value"))).withColumn("value", F.substring(tx.flat(F.col("value")), F.lit(1), limit)).drop("codes")
    rejects = rows.select("source", "book_id", "physical_page", "field", F.explode("codes").alias("code"), F.substring("value", 1, 160).alias("value"))
    return accepted, rejects


def last_wins(accepted: DataFrame) -> DataFrame:
    """Of each page's field the patch that comes last."""
    latest = F.max(F.struct("priority", "source", "position", "value")).alias("p")
    return accepted.groupBy("book_id", "physical_page", "field").agg(latest).select("book_id", "physical_page", "field", "p.value", "p.source")


def apply(pages: DataFrame, accepted: DataFrame, fields: list[str]) -> DataFrame:
    """The pages with their patches: a patch is skipped if the value that is stored by then equals it or begins with it.

    The patches of one page and field are folded in order inside the row; a page has few of them.
    """
    step = F.struct("priority", "source", "position", "value")
    per_page = accepted.groupBy("book_id", "physical_page", "field").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    wide = per_page.groupBy("book_id", "physical_page").pivot("field", fields).agg(F.first("steps"))
    named = wide.select("book_id", "physical_page", *(F.col(f).alias(f"_{f}") for f in fields))
    joined = pages.join(named, ["book_id", "physical_page"], "left")

    def merged(f: str) -> Column:
        start = F.coalesce(F.col(f), F.lit(""))
        folded = F.aggregate(F.col(f"_{f}"), start, lambda held, s: F.when(held.startswith(s["value"]), held).otherwise(s["value"]))
        return F.when(F.col(f"_{f}").isNull(), F.col(f)).otherwise(folded)

    return joined.withColumns({f: merged(f) for f in fields}).drop(*(f"_{f}" for f in fields))


def outcome(pages: DataFrame, winners: DataFrame, fields: list[str]) -> DataFrame:
    """(book_id, physical_page, field, state): missing page, already applied, or pending."""
    values = pages.select("book_id", "physical_page", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("stored")) for f in fields))).alias("s")).select("book_id", "physical_page", "s.*")
    both = winners.join(values, ["book_id", "physical_page", "field"], "left")
    state = F.when(F.col("stored").isNull(), "missing").when(F.col("stored").startswith(F.col("value")), "applied").otherwise("pending")
    return both.select("book_id", "physical_page", "field", state.alias("state"))


def subject_phrases(books: DataFrame) -> DataFrame:
    """(book_id, phrase): a book's title, its subject, and the subject before a dash: whole if of two words, and the first two of three or more."""
    sources = F.array("subject", F.split_part("subject", F.lit("—"), F.lit(1)), "title")
    words = books.select("book_id", F.explode(F.transform(sources, lambda x: F.filter(F.split(tx.word_fold(x), " "), lambda w: w != ""))).alias("w"))
    whole = F.when(F.size("w") >= 2, F.array_join("w", " "))
    return words.select("book_id", F.explode(F.array_compact(F.array(whole, F.when(F.size("w") >= 3, F.array_join(F.slice("w", 1, 2), " "))))).alias("phrase")).distinct()


def foreign_phrases(phrases: DataFrame, least: int = 6, block: int = 1024) -> DataFrame:
    """(book_id, phrase): phrases of other books that the book doesn't have itself. phrases: book_id, phrase.

    The result has a row per book and phrase by its meaning: phrases meet the books in blocks of about ``block``. To find such
    phrases in texts use ``foreign_values``, which never makes these rows.
    """
    rows = phrases.where(F.length("phrase") >= least).distinct()
    books = rows.select("book_id").distinct()
    blocks = max(1, -(-books.count() // block))
    dealt = books.withColumn("_block", F.pmod(F.xxhash64("book_id"), F.lit(blocks)))
    every = rows.select("phrase").distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.join(every, "_block").drop("_block").join(rows, ["book_id", "phrase"], "left_anti").select("book_id", "phrase")


def foreign_values(values: DataFrame, phrases: DataFrame, pages: DataFrame, least: int = 6, words: int = 6, proof: int = 300) -> DataFrame:
    """(book_id, physical_page, field, phrase): values that name another book's phrase, the longest of each, then the first by its letters.

    Values and phrases meet by runs of two to ``words`` folded words. Phrases that the book has too don't count, nor does one
    that the page's own text of ``proof`` characters holds. values: book_id, physical_page, field, value.
    """
    said = values.select("book_id", "physical_page", "field", F.split(tx.word_fold(F.col("value")), " ").alias("w")).where(F.size("w") >= 2)
    run = lambda i, n: F.when(i + n <= F.size("w"), F.array_join(F.slice("w", i + 1, F.lit(n)), " "))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.array_compact(F.array(*(run(i, n) for n in range(2, words + 1))))))
    grams = said.select("book_id", "physical_page", "field", F.explode(F.array_distinct(runs)).alias("phrase"))
    known = phrases.where(F.length("phrase") >= least).select("book_id", "phrase").distinct()
    ends = known.groupBy("phrase").agg(F.min("book_id").alias("low"), F.max("book_id").alias("high"))
    hits = grams.join(ends, "phrase").where("low <> book_id or high <> book_id").join(known, ["book_id", "phrase"], "left_anti")
    own = pages.select("book_id", "physical_page", tx.word_fold(F.col("text")).alias("own"))
    proven = (F.length("own") >= proof) & F.contains(F.col("own"), F.col("phrase"))
    open_ = hits.join(own, ["book_id", "physical_page"], "left").where(~F.coalesce(proven, F.lit(False)))
    return open_.groupBy("book_id", "physical_page", "field").agg(F.min(F.struct((-F.length("phrase")).alias("n"), "phrase")).alias("f")).select("book_id", "physical_page", "field", "f.phrase")


def duplication_report(pages: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, distinct_values, duplicated_rows, ratio): how often the values of a field repeat."""
    rows = pages.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("v")) for f in fields))).alias("s")).select("s.*").where("v <> ''")
    counts = rows.groupBy("field", "v").agg(F.count("*").alias("n"))
    out = counts.groupBy("field").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct_values"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicated_rows"))
    return out.withColumn("ratio", tx.round_half_up(100 * F.col("duplicated_rows") / F.col("filled"), 1))


def first_holder(accepted: DataFrame) -> DataFrame:
    """(book_id, field, value, holder): the first page that was given each value, where several were."""
    rows = accepted.groupBy("book_id", "field", "value").agg(F.count("*").alias("n"), F.min(F.struct("priority", "source", "position", "physical_page")).alias("f"))
    return rows.where("n > 1").select("book_id", "field", "value", F.col("f.physical_page").alias("holder"))


def pending_exclusion(wanted: DataFrame, done: DataFrame, attempts: DataFrame, most: int = 3) -> DataFrame:
    """(book_id, physical_page, field) of fields that are neither done nor tried ``most`` times."""
    keys = ["book_id", "physical_page", "field"]
    tried = attempts.groupBy(*keys).agg(F.count("*").alias("tries"))
    return wanted.join(done, keys, "left_anti").join(tried, keys, "left").where(F.coalesce("tries", F.lit(0)) < most).select(*keys)
