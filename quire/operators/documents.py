"""Two-pass document build: book-wide and library-wide counts first, then one projection per page."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx


def running_headers(pages: DataFrame, least: int = 3, share: float = 0.25) -> DataFrame:
    """(book_id, line, pages): first lines that head at least ``least`` pages and ``share`` of the book."""
    lines = pages.select("book_id", F.lower(tx.flat(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("line"))
    n = lines.groupBy("book_id").agg(F.count("*").alias("n"))
    counts = lines.where("line <> ''").groupBy("book_id", "line").agg(F.count("*").alias("pages"))
    return counts.join(n, "book_id").where(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("n") * share))).select("book_id", "line", "pages")


def templates(pages: DataFrame, column: str, least: int, by_book: bool = False) -> DataFrame:
    """(book_id or not, value, n): values that so many pages of a book or of the library share that they describe none of them."""
    keys = [*(["book_id"] if by_book else []), F.col(column).alias("value")]
    return pages.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def offset_hints(pages: DataFrame) -> DataFrame:
    """(book_id, page_offset_hint): printed less physical page where it is the same on all pages that have both."""
    found = pages.where("printed_page is not null").groupBy("book_id")
    low = F.min(F.col("printed_page") - F.col("physical_page"))
    return found.agg(low.alias("low"), F.max(F.col("printed_page") - F.col("physical_page")).alias("high")).select("book_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("page_offset_hint"))


def printed_source(parsed: Column, footer: Column, own: Column) -> tuple[Column, Column]:
    """The printed page and where it comes from: the parser, the footer, the text itself, or nowhere."""
    source = F.when(parsed.isNotNull(), "parser").when(footer.isNotNull(), "footer").when(own.isNotNull(), "text").otherwise("unknown")
    return F.coalesce(parsed, footer, own), source


# fixed values: what a title gains or loses by each feature, and the words of titles that stand for none
TITLE_POINTS = {"folio": -3.0, "one_word": -2.5, "three_words": 2.0, "short": -3.0, "long": -2.0, "patch": -6.0}
NO_TITLE = "(?i)^(تكملة|تابع|لا عنوان|بدون عنوان|continued|untitled|no title)"


def title_points(title: Column, weight: float, body: Column) -> Column:
    """Points of a cleaned title: its weight, its features, up to 2 for letters and up to 4 for words that the folded body holds."""
    words = F.filter(F.split(title, " "), lambda w: w.rlike("\\p{L}"))
    long = F.array_distinct(F.filter(F.split(tx.word_fold(title), " "), lambda w: F.length(w) >= 4))
    features = {
        "folio": title.rlike("^[0-9]{1,4}( |$)|[ ][0-9]{1,4}$"), "one_word": F.size(words) == 1, "three_words": F.size(words) >= 3,
        "short": F.length(title) < 8, "long": F.length(title) > 140, "patch": title.rlike(NO_TITLE),
    }
    points = F.lit(float(weight)) + F.least(F.regexp_count(title, F.lit("\\p{L}")), F.lit(60)) / 30
    for name, holds in features.items():
        points = points + F.when(holds, TITLE_POINTS[name]).otherwise(0.0)
    covered = tx.once(long, lambda ws: F.when((F.size(ws) > 0) & (body != ""), F.size(F.filter(ws, lambda w: F.contains(body, w))) / F.size(ws) * 4).otherwise(0.0))
    return F.when(F.size(words) > 0, points + covered).otherwise(-1.0)


def best_title(candidates: list[tuple[Column, float]], text: Column, furniture: Column | None = None) -> Column:
    """The candidate with the most points, the first of equals, cut at a word; null if none has more than 0.

    furniture: an array of lower-cased lines that many pages bear; such a candidate is taken only where no other has points.
    """
    held = F.coalesce(furniture, F.array().cast("array<string>")) if furniture is not None else F.array().cast("array<string>")
    shown = F.array(*(F.struct(F.lit(float(w)).alias("w"), F.lit(i).alias("at"), tx.flat(F.coalesce(c, F.lit(""))).alias("t"), c.alias("title")) for i, (c, w) in enumerate(candidates)))

    def chosen(page: Column) -> Column:
        ranked = F.transform(shown, lambda x: F.struct(F.array_contains(page["lines"], F.lower(x["t"])).alias("furniture"), (-F.round(title_points(x["t"], 0.0, page["body"]) + x["w"], 9)).alias("minus"), x["at"].alias("at"), x["title"].alias("title")))
        # the title without letters has -1 plus its weight; it never wins
        return F.array_min(F.filter(ranked, lambda r: (r["minus"] < 0) & r["title"].rlike("\\p{L}")))["title"]

    best = tx.once(F.struct(tx.word_fold(text).alias("body"), held.alias("lines")), chosen)
    return tx.once(best, lambda title: F.when(title.isNotNull(), tx.clip_at_word(title)))


def purpose(enriched: Column, raw: Column, is_template: Column, derived: Column, fallback: str = "not stated") -> tuple[Column, Column]:
    """A page's purpose and where it comes from: enrichment, the page unless it is a template, a derived text of 20 characters, a fallback."""
    good = lambda c: F.coalesce(tx.strip(c), F.lit("")) != ""
    kind = F.when(good(enriched), "enriched").when(good(raw) & ~is_template, "page").when(F.length(derived) >= 20, "derived").otherwise("fallback")
    return F.when(kind == "enriched", enriched).when(kind == "page", raw).when(kind == "derived", derived).otherwise(F.lit(fallback)), kind


def override(base: DataFrame, extra: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``base`` with the values of ``extra`` where they are neither null, blank nor empty arrays."""
    kinds = dict(extra.dtypes)
    held = extra.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    real = lambda c: F.size(f"_{c}") > 0 if kinds[c].startswith("array") else (tx.strip(F.col(f"_{c}")) != "" if kinds[c] == "string" else F.col(f"_{c}").isNotNull())
    joined = base.join(held, keys, "left")
    return joined.withColumns({c: F.when(real(c), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop(*(f"_{c}" for c in columns))


def searchable_text(columns: list[str]) -> Column:
    """The parts of a page that are searched, one per line, empty ones left out."""
    return F.array_join(F.filter(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), lambda x: tx.strip(x) != ""), "\n")


# fixed values: words under which structured content is found
FIGURE, GLOSSARY, ACTIVITIES, EXERCISES, EXERCISE = "صورة", "مفردات معجم", "نشاط تمارين", "تمارين", "التمرين"
#: The nested content that ``whole_search_text`` reads; each may be null or empty, as may be its parts.
NESTED = {
    "figures": "array<struct<kind:string,caption:string,description:string,figure_text:array<string>>>",
    "glossary": "array<struct<term:string,pos:string,definition:string>>",
    "activities": "array<struct<type:string,instruction:string,answer_format:string,dispatch:struct<target:string,printed_from:int,printed_to:int>,questions:array<string>>>",
    "exercises": "array<struct<letter:string,instruction:string,items:array<struct<kind:string,stem:string>>>>",
}


def _said(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _each(c: Column, told, sign: str) -> Column:
    return F.coalesce(F.array_join(F.transform(c, told), sign), F.lit(""))


def _words(c: Column) -> Column:
    """A list's texts with a blank before each, so that an empty list adds nothing; nulls count as empty."""
    return F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(F.lit(" "), F.coalesce(x, F.lit("")))), ""), F.lit(""))


def nested_text(name: str, c: Column) -> Column:
    """What a page's figures, glossary, activities or exercises add to its search text."""
    if name == "figures":
        return _each(c, lambda f: _said(FIGURE, f["kind"], f["caption"], f["description"], F.array_join(F.coalesce(f["figure_text"], F.array().cast("array<string>")), " ", "")), "\n")
    if name == "glossary":
        return F.concat(F.lit(f"{GLOSSARY}\n"), _each(c, lambda g: _said(g["term"], g["pos"], g["definition"]), " "))
    if name == "activities":
        to = lambda a: F.when(a["dispatch"].isNotNull(), _said(a["dispatch"]["target"], a["dispatch"]["printed_from"], a["dispatch"]["printed_to"]))
        return F.concat(F.lit(f"{ACTIVITIES}\n"), _each(c, lambda a: F.concat(_said(a["type"], a["instruction"], a["answer_format"], to(a)), _words(a["questions"])), " "))
    items = lambda e: _words(F.transform(e["items"], lambda i: _said(i["kind"], i["stem"])))
    return F.concat(F.lit(f"{EXERCISES}\n"), _each(c, lambda e: F.concat(_said(EXERCISE, e["letter"], e["instruction"]), items(e)), "\n"))


def whole_search_text(plain: list[str]) -> Column:
    """All 17 parts of a page that are searched, a line each: the ``plain`` columns in their order, then the ``NESTED`` ones; nulls are empty."""
    return F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in plain), *(nested_text(name, F.col(name)) for name in NESTED))


def with_layers(pages: DataFrame, outline: DataFrame, extra: DataFrame, keys: tuple = ("book_id", "physical_page")) -> DataFrame:
    """Pages with what the outline and the enrichment say of them, under ``outline`` and ``extra``; null where a layer lacks the page.

    A layer that has a page twice gives its smallest row, so that no page is doubled.
    """
    out = pages
    for name, layer in (("outline", outline), ("extra", extra)):
        rest = [c for c in layer.columns if c not in keys]
        held = layer.groupBy(*keys).agg(F.min(F.struct(*rest)).alias(name))
        out = out.join(held, list(keys), "left")
    return out


def scan_meta(docs: DataFrame) -> DataFrame:
    """The columns that a scan reads, with defaults, and none of a page's text but its search form.

    docs: also evidence_status and enriched.
    """
    words = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "section", "unit", "page_type")]
    return docs.select(
        F.concat_ws(":", "book_id", F.col("physical_page").cast("string")).alias("id"), "book_id", "physical_page", "printed_page", *words, "searchable", "needs_ocr", "evidence_status", F.coalesce("text_length", F.lit(0)).alias("text_length"),
        (F.col("printed_page") - F.col("physical_page")).alias("page_offset"), tx.is_damaged(F.col("text")).alias("text_damaged"), F.coalesce("enriched", F.lit(False)).alias("enriched"), tx.letters_only(F.col("text")).alias("normalized"),
    )


def statistics(docs: DataFrame, arrays: dict | None = None, statuses: tuple = ()) -> DataFrame:
    """The index's statistics in one aggregation: sizes, totals of ``arrays`` (name to Column), and a count of each evidence status."""
    arrays = arrays or {}
    held = docs.withColumns({f"_n_{n}": F.coalesce(F.size(c), F.lit(0)) for n, c in arrays.items()}) if arrays else docs
    some = F.greatest(F.lit(0), F.lit(0), *(F.col(f"_n_{n}") for n in arrays)) > 0
    return held.agg(
        F.count("*").alias("pages"), F.countDistinct("book_id").alias("books"), F.count_if(F.col("searchable") | (F.coalesce("summary", F.lit("")) != "")).alias("indexed"), F.count_if("searchable").alias("searchable"), F.count_if(~F.col("searchable")).alias("needs_ocr"),
        F.sum(F.length("text")).alias("characters"), F.count_if(F.length("text") > 0).alias("with_text"), F.count("printed_page").alias("with_printed_page"), F.count_if(F.col("title") != "").alias("with_title"), F.countDistinct("unit").alias("units"),
        F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"), F.count_if(some).alias("structured"), *(F.sum(f"_n_{n}").alias(n) for n in arrays), *(F.count_if(F.col("evidence_status") == k).alias(k.replace("-", "_")) for k in statuses),
    )
