"""Comparison of layers: what is missing, extra, shortened or different between two tables of pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.numbering import FEW

KEYS = ["book_id", "physical_page"]


def missing(source: DataFrame, index: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys of ``source`` that ``index`` lacks; the other way round it finds orphans."""
    return source.select(*keys).join(index.select(*keys), keys, "left_anti")


def lost_text(source: DataFrame, index: DataFrame, least: int = 20) -> DataFrame:
    """Pages with text in the source and less than ``least`` characters of it in the index."""
    both = source.select(*KEYS, F.length("text").alias("source_length")).join(index.select(*KEYS, F.length("text").alias("index_length")), KEYS)
    return both.where((F.col("source_length") >= least) & (F.col("index_length") < least))


def truncated(source: DataFrame, index: DataFrame, kept: float = 0.98, line: int = 25) -> DataFrame:
    """(keys, expected, indexed, lost_lines): pages shorter than ``kept`` of the source that lost a line of ``line`` characters."""
    both = source.select(*KEYS, F.col("text").alias("expected_text")).join(index.select(*KEYS, F.col("text").alias("indexed_text")), KEYS)
    lines = F.filter(F.transform(F.split("expected_text", "\n"), tx.flat), lambda x: F.length(x) >= line)
    gone = F.size(F.filter(lines, lambda x: ~F.contains(F.col("flat_text"), x)))
    both = both.withColumn("flat_text", tx.flat(F.col("indexed_text"))).where(F.length("indexed_text") < F.length("expected_text") * kept)
    return both.select(*KEYS, F.length("expected_text").alias("expected"), F.length("indexed_text").alias("indexed"), gone.alias("lost_lines")).where("lost_lines > 0")


def losses(source: DataFrame, index: DataFrame, kept: float = 0.98, line: int = 25, head: int = 40, sized: DataFrame | None = None) -> DataFrame:
    """(book_id, pages, lost, expected, share): per book the pages that lost lines, the characters of these, and their share of all expected ones.

    A line of ``line`` characters is lost if the indexed text doesn't hold its first ``head``. Pages of fewer than 20 characters don't count.
    Lengths say which pages can have lost lines, and the texts of these alone meet. sized: what ``sizes`` gives, where it is known.
    """
    counted = (sizes(source, index) if sized is None else sized).where("expected >= 20")
    short = counted.where(F.col("indexed") < F.col("expected") * kept).select(*KEYS)
    few = short.limit(FEW + 1).count() <= FEW
    only = lambda rows: rows.join(F.broadcast(short) if few else short, KEYS, "left_semi").select(*KEYS, "text")
    both = only(source).select(*KEYS, F.transform(F.split("text", "\n"), tx.flat).alias("lines")).join(only(index).select(*KEYS, tx.flat(F.col("text")).alias("indexed")), KEYS)
    gone = F.filter("lines", lambda x: (F.length(x) >= line) & ~F.contains(F.col("indexed"), F.substring(x, 1, head)))
    lost = both.select("book_id", F.aggregate(gone, F.lit(0), lambda n, x: n + F.length(x)).alias("lost")).groupBy("book_id").agg(F.count_if(F.col("lost") > 0).alias("pages"), F.sum("lost").alias("lost"))
    sums = counted.groupBy("book_id").agg(F.sum("expected").alias("expected")).join(lost, "book_id", "left").na.fill(0, ["pages", "lost"])
    return sums.select("book_id", "pages", "lost", "expected", (F.col("lost") / F.col("expected")).alias("share"))


def sizes(source: DataFrame, index: DataFrame) -> DataFrame:
    """(keys, expected, indexed): lengths of the flattened texts of pages that both tables have."""
    size = lambda rows, name: rows.select(*KEYS, F.length(tx.flat(F.col("text"))).alias(name))
    return size(source, "expected").join(size(index, "indexed"), KEYS)


# fixed values: what an outline says of a page without text
NO_TEXT_CLAIM = "لا يمكن الإجابة|لا نص مستخرج|لا يوجد نص|صفحة مصورة|تحتاج قراءة بصرية"


def contradicted(outline: DataFrame, docs: DataFrame, least: int = 20, claim: str = NO_TEXT_CLAIM) -> DataFrame:
    """(keys): pages whose outline (keys, description) claims that there is no text, and that have ``least`` characters of it."""
    says = outline.where(F.col("description").rlike(claim)).select(*KEYS).distinct()
    return docs.where(F.length(tx.strip(F.col("text"))) >= least).select(*KEYS).join(says, KEYS, "left_semi")


def dead_layers(layers: DataFrame, readers: DataFrame) -> DataFrame:
    """(layer): layers that exist and that no reader names. layers: layer; readers: layer, reader."""
    return layers.select("layer").distinct().join(readers.select("layer"), "layer", "left_anti")


def guessed_pages(source: DataFrame, index: DataFrame, rules: DataFrame) -> DataFrame:
    """(keys): pages whose printed number the source lacks and whose indexed one is what a constant shift gives.

    rules: book_id, first, last, shift; the shift of the stretch of physical pages from first to last.
    """
    bare = source.where("printed_page is null").select(*KEYS)
    stretch = rules.select("book_id", "first", "last", "shift")
    numbered = index.where("printed_page is not null").select(*KEYS, "printed_page").join(bare, KEYS, "left_semi").join(stretch, "book_id")
    page = F.col("physical_page")
    return numbered.where(page.between(F.col("first"), F.col("last")) & (F.col("printed_page") == page + F.col("shift"))).select(*KEYS).distinct()


def differing(left: DataFrame, right: DataFrame, columns: list[str], keys: list[str] = KEYS) -> DataFrame:
    """(keys, change): added, removed or changed rows; nulls are equal to each other."""
    marked = lambda df, m: df.select(*keys, F.lit(True).alias(m), *(F.col(c).alias(f"{m}{c}") for c in columns))
    both = marked(left, "_l").join(marked(right, "_r"), keys, "full_outer")
    apart = F.lit(False)
    for c in columns:
        apart |= ~F.col(f"_l{c}").eqNullSafe(F.col(f"_r{c}"))
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(apart, "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def checksum_findings(books: DataFrame, digests: DataFrame) -> DataFrame:
    """(book_id, code, severity): no checksum, no file with it, or a file of another size."""
    both = books.join(digests.select(F.col("digest").alias("_d"), F.col("bytes").alias("_b")), F.col("checksum") == F.col("_d"), "left")
    code = F.when(F.coalesce(F.col("checksum"), F.lit("")) == "", "NO_CHECKSUM").when(F.col("_d").isNull(), "CHECKSUM_MISMATCH").when(F.col("bytes") != F.col("_b"), "SIZE_DIFFERS")
    return both.select("book_id", code.alias("code"), F.when(code == "CHECKSUM_MISMATCH", "critical").otherwise("high").alias("severity")).where("code is not null")
