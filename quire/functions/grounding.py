"""Texts held against the numbers that a page proves; data-dependent replacement without a user function."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as tx

RUN = "[0-9٠-٩۰-۹]+(?:[.,٫/][0-9٠-٩۰-۹]+)*"


def _bare(x: Column) -> Column:
    return F.regexp_replace(tx.normalise_digits(x), "[.,٫/]", "")


def numbers_of(c: Column) -> Column:
    """The distinct numbers of a text, separators inside them removed."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(RUN), 0), _bare))


_MARKS = "،,;:"


def tidy(c: Column) -> Column:
    """A text from which numbers were taken out, mended: no empty pair of brackets, the first of several marks, none at the ends.

    It is read as pieces between marks. A piece without a letter or digit is dropped with the mark before it.
    """
    bare = c
    for pair in ("()", "[]", "{}"):
        bare = F.regexp_replace(bare, f"\\{pair[0]}{tx.SPACE}*\\{pair[1]}", "")
    bare = F.regexp_replace(bare, f"([{_MARKS}])(?:{tx.SPACE}*[{_MARKS}.])+", "$1")
    pieces = F.filter(F.regexp_extract_all(bare, F.lit(f"[{_MARKS}]?[^{_MARKS}]+"), 0), lambda x: x.rlike("[\\p{L}\\p{N}]"))
    whole = F.array_join(F.transform(pieces, lambda x: F.regexp_replace(tx.flat(x), f"^([{_MARKS}]) +$", "$1")), "")
    spaced = tx.flat(F.regexp_replace(F.regexp_replace(whole, f"([{_MARKS}])(?=[\\p{{L}}\\p{{N}}])", "$1 "), f" +([{_MARKS}]|\\.(?= |$))", "$1"))
    return F.btrim(spaced, F.lit(tx.BLANKS + "–—:;,.-،"))


def grounded(c: Column, evidence: Column, allowed: Column) -> Column:
    """The text less the numbers that neither ``evidence`` nor ``allowed`` (arrays of digits) holds, tidied; null is empty.

    The text is cut at its numbers, and each number that is proven goes back to its place.
    """
    text = F.coalesce(c, F.lit(""))
    between, found = F.split(text, RUN), F.regexp_extract_all(text, F.lit(RUN), 0)
    kept = F.transform(found, lambda x: F.when(F.array_contains(evidence, _bare(x)) | F.array_contains(allowed, _bare(x)), x).otherwise(" "))
    return tidy(F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("a"), kept.alias("b")), lambda z: F.array(z["a"], F.coalesce(z["b"], F.lit(""))))), ""))


# fixed values: parts of a book that are counted, and the stems of the words that count them
COUNTED = "(?:ال)?(?:فصول|فصل|وحدات|وحدة|دروس|درس|مباحث|مبحث|أبواب|باب|أسئلة|سؤال|تمارين|تمرين|صفحات|صفحة)"
COUNT_WORDS = {2: "اثنين|اثنان|ثانية|ثاني", 3: "ثلاثة|ثلاث|ثالثة|ثالث", 4: "أربعة|أربع|اربع|رابعة|رابع", 5: "خمسة|خمس|خامسة|خامس", 6: "ستة|ست|سادسة|سادس", 7: "سبعة|سبع|سابعة|سابع", 8: "ثمانية|ثمان|ثامنة|ثامن", 9: "تسعة|تسع|تاسعة|تاسع", 10: "عشرة|عشر|عاشرة|عاشر"}


def without_count_words(c: Column, evidence: Column) -> Column:
    """The text less counts in words before or after a part of a book, unless ``evidence`` (an array of digits) holds the number; tidied."""
    text = F.coalesce(c, F.lit(""))
    for n, words in COUNT_WORDS.items():
        count = f"(?:ال)?(?:{words})"
        bare = tx.replaced(text, (f"(^|[ \\n])({COUNTED})[ ]+{count}(?=[ \\n.،:؛]|$)", "$1$2"), (f"(^|[ \\n]){count}[ ]+({COUNTED})(?=[ \\n.،:؛]|$)", "$1$2"))
        text = F.when(F.array_contains(evidence, F.lit(str(n))), text).otherwise(bare)
    return tidy(text)


def ungrounded(c: Column, evidence: Column, allowed: Column) -> Column:
    """The numbers that ``grounded`` takes out, repeats kept, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(RUN), 0), _bare)
    return tx.unproven(found, evidence, allowed)


def without_folios(c: Column, first: Column, second: Column) -> Column:
    """The cleaned text less page numbers at its head and tail, as often as they stand there; a null number removes nothing.

    Leading zeros are part of a number of at most four digits. A text that is nothing but one number stays.
    """
    either = F.array_join(F.transform(F.array_compact(F.array(first, second)), lambda n: F.concat(F.lit("0{0,"), F.greatest(F.lit(4) - F.length(n.cast("string")), F.lit(0)).cast("string"), F.lit("}"), n.cast("string"))), "|")
    text = tx.strip(tx.replaced(tx.clean(c), (tx.PRINTER_SLUG, " "), (tx.PRINTER_STAMP, " ")))
    head = F.regexp_replace(text, F.concat(F.lit("^(?:(?:"), either, F.lit(f"){tx.SPACE}+)+")), F.lit(""))
    tail = F.regexp_replace(head, F.concat(F.lit(f"(?:{tx.SPACE}+(?:"), either, F.lit("))+$")), F.lit(""))
    return F.when(either == "", text).otherwise(tx.strip(tail))


def derived_title(c: Column) -> Column:
    """The first stripped line of 4 to 120 characters, else empty."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), tx.strip), lambda x: F.length(x).between(4, 120))
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def derived_summary(c: Column, most: int = 400, least: int = 24) -> Column:
    """The first two sentences of more than ``least`` characters, in ``most`` characters."""
    long = F.filter(F.split(tx.flat(F.coalesce(c, F.lit(""))), "(?<=[.!؟?]) +"), lambda x: F.length(x) > least)
    return F.substring(F.array_join(F.slice(long, 1, 2), " "), 1, most)


def field(c: Column, most: int) -> Column:
    """One line of at most ``most`` characters; words that stand for nothing become empty."""
    text = tx.flat(F.coalesce(c, F.lit("")))
    return F.when(text.rlike("(?i)^(null|undefined|n/a|none|-|لا يوجد|غير مذكور)$"), "").otherwise(F.substring(tx.strip_slab(text), 1, most))
