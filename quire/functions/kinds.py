"""What kind of page, question or evidence a row is: decision tables and line scores as built-in expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as tx

# fixed values: page types that are exercises, words that open an exercise, and words of a question about exercises
EXERCISE_TYPES = ("exercises", "questions", "matching")
IMPERATIVES = "اختر|عرف|اكمل|استخرج|علم|حدد|سجل|ناقش|بين|صنف|اكتب|مايأتي|سؤال|سئله|اسئله|تمارين|التمارين|تدريب|نشاط|اختبر|ميز|فك"
EXERCISE_QUESTION = "تمرين|تمارين|تدريب|نشاط|سؤال|سئله|اسئله|واجب|اختبار|اختبر|حل"
FOLIO_HEAD = "^[\\p{Nd}\\p{P}\\p{Z}\\t\\n]+"
# fixed values: what asks for a book's structure
STRUCTURE = ("(كم|عدد|عده)[^؟?]{0,30}(فصول|وحدات|دروس|تمارين|اسئله|صفحات|فصلا|وحده|درسا|تمرين|سؤال|صفحة|فصل)", "(فهرس|فهره|محتويات)", "(خطة|خطه|بنيه|بنية|مخطط|توزيع)")
# fixed values: words that name a page's kind, and words that open a heading
CONTENTS = "(?i)(^|[ \\t\\n])(فهرس|الفهرس|المحتويات|فهرس المحتويات|table of contents|contents)([ \\t\\n]|$)"
EXERCISE_WORDS = "(?i)(تمارين|تمرين|تدريبات|تدريب|أنشطة|نشاط|اسأل|أسئلة|سؤال|اختبر|اكتب|بيّن|اقرأ|ضع[ \\t\\n]|جد[ \\t\\n])"
RECAP = "(?i)(^|[ \\t\\n])(ماذا تعلمنا|خلاصة الوحدة|ملخص الوحدة|ملخص الدرس|the story so far|matters so far|تذكر|مراجعة سريعة|ملخص)([ \\t\\n]|$)"
MATCHING = "(?i)(وصل|وصّل|اربط|matching|match the|التطابق)"
GLOSSARY = "(?i)(المصطلحات|المصطلح|المعاني|المعجم|glossary|vocabulary)"
CHAPTER = "^(الفصل|الباب|الوحدة|المحور|درس)([^\\p{L}]|$)"
HEADING = "(?i)^(الفصل|الباب|الوحدة|وحدة|المحور|محور|درس|تمارين|تمرين|تدريبات|نشاط|أنشطة|أسئلة|اسئلة|فهرس|الفهرس|المحتويات|ملخص|خلاصة|تذكر|unit|chapter|lesson|exercise|exercises|glossary|contents|review)"
# signs of lines, by Unicode categories
LEADERS = "[.…·]{3,}[ \\t]*\\p{Nd}+$"
FOLIO = "^\\p{Nd}{1,4}$"
NUMBERED = "^\\p{Ps}?[ \\t]*(\\p{Nd}{1,2}|\\p{L})[ \\t]*[\\p{Pe}\\p{Pd}\\p{Po}]([ \\t]|$)"
ARABIC = "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"
LATIN = "[A-Za-z\\x{00C0}-\\x{024F}]"
TERMS = f"{LATIN}{{3}}[ \\t]*[\\p{{Pd}}:=][ \\t]*{ARABIC}|{ARABIC}{{3}}[ \\t]*[\\p{{Pd}}:=][ \\t]*{LATIN}"
SENTENCE_END = "[.!?؟؛][\\p{Pe}\\p{Pf}]*$"


def _folded(c: Column) -> Column:
    return F.lower(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), tx.VOWEL_MARKS, ""), "أإآٱـ", "اااا"))


def is_exercise(page_type: Column, title: Column, text: Column) -> Column:
    """By its type, or because its title (without a page number) or its text begins with an imperative of exercises.

    A text that begins with a page number is not judged by its words. Nulls count as empty.
    """
    opens = f"^({IMPERATIVES})"
    return F.coalesce(page_type.isin(*EXERCISE_TYPES), F.lit(False)) | F.regexp_replace(_folded(title), FOLIO_HEAD, "").rlike(opens) | _folded(text).rlike(opens)


def asks_for_exercises(query: Column) -> Column:
    return _folded(query).rlike(EXERCISE_QUESTION)


def asks_for_structure(folded_query: Column) -> Column:
    """Whether a question, in the Arabic search form, is about a book's structure; null is not."""
    return F.coalesce(folded_query.rlike("|".join(STRUCTURE)), F.lit(False))


def lines_of(c: Column) -> Column:
    """The stripped lines of a cleaned text, empty ones left out."""
    return F.filter(F.transform(F.split(tx.clean(c), "\n"), tx.strip), lambda x: x != "")


#: Points of each type for what a page shows: (feature, points each, how many count). The type with the most points is taken, of
#: equals the one named first, if it has ``LEAST`` or more.
POINTS = {
    "contents": (("names_contents", 7.0, 1), ("leaders", 1.5, 8), ("folios", 0.9, 8)),
    "exercises": (("numbered", 1.4, 5), ("exercise_words", 1.2, 4)),
    "matching": (("names_matching", 4.0, 1), ("numbered", 1.5, 3)),
    "boxed_recap": (("names_recap", 6.5, 1),),
    "glossary": (("names_glossary", 6.8, 1), ("terms", 1.3, 8)),
    "parallel_text": (("mixed", 1.25, 6),),
}
LEAST = 5.0
#: Counts of lines by pattern (all of them must match), of words, and marks: a pattern in the text or in its first lines.
LINE_COUNTS = {"leaders": (LEADERS,), "folios": (FOLIO,), "numbered": (NUMBERED,), "terms": (TERMS,), "mixed": (ARABIC, "[A-Za-z]")}
MARKS = {"names_contents": ("head", CONTENTS), "names_glossary": ("head", GLOSSARY), "names_recap": ("text", RECAP), "names_matching": ("text", MATCHING)}
#: Fewer letters and signs than this make a page a divider; under a chapter's heading the second number holds.
BARE, UNDER_HEADING = 60, 360


def page_type(c: Column) -> Column:
    """One of eight types by the points of ``POINTS``; pages of hardly any text are dividers, what no type claims is lesson content."""

    def decided(f: Column) -> Column:
        scores = [F.struct(sum((F.least(f[name], F.lit(most)) * n for name, n, most in parts), F.lit(0.0)).alias("score"), F.lit(-i).alias("order"), F.lit(kind).alias("kind")) for i, (kind, parts) in enumerate(POINTS.items())]
        return tx.once(F.array_max(F.array(*scores)), lambda best: F.when(f["size"] < 12, "divider").when(best["score"] >= LEAST, best["kind"]).when(f["size"] < F.when(f["opens"], UNDER_HEADING).otherwise(BARE), "divider").otherwise("lesson_content"))

    def features(lines: Column) -> Column:
        head, text = F.array_join(F.slice(lines, 1, 3), " "), F.array_join(lines, "\n")
        counts = [F.size(F.filter(lines, _all(patterns))).alias(name) for name, patterns in LINE_COUNTS.items()]
        marks = [(head if where == "head" else text).rlike(p).cast("int").alias(name) for name, (where, p) in MARKS.items()]
        size = F.length(F.translate(tx.compact_key(text), "ـ", "")).alias("size")
        return F.struct(*counts, *marks, F.regexp_count(text, F.lit(EXERCISE_WORDS)).alias("exercise_words"), size, F.exists(F.slice(lines, 1, 2), lambda x: x.rlike(CHAPTER)).alias("opens"))

    return tx.once(lines_of(c), lambda lines: tx.once(features(lines), decided))


def _all(patterns: tuple):
    return lambda x: reduce(lambda a, b: a & b, (x.rlike(p) for p in patterns))


#: A title's points: by pattern; and the weights of an early place, of brevity, and of the share of letters.
TITLE_SIGNS = ((HEADING, 5.0), (SENTENCE_END, -1.5), ("\ufffd", -6.0))
EARLY, BRIEF, LETTERS = 0.7, 2.0, 2.5
_LETTER = "\\p{L}"


def candidates(lines: Column) -> Column:
    """Lines that can be a title: 3 to 150 characters, a letter among them."""
    return F.filter(lines, lambda x: F.length(x).between(3, 150) & x.rlike(_LETTER))


def title_points(x: Column, place: Column) -> Column:
    """How much a line at a place from 0 on reads like a title: early, brief, of letters, with a heading's word, and no sentence."""
    points = F.greatest(F.lit(0.0), 4.0 - place) * EARLY + F.greatest(F.lit(0.0), 1 - F.abs(F.length(x) - 30) / 60.0) * BRIEF + F.regexp_count(x, F.lit(_LETTER)) / F.length(x) * LETTERS
    for pattern, n in TITLE_SIGNS:
        points = points + F.when(x.rlike(pattern), n).otherwise(0.0)
    return points


def ranked_titles(c: Column) -> Column:
    """A page's candidates as (title, points) from the best down, in 140 characters each, the first of equals first."""
    scored = lambda x, i: F.struct((-title_points(x, i)).alias("s"), i.alias("i"), F.substring(x, 1, 140).alias("t"))
    return F.transform(F.array_sort(F.transform(candidates(lines_of(c)), scored)), lambda x: F.struct(x["t"].alias("title"), (-x["s"]).alias("points")))


def title_line(c: Column) -> Column:
    """The line that reads most like a title; null if no line can be one."""
    return F.get(ranked_titles(c), F.lit(0))["title"]


def token(c: Column) -> Column:
    """A status word in lower case with hyphens; null is empty."""
    return F.regexp_replace(F.lower(tx.strip(F.coalesce(c, F.lit("")))), "[ \\t\\n_]+", "-")


def evidence_label(evidence: Column, status: Column, quotation: Column, source: Column, searchable: Column, damaged: Column, reliable: Column, official: Column, needs_ocr: Column) -> Column:
    """struct(label, warning, visual) of a citation: what its text can prove, whether to warn, whether to look at the page.

    Words may be null and count as empty; ``searchable`` has three values, null is unknown; other flags that are null are false.
    """
    e, st, src, q = token(evidence), token(status), token(source), F.coalesce(quotation, F.lit(""))
    yes = lambda c: F.coalesce(c, F.lit(False))
    found, hidden = yes(searchable), ~F.coalesce(searchable, F.lit(True))
    web = (src == "web") | (e == "external-web")
    broken = (st == "damaged-text") | (e == "damaged-text") | (found & yes(damaged))
    ocr, image = (st == "ocr-text") | (e == "ocr-text"), (e == "pdf-image") | (st == "pdf-image")
    clean, gone = st.isin("clean-extracted-text", "clean-text"), st.isin("no-text", "unavailable")
    none = gone | hidden | (~found & ~clean & (q != "outline-description"))
    proven = (e == "pdf-text") & ~hidden & yes(reliable) & ~gone & ((q == "pdf-text") | (src == "curriculum"))
    table = (
        ("web-official", web & yes(official)), ("web", web), ("description", (q == "outline-description") | (e == "outline-description")), ("damaged", broken), ("image", image),
        ("ocr-checked", ocr & yes(reliable)), ("ocr-unreliable", ocr), ("text-checked", proven), ("text-clean", clean & found & yes(reliable)), ("text-unproven", clean & found),
        ("unreliable", q == "unreliable"), ("summary", e == "summary"), ("stored-text", (src == "pdf-fallback") & found), ("stored-no-text", src == "pdf-fallback"), ("no-text", none),
    )
    label = F.lit("check-page")
    for name, holds in reversed(table):
        label = F.when(holds, name).otherwise(label)
    warning = F.when(label == "description", broken).when(label.isin("damaged", "image", "ocr-unreliable", "text-unproven", "unreliable", "stored-no-text"), True).when(label.isin("no-text", "check-page"), ~yes(reliable)).otherwise(False)
    visual = label.isin("image", "ocr-checked", "ocr-unreliable", "stored-no-text") | (~web & ~ocr & ~image & yes(needs_ocr))
    return F.struct(label.alias("label"), warning.alias("warning"), visual.alias("visual"))


def needs_ocr(text: Column, asked: Column, corrupt_book: Column, status: Column, parser: Column, flagged: Column) -> Column:
    """Whether a page is to be read from its picture, and why: the first reason that holds, null if none does.

    forced, corrupt-book, empty, contaminated, rejected, other-parser, corrupt, flagged. Nulls of flags are false.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    t = F.coalesce(text, F.lit(""))
    reasons = (
        ("forced", yes(asked)), ("corrupt-book", yes(corrupt_book)), ("empty", tx.strip(t) == ""), ("contaminated", tx.contamination(t).isNotNull()), ("rejected", yes(status == "rejected")),
        ("other-parser", yes((parser != "json") & (parser != ""))), ("corrupt", tx.corruption_reason(t).isNotNull()), ("flagged", yes(flagged)),
    )
    out = F.lit(None).cast("string")
    for reason, holds in reversed(reasons):
        out = F.when(holds, reason).otherwise(out)
    return out
