"""Registered queries of page kinds, grounded numbers, derived fields, titles and mentions; they join those of ``library``."""

from pyspark.sql import functions as F

from quire.functions import arabic, grounding, kinds, repairs
from quire.functions import text as tx
from quire.operators import documents, quality, search, semistructured, titles
from quire.plans import corpus
from quire.plans import sqltext as s
from quire.plans.corpus import table
from quire.plans.library import _VIEW, R, _found

_FIELDS = "[" + ", ".join(f"'{f}'" for f in search.FIELDS) + "]"


@R.add(_VIEW + f", m AS (SELECT book_id, physical_page, unnest({_FIELDS}) AS field, unnest([{', '.join(search.FIELDS)}]) AS value FROM v) SELECT book_id, physical_page, field FROM m WHERE contains(value, 'that') OR contains(value, 'with')")
def search_matched_in(spark, sf):
    return _found(spark, sf, "that with").select("book_id", "physical_page", F.explode("matched_in").alias("field"))


_PICKS = "list_transform(list_sort(list_distinct([0, (len(g) - 1) // 2, len(g) - 1, CAST(floor((len(g) - 1) / 4 + 0.5) AS BIGINT), CAST(floor((len(g) - 1) * 3 / 4 + 0.5) AS BIGINT)])), lambda i: g[i + 1])"


@R.add(
    f", g AS (SELECT doc_id, title, clean, list_filter(list_transform(string_split(regexp_replace({s.flat('clean')}, '([.!؟?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda e: {s.flat('e')}), lambda e: length(e) > 18) AS g FROM (SELECT doc_id, title, {s.clean('text')} AS clean FROM p)), "
    f"v AS (SELECT doc_id, title, CASE WHEN len(g) = 0 THEN clean WHEN len(g) <= 4 THEN array_to_string(g, ' ') ELSE array_to_string({_PICKS}, ' ') END AS picked FROM g), w AS (SELECT doc_id, title, {s.compact('picked', 460)} AS value FROM v) "
    "SELECT doc_id, CASE WHEN value = '' THEN title ELSE value END AS value FROM w"
)
def doc_spread_summary(spark, sf):
    value = tx.spread_summary(F.col("text"))
    return corpus.pages(spark, sf).select("doc_id", F.when(value == "", F.col("title")).otherwise(value).alias("value"))


R.sql["txt_spread_summary"] = R.sql["doc_spread_summary"].replace("CASE WHEN value = '' THEN title ELSE value END AS value", "value")


@R.add("SELECT doc_id, title AS question, CAST(1 AS INTEGER) AS answer_at FROM p WHERE title <> '' AND doc_id % 3 < 2")
def quiz_valid(spark, sf):
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("of "), "book_id")).when(F.col("doc_id") % 3 == 1, "1").otherwise("none of them")
    quiz = F.to_json(F.struct(F.array(F.struct(F.col("title").alias("question"), F.array(F.concat(F.lit("in "), "lang"), F.concat(F.lit("of "), "book_id")).alias("options"), answer.alias("answer"))).alias("questions")))
    return corpus.pages(spark, sf).select("doc_id", F.explode(semistructured.quiz_questions(quiz)).alias("q")).select("doc_id", "q.question", "q.answer_at")


@R.add("SELECT book_id, physical_page, printed_page, page_type AS type, ltrim(title, ' ' || chr(9)) AS title FROM p")
def outline_entries(spark, sf):
    p = corpus.pages(spark, sf)
    printed = F.when(F.col("printed_page").isNull(), "").otherwise(F.concat(F.lit(" (printed "), F.col("printed_page").cast("string"), F.lit(")")))
    block = F.concat(F.lit("### page "), F.col("physical_page").cast("string"), printed, F.lit("\n- **type**: "), "page_type", F.lit("\n- **title**: "), "title", F.lit("\n"))
    # one outline for each unit of 25 pages
    files = p.groupBy("book_id", "unit").agg(F.array_sort(F.collect_list(F.struct("physical_page", block.alias("b")))).alias("e"))
    files = files.select("book_id", F.concat(F.lit("# outline\n"), F.array_join(F.transform("e", lambda x: x["b"]), "\n")).alias("value"))
    return semistructured.outline_entries(files).select("book_id", "physical_page", "printed_page", "type", "title")


@R.add(
    "SELECT book_id || ':' || CAST(physical_page AS VARCHAR) AS id, book_id, physical_page, printed_page, coalesce(title, '') AS title, coalesce(section, '') AS section, coalesce(unit, '') AS unit, coalesce(page_type, '') AS page_type, "
    "coalesce(purpose, '') AS purpose, coalesce(summary, '') AS summary, text, text_length, searchable, needs_ocr FROM x"
)
def proj_page_record(spark, sf):
    words = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "section", "unit", "page_type", "purpose", "summary", "text")]
    return corpus.index(corpus.pages(spark, sf)).select(F.concat_ws(":", "book_id", F.col("physical_page").cast("string")).alias("id"), "book_id", "physical_page", "printed_page", *words, "text_length", "searchable", "needs_ocr")


@R.add(
    f", n AS (SELECT book_id, physical_page, 'src' || CAST(doc_id % 8 AS VARCHAR) AS other FROM p) SELECT n.book_id, n.physical_page, 'book ' || n.other AS phrase FROM n JOIN b ON b.book_id = n.other WHERE n.other <> n.book_id"
)
def qc_foreign_ngrams(spark, sf):
    p = corpus.pages(spark, sf)
    value = F.concat(F.lit("see book Book src"), (F.col("doc_id") % 8).cast("string"), F.lit(": "), "summary")
    return titles.foreign_mentions(p.select("book_id", "physical_page", value.alias("value")), corpus.books(p).select("book_id", tx.word_fold(F.col("title")).alias("phrase")))


@R.add(
    f", t AS (SELECT book_id, CAST(sum(len({s.digit_runs('text')})) AS BIGINT) AS numbers, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(len(regexp_extract_all(text, '[{{}}]'))) AS BIGINT) AS braces FROM p GROUP BY book_id) "
    "SELECT *, concat_ws('+', CASE WHEN numbers = 0 THEN 'numbers' END, CASE WHEN lines = 0 THEN 'lines' END, CASE WHEN braces = 0 THEN 'braces' END) AS zeroed FROM t"
)
def agg_structured_totals(spark, sf):
    text = F.col("text")
    return titles.structured_totals(corpus.pages(spark, sf), {"numbers": tx.digit_runs(text), "lines": F.split(text, "\n"), "braces": F.regexp_extract_all(text, F.lit("[{}]"), 0)})


_HURT = "CASE WHEN doc_id % 15 = 0 THEN 'في االكتاب ' || text || chr(65533) WHEN doc_id % 5 = 0 THEN 'في االكتاب ' || text WHEN doc_id % 7 = 0 THEN text || chr(65533) ELSE text END"
_BARE = r"regexp_replace(text, '(^|[ \t\n(«،.:؛؟!-])اال', '\1ال', 'g')"


@R.add(
    f", h AS (SELECT {_HURT} AS text FROM p), d AS (SELECT regexp_matches(text, '(^|[ \\t\\n(«،.:؛؟!-])اال') AS has, {s.damaged(_BARE)} AS other FROM h) "
    "SELECT count(*) FILTER (WHERE has AND NOT other) AS artefact_only, count(*) FILTER (WHERE has AND other) AS artefact_and_other, count(*) FILTER (WHERE NOT has AND other) AS other_only FROM d"
)
def agg_repair_decomposition(spark, sf):
    d, mark = F.col("doc_id"), F.lit("�")
    fault = F.concat(F.lit("في االكتاب "), "text")
    text = F.when(d % 15 == 0, F.concat(fault, mark)).when(d % 5 == 0, fault).when(d % 7 == 0, F.concat("text", mark)).otherwise(F.col("text"))
    return titles.damage_decomposition(corpus.pages(spark, sf).select(text.alias("text")), "(^|[ \\t\\n(«،.:؛؟!-])اال", "$1ال")


@R.add()
def agg_implausible_numbers(spark, sf):
    year = (F.col("doc_id") % 900 + 1000).cast("string")
    return titles.implausible_years(corpus.pages(spark, sf).select(F.concat("text", F.lit(" سنة "), year, F.lit(" م")).alias("text")))


@R.add(
    f", r AS (SELECT book_id, physical_page, title, {s.replaced('title', (f'{s.SPACE}+', ''), (r'[\x{064B}-\x{065F}\x{0670}]', ''))} AS k FROM (SELECT * REPLACE (CASE WHEN physical_page % 9 BETWEEN 2 AND 5 THEN 'One title' ELSE title END AS title) FROM p) WHERE searchable), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY physical_page) AS place, lag(k) OVER (PARTITION BY book_id ORDER BY physical_page) IS NOT DISTINCT FROM k AS same FROM r), "
    "u AS (SELECT *, max(CASE WHEN NOT same THEN place END) OVER (PARTITION BY book_id ORDER BY physical_page) AS start FROM n) "
    "SELECT book_id, physical_page, CASE WHEN (place - start) % 2 = 1 THEN substr(title, 1, 140 - length(' — page ' || physical_page)) || ' — page ' || physical_page ELSE title END AS title FROM u"
)
def win_previous_title(spark, sf):
    title = F.when((F.col("physical_page") % 9).between(2, 5), "One title").otherwise(F.col("title"))
    return titles.told_apart(corpus.pages(spark, sf).withColumn("title", title))


@R.add("SELECT key, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'title' END, CASE WHEN doc_id % 3 = 0 THEN 'mood' END, lang], lambda e: e IS NOT NULL)) AS key FROM documents) WHERE key <> 'title' GROUP BY key", base=False)
def set_keys_not_carried(spark, sf):
    d = F.col("doc_id")
    keys = F.array_compact(F.array(F.when(d % 2 == 0, "title"), F.when(d % 3 == 0, "mood"), F.col("lang")))
    return titles.keys_not_carried(table(spark, sf, "documents").select(F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit(1))).alias("extra")), "extra", ("title",))


# ---- text ----

_HEADS = {0: "اختر الجواب ", 1: "12 - عَرِّف ", 2: "تمارين "}
_OPENED = "(CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _HEADS.items()) + " ELSE '' END)"


def _opened(column="text"):
    d = F.col("doc_id") % 10
    head = F.when(d == 0, _HEADS[0]).when(d == 1, _HEADS[1]).when(d == 2, _HEADS[2]).otherwise("")
    return F.concat(head, column)


def _sql_folded(x):
    return f"lower(translate(regexp_replace({x}, '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}]', '', 'g'), 'أإآٱـ', 'اااا'))"


@R.add(
    f"SELECT doc_id, page_type IN ('exercises', 'questions', 'matching') OR regexp_matches(regexp_replace({_sql_folded(f'{_OPENED} || title')}, '{s.escaped(kinds.FOLIO_HEAD)}', ''), '^({kinds.IMPERATIVES})') OR regexp_matches({_sql_folded('text')}, '^({kinds.IMPERATIVES})') AS value FROM p"
)
def txt_exercise_page(spark, sf):
    return corpus.pages(spark, sf).select("doc_id", kinds.is_exercise(F.col("page_type"), _opened("title"), F.col("text")).alias("value"))


_NUMBERS = r"list_transform(regexp_extract_all({}, '[0-9٠-٩۰-۹]+(?:[.,٫/][0-9٠-٩۰-۹]+)*'), lambda e: regexp_replace(translate(e, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '[.,٫/]', '', 'g'))"


@R.add(f"SELECT doc_id, array_to_string(list_filter({_NUMBERS.format('summary')}, lambda e: e <> '7' AND NOT list_contains({_NUMBERS.format('substr(text, 60)')}, e)), ' ') AS dropped FROM p")
def txt_ungrounded_numbers(spark, sf):
    evidence = grounding.numbers_of(F.substring("text", F.lit(60), F.lit(1 << 30)))
    return corpus.pages(spark, sf).select("doc_id", F.array_join(grounding.ungrounded(F.col("summary"), evidence, F.array(F.lit("7"))), " ").alias("dropped"))


@R.add()
def txt_ground_numbers(spark, sf):
    evidence = grounding.numbers_of(F.substring("text", F.lit(60), F.lit(1 << 30)))
    return corpus.pages(spark, sf).select("doc_id", grounding.grounded(F.col("summary"), evidence, F.array(F.lit("7"))).alias("value"))


@R.add()
def txt_structure_intent(spark, sf):
    asked = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("كم عدد فصول الكتاب "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", kinds.asks_for_structure(arabic.normalise(asked)).alias("value"))


@R.add()
def txt_query_forms(spark, sf):
    """Of every question: whether it is about exercises, and the forms it is searched by."""
    return table(spark, sf, "conversations").select("conv_id", "turn", kinds.asks_for_exercises(F.col("text")).alias("exercises"), F.array_join(arabic.search_tokens(F.col("text")), " ").alias("forms"))


_N = "CAST(physical_page AS VARCHAR)"
_FOLIO_TEXT = f"{_N} || ' ' || coalesce(CAST(printed_page AS VARCHAR) || ' ', '') || text || ' 0' || {_N}"
_ZEROS = "'0{{0,' || greatest(4 - length({0}), 0) || '}}' || {0}"
_EITHER = f"({_ZEROS.format(_N)} || coalesce('|' || {_ZEROS.format('CAST(printed_page AS VARCHAR)')}, ''))"


@R.add(
    f", e AS (SELECT doc_id, {_EITHER} AS either, {s.strip(s.replaced(s.clean(_FOLIO_TEXT), (r'(?i)[A-Za-z0-9_]+\.indb[ \t]+[0-9]{1,4}', ' '), (r'[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}[ \t]+[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?([ \t]*[AP]M)?', ' ')))} AS t FROM p) "
    f"SELECT doc_id, {s.strip(f'''regexp_replace(regexp_replace(t, '^(?:(?:' || either || '){s.SPACE}+)+', ''), '(?:{s.SPACE}+(?:' || either || '))+$', '')''')} AS value FROM e"
)
def txt_expected_text(spark, sf):
    n, m = F.col("physical_page"), F.col("printed_page")
    text = F.concat(n.cast("string"), F.lit(" "), F.coalesce(F.concat(m.cast("string"), F.lit(" ")), F.lit("")), "text", F.lit(" 0"), n.cast("string"))
    return corpus.pages(spark, sf).select("doc_id", grounding.without_folios(text, n, m).alias("value"))


@R.add(
    f", d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda e: {s.strip('e')}), lambda e: length(e) BETWEEN 4 AND 120) AS l, "
    f"list_filter(string_split(regexp_replace({s.flat('text')}, '([.!؟?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda e: length(e) > 24) AS g FROM p) SELECT doc_id, coalesce(l[1], '') AS title, substr(array_to_string(g[1:2], ' '), 1, 400) AS summary FROM d"
)
def txt_derive_meta(spark, sf):
    return corpus.pages(spark, sf).select("doc_id", grounding.derived_title(F.col("text")).alias("title"), grounding.derived_summary(F.col("text")).alias("summary"))


_KINDS = ("فهرس\n", "1) a\n2) b\n3) c\n4) d\n", "الوحدة\nتذكر\n", "match the words\n1) one\n", "Glossary\n", "كتاب book\nقلم pen\nباب door\nبيت house\n", "")
_KIND_TEXT = "list_extract([" + ", ".join("'" + k.replace("\n", "' || chr(10) || '") + "'" for k in _KINDS) + "], CAST(doc_id % 7 AS INTEGER) + 1) || text"
_LINES = f"list_filter(list_transform(string_split({s.clean(_KIND_TEXT)}, chr(10)), lambda e: {s.strip('e')}), lambda e: e <> '')"


def _kind_text():
    return F.concat(F.get(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 7).cast("int")), F.col("text"))


def _count(*patterns):
    return "len(list_filter(l, lambda e: " + " AND ".join(f"regexp_matches(e, '{s.escaped(p)}')" for p in patterns) + "))"


def _features():
    """The features of ``kinds.page_type`` as SQL over l (lines), head and t (the text)."""
    counts = [f"{_count(*patterns)} AS {name}" for name, patterns in kinds.LINE_COUNTS.items()]
    marks = [f"regexp_matches({'head' if where == 'head' else 't'}, '{s.escaped(p)}')::INT AS {name}" for name, (where, p) in kinds.MARKS.items()]
    size = f"length({s.replaced('t', (f'{s.SPACE}+', ''), (r'[\x{064B}-\x{065F}\x{0670}\x{0640}]', ''))}) AS size"
    opens = f"len(list_filter(l[1:2], lambda e: regexp_matches(e, '{s.escaped(kinds.CHAPTER)}'))) > 0 AS opens"
    return ", ".join([*counts, *marks, f"len(regexp_extract_all(t, '{s.escaped(kinds.EXERCISE_WORDS)}')) AS exercise_words", size, opens])


_POINTS = ", ".join("(" + " + ".join(f"least({name}, {most}) * {n}::DOUBLE" for name, n, most in parts) + f", {-i}, '{kind}')" for i, (kind, parts) in enumerate(kinds.POINTS.items()))


@R.add(
    f", l AS (SELECT doc_id, {_LINES} AS l FROM p), t AS (SELECT *, array_to_string(l, chr(10)) AS t, array_to_string(l[1:3], ' ') AS head FROM l), f AS (SELECT doc_id, {_features()} FROM t), "
    f"g AS (SELECT *, list_max([{_POINTS}]) AS best FROM f) "
    f"SELECT doc_id, CASE WHEN size < 12 THEN 'divider' WHEN best[1] >= {kinds.LEAST} THEN best[3] WHEN size < CASE WHEN opens THEN {kinds.UNDER_HEADING} ELSE {kinds.BARE} END THEN 'divider' ELSE 'lesson_content' END AS value FROM g"
)
def txt_page_type(spark, sf):
    return corpus.pages(spark, sf).select("doc_id", kinds.page_type(_kind_text()).alias("value"))


def _points(x):
    signs = "".join(f" + CASE WHEN regexp_matches({x}, '{s.escaped(p)}') THEN {n}::DOUBLE ELSE 0 END" for p, n in kinds.TITLE_SIGNS)
    letters = f"len(regexp_extract_all({x}, '\\p{{L}}'))"
    return f"(greatest(0, 4.0::DOUBLE - (i - 1)) * {kinds.EARLY}::DOUBLE + greatest(0, 1 - abs(length({x}) - 30) / 60.0::DOUBLE) * {kinds.BRIEF}::DOUBLE + {letters}::DOUBLE / length({x}) * {kinds.LETTERS}::DOUBLE{signs})"


_CANDIDATES = f", l AS (SELECT doc_id, list_filter({_LINES}, lambda e: length(e) BETWEEN 3 AND 150 AND regexp_matches(e, '\\p{{L}}')) AS l FROM p), k AS (SELECT doc_id, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM l)"


@R.add(
    _CANDIDATES + f", r AS (SELECT doc_id, substr(e, 1, 140) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY {_points('e')} DESC, i) AS r FROM k) "
    "SELECT p.doc_id, r.e AS value FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.r = 1"
)
def txt_title_lines(spark, sf):
    return corpus.pages(spark, sf).select("doc_id", kinds.title_line(_kind_text()).alias("value"))


_EVIDENCE = (
    ", e AS (SELECT doc_id, list_extract(['', 'pdf-text', 'ocr-text', 'pdf-image', 'summary', 'external-web', 'outline-description'], doc_id % 7 + 1) AS e, list_extract(['', 'clean-text', 'damaged-text', 'no-text', 'clean-extracted-text'], doc_id % 5 + 1) AS st, "
    "CASE doc_id % 4 WHEN 0 THEN 'pdf-text' WHEN 1 THEN 'unreliable' ELSE '' END AS q, CASE doc_id % 3 WHEN 0 THEN 'curriculum' WHEN 1 THEN 'pdf-fallback' ELSE '' END AS src, CASE doc_id % 11 % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS se, "
    "doc_id % 13 = 0 AS da, doc_id % 2 = 0 AS re, doc_id % 17 < 9 AS off, needs_ocr FROM p), f AS (SELECT *, e = 'external-web' AS web, st = 'damaged-text' OR (coalesce(se, FALSE) AND da) AS broken, e = 'ocr-text' AS ocr, e = 'pdf-image' AS image, "
    "st IN ('clean-text', 'clean-extracted-text') AS clean, st = 'no-text' AS gone, coalesce(se, FALSE) AS found, NOT coalesce(se, TRUE) AS hidden FROM e), "
    "g AS (SELECT *, CASE WHEN web AND off THEN 'web-official' WHEN web THEN 'web' WHEN e = 'outline-description' THEN 'description' WHEN broken THEN 'damaged' WHEN image THEN 'image' WHEN ocr AND re THEN 'ocr-checked' WHEN ocr THEN 'ocr-unreliable' "
    "WHEN e = 'pdf-text' AND NOT hidden AND re AND NOT gone AND (q = 'pdf-text' OR src = 'curriculum') THEN 'text-checked' WHEN clean AND found AND re THEN 'text-clean' WHEN clean AND found THEN 'text-unproven' WHEN q = 'unreliable' THEN 'unreliable' "
    "WHEN e = 'summary' THEN 'summary' WHEN src = 'pdf-fallback' AND found THEN 'stored-text' WHEN src = 'pdf-fallback' THEN 'stored-no-text' WHEN gone OR hidden OR (NOT found AND NOT clean) THEN 'no-text' ELSE 'check-page' END AS label FROM f) "
    "SELECT doc_id, label, CASE WHEN label = 'description' THEN broken WHEN label IN ('damaged', 'image', 'ocr-unreliable', 'text-unproven', 'unreliable', 'stored-no-text') THEN TRUE WHEN label IN ('no-text', 'check-page') THEN NOT re ELSE FALSE END AS warning, "
    "label IN ('image', 'ocr-checked', 'ocr-unreliable', 'stored-no-text') OR (NOT web AND NOT ocr AND NOT image AND needs_ocr) AS visual FROM g"
)


@R.add(_EVIDENCE)
def txt_evidence_label(spark, sf):
    d = F.col("doc_id")
    of = lambda n, *words: F.get(F.array(*map(F.lit, words)), (d % n).cast("int"))
    label = kinds.evidence_label(
        of(7, "", "pdf text", "OCR_text", "pdf-image", "summary", "external-web", "outline-description"), of(5, None, "clean-text", "damaged-text", "no-text", "clean-extracted-text"), of(4, "pdf-text", "unreliable", "", None),
        of(3, "curriculum", "pdf-fallback", None), of(11, True, False, None, True, False, None, True, False, None, True, False), d % 13 == 0, d % 2 == 0, d % 17 < 9, F.col("needs_ocr"),
    )
    return corpus.pages(spark, sf).select("doc_id", label.alias("e")).select("doc_id", "e.*")


#: What stands behind each page's text, and what it is put right to; by doc_id % 11.
_REPAIRS = (
    (" \uf048 \uf056", " صلى الله عليه وسلم رحمه الله"), (" اﷲ و\ufdf2", " الله والله"), (" الكرمي الكرمية", " الكريم الكرمية"), (" االسالمية", " الاسلامية"), (" بسم اهلل وهلل هللا", " بسم الله والله الله"),
    (" (االقتصاد واالقتصاد", " (القتصاد واالقتصاد"), (" املدرسة كامل امل", " المدرسة كامل امل"), (" \ufefb \ufedf\ufea0", " لا لج"), (" الر\u200fحمي", " الرحيم"), (" ½ ﬁ", " ½ ﬁ"), ("", ""),
)
_SET = lambda i: "list_extract([" + ", ".join(f"'{pair[i]}'" for pair in _REPAIRS) + "], CAST(doc_id % 11 AS INTEGER) + 1)"


@R.add(f"SELECT doc_id, {s.clean('text || ' + _SET(1))} AS value FROM p")
def txt_repaired(spark, sf):
    added = F.get(F.array(*(F.lit(pair[0]) for pair in _REPAIRS)), (F.col("doc_id") % 11).cast("int"))
    return corpus.pages(spark, sf).select("doc_id", repairs.clean(F.concat("text", added)).alias("value"))


_PLAIN = ["book_title", "subject", "title", "section", "unit", "work", "author", "section_path", "page_type", "purpose", "summary", "text", "outline_summary"]


def _structured(spark, sf):
    """Pages with their book and with nested content on some of them."""
    p = corpus.pages(spark, sf)
    rows = p.join(corpus.books(p).select("book_id", F.col("title").alias("book_title"), "subject"), "book_id")
    d, none = F.col("doc_id"), F.lit(None).cast("string")
    text = lambda c: F.lit(c) if c is not None else none
    figure = lambda kind, caption, said: F.struct(kind.alias("kind"), caption.alias("caption"), none.alias("description"), said.alias("figure_text"))
    figures = F.array(figure(F.col("lang"), F.col("title"), F.array(text("a"), F.col("section"))), figure(none, F.col("unit"), F.lit(None).cast("array<string>")))
    word = lambda term, pos, said: F.struct(term.alias("term"), pos.alias("pos"), said.alias("definition"))
    glossary = F.array(word(F.col("lang"), none, F.col("unit")), word(text("t"), text("n"), F.col("title")))
    dispatch = F.struct(text("page").alias("target"), F.lit(1).alias("printed_from"), F.lit(2).alias("printed_to"))
    activity = lambda to, asked: F.struct(text("read").alias("type"), F.col("title").alias("instruction"), none.alias("answer_format"), to.alias("dispatch"), asked.alias("questions"))
    activities = F.array(activity(dispatch, F.array(text("q1"), F.col("unit"))), activity(F.lit(None).cast("struct<target:string,printed_from:int,printed_to:int>"), F.lit(None).cast("array<string>")))
    exercises = F.array(F.struct(text("D").alias("letter"), F.col("title").alias("instruction"), F.array(F.struct(text("k").alias("kind"), F.col("unit").alias("stem")), F.struct(none.alias("kind"), text("s").alias("stem"))).alias("items")))
    nested = {"figures": F.when(d % 2 == 0, figures), "glossary": F.when(d % 3 == 0, glossary), "activities": F.when(d % 4 == 0, activities), "exercises": F.when(d % 5 == 0, exercises)}
    plain = {"work": F.when(d % 2 == 1, "a work"), "author": F.when(d % 3 == 1, F.col("lang")), "section_path": F.concat(F.lit("1/"), F.col("section")), "outline_summary": F.when(d % 7 == 0, F.col("summary"))}
    return rows.withColumns(plain).withColumns({k: v.cast(documents.NESTED[k]) for k, v in nested.items()})


@R.add(
    "SELECT doc_id, concat_ws(chr(10), 'Book ' || p.book_id, 'subject ' || right(p.book_id, 1), title, section, unit, CASE WHEN doc_id % 2 = 1 THEN 'a work' ELSE '' END, CASE WHEN doc_id % 3 = 1 THEN lang ELSE '' END, '1/' || section, page_type, purpose, summary, text, CASE WHEN doc_id % 7 = 0 THEN summary ELSE '' END, "
    "CASE WHEN doc_id % 2 = 0 THEN 'صورة ' || lang || ' ' || title || '  a ' || section || chr(10) || 'صورة  ' || unit || '  ' ELSE '' END, 'مفردات معجم' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN lang || '  ' || unit || ' t n ' || title ELSE '' END, "
    "'نشاط تمارين' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN 'read ' || title || '  page 1 2 q1 ' || unit || ' read ' || title || '  ' ELSE '' END, 'تمارين' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'التمرين D ' || title || ' k ' || unit || '  s' ELSE '' END) AS value FROM p"
)
def proj_whole_search_text(spark, sf):
    """All 17 parts, nested ones included."""
    return _structured(spark, sf).select("doc_id", documents.whole_search_text(_PLAIN).alias("value"))


@R.add("SELECT p.book_id, p.physical_page, CASE WHEN doc_id % 3 <> 0 THEN 'outline of ' || title END AS outlined, CASE WHEN doc_id % 4 = 0 THEN 'better ' || section END AS section, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS enriched FROM p")
def join_page_layers(spark, sf):
    """Pages with outline and enrichment; the outline has every fifth of its pages twice."""
    p = corpus.pages(spark, sf)
    outline = p.where("doc_id % 3 <> 0").select("book_id", "physical_page", F.concat(F.lit("outline of "), "title").alias("title"))
    outline = outline.unionByName(outline.where("physical_page % 5 = 0"))
    extra = p.where("doc_id % 4 = 0").select("book_id", "physical_page", F.concat(F.lit("better "), "section").alias("section"))
    rows = documents.with_layers(p.select("book_id", "physical_page", "text"), outline, extra)
    return rows.select("book_id", "physical_page", F.col("outline.title").alias("outlined"), F.col("extra.section").alias("section"), F.col("extra").isNotNull().cast("int").alias("enriched"))


@R.add("SELECT book_id, CAST(rank AS INTEGER) AS rank, value, n FROM (SELECT book_id, value, n, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, value) AS rank FROM (SELECT book_id, title AS value, count(*) AS n FROM p WHERE title <> '' GROUP BY 1, 2)) WHERE rank <= 5")
def qc_title_top5(spark, sf):
    return quality.top_values(corpus.pages(spark, sf), "title")


@R.add("SELECT book_id, CAST(rank AS INTEGER) AS rank, value, n FROM (SELECT book_id, value, n, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, value) AS rank FROM (SELECT book_id, page_type || '-' || doc_id % 9 AS value, count(*) AS n FROM p WHERE doc_id % 2 = 0 GROUP BY 1, 2)) WHERE rank <= 5")
def qc_type_top5(spark, sf):
    """The commonest page types that are no known one."""
    kind = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("-", "page_type", (F.col("doc_id") % 9).cast("string"))).otherwise(F.col("page_type"))
    odd = corpus.pages(spark, sf).withColumn("page_type", kind).where(~F.col("page_type").isin("cover", *corpus.PAGE_TYPES))
    return quality.top_values(odd, "page_type")
