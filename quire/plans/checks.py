"""The data-quality checks as queries, one each, and what rolls their findings up; they join the queries of ``library``.

The layers are those of ``corpus`` with faults of their own: ``y`` is the indexed layer with broken texts and statuses.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import checks, consistency, duplicates, quality, titles
from quire.plans import corpus
from quire.plans import sqltext as s
from quire.plans.library import _COUNT, _OUT, _SIG, R, _numbers
from quire.sources import tables

_EXPECTED = f"CASE WHEN length({s.strip('text')}) < 1 THEN 'no-text' WHEN {s.damaged('text')} THEN 'damaged-text' WHEN lang = 'de' THEN 'ocr-text' ELSE 'clean-extracted-text' END"
_KNOWN = (tx.NO_TEXT, tx.DAMAGED, tx.OCR, tx.CLEAN)
_RULES = [("src1", 5, 60, -4), ("src2", 1, 1000, -4), ("src3", 1, 1000, 3)]

Y = f""", y0 AS (
  SELECT * REPLACE (CASE WHEN doc_id % 59 = 0 THEN text || ' \ufffd' WHEN doc_id % 61 = 0 THEN text || ' x ^ 2 ' WHEN doc_id % 67 = 0 THEN text || ' هللا ' WHEN doc_id % 71 = 0 THEN text || ' گل ' ELSE text END AS text,
    CASE WHEN doc_id % 73 = 0 THEN '{{"text": 1}}' WHEN doc_id % 79 = 0 THEN '漢字' WHEN book_id = 'src4' THEN 'one title of all' WHEN doc_id % 9 = 0 THEN 'The Book ' || book_id || ' again' ELSE title END AS title,
    CASE WHEN book_id = 'src5' THEN substr(summary, 1, 3) ELSE summary END AS summary, CASE WHEN book_id = 'src6' AND doc_id % 2 = 0 THEN ' ' WHEN book_id = 'src7' THEN 'only one purpose' ELSE purpose END AS purpose,
    CASE WHEN book_id = 'src8' AND doc_id % 2 = 0 THEN '' WHEN book_id IN ('src2', 'src9') AND doc_id % 83 = 0 THEN 'a shared chapter of algebra' ELSE unit END AS unit,
    CASE WHEN book_id IN ('src1', 'src9') THEN 'one' ELSE section END AS section) FROM x),
y AS (SELECT *, CASE WHEN doc_id % 53 = 0 THEN NULL WHEN doc_id % 47 = 0 THEN 'ocr-text' ELSE {_EXPECTED} END AS status FROM y0)
"""


def _expected():
    return tx.evidence_status(F.col("text"), F.col("lang") == "de")


def _moved(p: DataFrame) -> DataFrame:
    """The pages, every tenth but one with the title of the page after it."""
    page = F.col("physical_page")
    titles_ = p.where(page % 10 != 9).select("book_id", page, "title").union(p.where(page % 10 == 0).select("book_id", (page - 1).alias("physical_page"), "title"))
    return p.drop("title").join(titles_, ["book_id", "physical_page"])


def _beyond(index: DataFrame) -> DataFrame:
    """Pages of two books under numbers that the source doesn't have."""
    return index.where("book_id in ('src2', 'src6') and physical_page <= 4").withColumn("physical_page", F.col("physical_page") + 1_000_000)


def _claiming(p: DataFrame) -> DataFrame:
    """Pages whose summaries claim to be of some book, every other one with the article, some with their own name too."""
    d = F.col("doc_id")
    said = F.concat(F.when(d % 2 == 0, "In كتاب Book src").otherwise("see: ملف الBook src"), (d % 12).cast("string"), F.when(d % 4 == 1, F.concat(F.lit(", or Book "), "book_id")).otherwise(F.lit(" (p. 3)")))
    return p.withColumn("summary", F.when(d % 31 == 0, said).otherwise(F.col("summary")))


#: Fields of a table's pages that claim to be of another book, with ``_claiming``'s summaries.
CLAIMS = (
    "SELECT book_id, physical_page, field, min(o.id) AS other FROM (SELECT book_id, physical_page, field, ' ' || " + s.word_fold("value") + " || ' ' AS v FROM (SELECT book_id, physical_page, 'title' AS field, title AS value FROM @pages UNION ALL SELECT book_id, physical_page, 'summary', CASE WHEN doc_id % 31 = 0 "
    "THEN CASE WHEN doc_id % 2 = 0 THEN 'In كتاب Book src' ELSE 'see: ملف الBook src' END || CAST(doc_id % 12 AS VARCHAR) || CASE WHEN doc_id % 4 = 1 THEN ', or Book ' || book_id ELSE ' (p. 3)' END ELSE summary END FROM @pages)) f "
    "JOIN (SELECT book_id AS id, lower(title) AS name FROM b) o ON o.id <> f.book_id AND (contains(v, ' كتاب ' || name || ' ') OR contains(v, ' كتاب ال' || name || ' ') OR contains(v, ' ملف ' || name || ' ') OR contains(v, ' ملف ال' || name || ' ')) "
    "WHERE NOT contains(v, ' book ' || lower(f.book_id) || ' ') GROUP BY ALL"
)


def _last():
    return F.ascii(F.right("book_id", F.lit(1))) % 5


def _arrays() -> dict:
    return {"numbers": tx.digit_runs(F.col("text")), "braces": F.regexp_extract_all("text", F.lit("[{}]"), 0)}


class _Layers:
    """The tables that the checks read."""

    def __init__(self, spark, sf):
        self.spark, self.source = spark, corpus.pages(spark, sf)
        self.index, self.books = corpus.index(self.source), corpus.books(self.source)
        d, book = F.col("doc_id"), F.col("book_id")
        hurt = F.when(d % 59 == 0, F.concat("text", F.lit(" \ufffd"))).when(d % 61 == 0, F.concat("text", F.lit(" x ^ 2 "))).when(d % 67 == 0, F.concat("text", F.lit(" هللا "))).when(d % 71 == 0, F.concat("text", F.lit(" گل "))).otherwise(F.col("text"))
        title = F.when(d % 73 == 0, '{"text": 1}').when(d % 79 == 0, "漢字").when(book == "src4", "one title of all").when(d % 9 == 0, F.concat(F.lit("The Book "), book, F.lit(" again"))).otherwise(F.col("title"))
        changed = self.index.withColumns({
            "text": hurt, "title": title, "summary": F.when(book == "src5", F.substring("summary", 1, 3)).otherwise(F.col("summary")),
            "purpose": F.when((book == "src6") & (d % 2 == 0), " ").when(book == "src7", "only one purpose").otherwise(F.col("purpose")),
            "unit": F.when((book == "src8") & (d % 2 == 0), "").when(book.isin("src2", "src9") & (d % 83 == 0), "a shared chapter of algebra").otherwise(F.col("unit")),
            "section": F.when(book.isin("src1", "src9"), "one").otherwise(F.col("section")),
        })
        self.path = path = [f"{sf}/documents.parquet"]
        # what several checks read is worked out once, and each reads its own columns of it
        self.y = tables.derived(spark, "checked", path, lambda: changed.withColumn("expected", _expected()).withColumn("status", F.when(d % 53 == 0, None).when(d % 47 == 0, tx.OCR).otherwise(F.col("expected"))))
        self.books = tables.derived(spark, "books", path, lambda: corpus.books(self.source))
        self.verdicts = tables.derived(spark, "verdicts", path, lambda: _numbers(spark, sf))

    @property
    def sized(self) -> DataFrame:
        """Lengths of what both layers hold."""
        return tables.derived(self.spark, "sizes", self.path, lambda: consistency.sizes(self.source, self.index))

    @property
    def marks(self) -> DataFrame:
        """What the checks see in a page of the indexed layer."""
        return tables.derived(self.spark, "marks", self.path, lambda: checks.marks(self.y, F.col("expected"), _KNOWN, corpus.PAGE_TYPES, "src[0-9]$", ["title", "summary"]))

    @property
    def signed(self) -> DataFrame:
        """What the checks see in a page of the source."""
        return tables.derived(self.spark, "signed", self.path, lambda: self.source.select("book_id", duplicates.signature(F.col("text")).alias("s"), *(c.alias(n) for n, c in _arrays().items())))

    def rows(self, values, schema) -> DataFrame:
        return self.spark.createDataFrame(values, schema)


def _n(where: str, table: str = "y") -> str:
    return f"(SELECT book_id, count(*) AS n FROM {table} WHERE {where} GROUP BY book_id)"


def _share(field: str) -> str:
    return f"(SELECT book_id, max(n) / sum(n) AS share FROM (SELECT book_id, {field}, count(*) AS n FROM y WHERE {field} <> '' GROUP BY ALL) GROUP BY book_id)"


_F = lambda code, severity, body: f"SELECT book_id, '{code}' AS code, {severity} AS severity FROM {body}"
_ALL = lambda *parts: " UNION ALL ".join(parts)
_PRIVATE = "\ufffd|[\\x{E000}-\\x{F8FF}]"
_FIELD = lambda fields: " UNION ALL ".join(f"SELECT book_id, '{f}' AS field, {f} AS v FROM y" for f in fields)
_LINE = f"list_transform(string_split(p.text, chr(10)), lambda e: {s.flat('e')})"
_LOSS = (
    f"(SELECT book_id, count(*) FILTER (WHERE lost > 0) AS pages, sum(lost) / sum(size) AS share FROM (SELECT book_id, length(e) AS size, CASE WHEN length(i) < length(e) * 0.98::DOUBLE THEN coalesce(list_sum(list_transform(list_filter(l, lambda k: length(k) >= 25 AND NOT contains(i, substr(k, 1, 40))), lambda k: length(k))), 0) ELSE 0 END AS lost "
    f"FROM (SELECT p.book_id, {s.flat('p.text')} AS e, {_LINE} AS l, {s.flat('x.text')} AS i FROM p JOIN x USING (book_id, physical_page)) WHERE length(e) >= 20) GROUP BY book_id)"
)
_PIECE = lambda name, sign, fold, size, few: (
    f"SELECT book_id, doc_id, size, '{name}' AS kind, unnest(ps) AS piece FROM (SELECT book_id, doc_id, length(text) AS size, list_filter(list_transform(regexp_split_to_array(text, '{sign}'), lambda e: {fold('e')}), lambda e: length(e) >= {size}) AS ps FROM y WHERE length(text) >= 20) WHERE len(ps) >= {few}"
)
_REPEAT = (
    f"(SELECT book_id, {s.round_half_up('avg(share)', 4)} AS mean, {s.round_half_up('max(share)', 4)} AS peak FROM (SELECT book_id, doc_id, max(extra / size) AS share FROM (SELECT book_id, doc_id, size, kind, sum((n - 1) * length(piece)) AS extra FROM (SELECT book_id, doc_id, size, kind, piece, count(*) AS n FROM "
    f"({_PIECE('line', chr(10), s.flat, 12, 4)} UNION ALL {_PIECE('clause', '[.!؟?' + chr(10) + '،؛;]', s.rule_fold, 30, 2)}) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) WHERE share > 0 GROUP BY book_id)"
)
_UNITS = (
    f"(SELECT k.book_id, count(*) AS n FROM (SELECT y.book_id, list_distinct(list_filter(string_split({s.rule_fold('y.unit')}, ' '), lambda e: length(e) >= 3)) AS ws, string_split({s.rule_fold('text')}, ' ') AS body FROM y JOIN (SELECT unit FROM y WHERE {s.strip('unit')} <> '' AND NOT regexp_matches(unit, '{checks.GENERIC_UNIT}') GROUP BY unit HAVING count(DISTINCT book_id) > 1) o ON y.unit = o.unit) k "
    "WHERE len(list_filter(ws, lambda e: list_contains(body, e))) / greatest(len(ws), 1) < 0.8 GROUP BY k.book_id)"
)
_HEAD = "list_filter(string_split(t, ' '), lambda e, i: length(e) >= 4 AND list_position(string_split(t, ' '), e) = i)[1:6]"
_DRIFT = (
    f"(SELECT book_id, count(*) AS n FROM (SELECT d.book_id, {_HEAD} AS head, d.w, concat_ws(' ', a.w, z.w) AS near FROM d LEFT JOIN (SELECT book_id, physical_page, w FROM d) a ON a.book_id = d.book_id AND a.physical_page = d.physical_page - 1 LEFT JOIN (SELECT book_id, physical_page, w FROM d) z ON z.book_id = d.book_id AND z.physical_page = d.physical_page + 1) "
    "WHERE len(head) >= 3 AND w <> '' AND near <> '' AND len(list_filter(head, lambda e: contains(w, e))) / len(head) < 0.34 AND len(list_filter(head, lambda e: contains(near, e))) / len(head) >= 0.67 GROUP BY book_id)"
)
_TOTALS = f"(SELECT book_id, sum(len({s.digit_runs('text')})) AS numbers, sum(len(regexp_extract_all(text, '[{{}}]'))) AS braces FROM p GROUP BY book_id)"

#: Code, the check over the layers, and its SQL: what comes before it as further tables, and the select.
CHECKS = {
    "A1": (
        lambda t: checks.a1_presence(t.source, t.index.where("not (book_id = 'src1' and doc_id % 3 = 0)").unionByName(_beyond(t.index)), t.books), "",
        "SELECT book_id, 'A1' AS code, unnest(list_filter([CASE WHEN p.n > coalesce(i.n, 0) THEN 'high' END, CASE WHEN far.n > 0 THEN 'high' END, CASE WHEN p.n > coalesce(i.n, 0) + coalesce(far.n, 0) THEN 'medium' END, CASE WHEN declared_count <> p.n THEN 'low' END], lambda e: e IS NOT NULL)) AS severity "
        f"FROM {_n('TRUE', 'p')} p LEFT JOIN {_n("NOT (book_id = 'src1' AND doc_id % 3 = 0)", 'x')} i USING (book_id) LEFT JOIN {_n("book_id IN ('src2', 'src6') AND physical_page <= 4", 'x')} far USING (book_id) JOIN b USING (book_id)",
    ),
    "A2": (lambda t: checks.a2_lost(t.source, t.index), "", "SELECT DISTINCT book_id, 'A2' AS code, 'critical' AS severity FROM p JOIN x USING (book_id, physical_page) WHERE p.text_length >= 20 AND length(x.text) < 20"),
    "A3": (lambda t: checks.a3_cut(t.source, t.index, t.sized), "", _F("A3", "CASE WHEN share > 0.15 THEN 'high' WHEN share > 0.05 THEN 'medium' ELSE 'low' END", _LOSS) + " WHERE pages > 0"),
    "A4": (
        lambda t: checks.a4_corrupt(t.y), f", k AS (SELECT book_id, {_COUNT(chr(0xFFFD))} AS a, {_COUNT(r'[\x{E000}-\x{F8FF}]')} AS b, {_COUNT(quality.BROKEN_NAMES)} AS c, {_COUNT('[پچژگکی]')} AS d, {_COUNT(_OUT)} AS e, sum(length(text)) AS n FROM y GROUP BY book_id)",
        "SELECT book_id, 'A4' AS code, unnest(list_filter([CASE WHEN a > 0 THEN 'high' END, CASE WHEN b > 0 THEN 'high' END, CASE WHEN c > 0 THEN 'high' END, CASE WHEN d > 0 THEN 'medium' END, CASE WHEN e > 0.02 * n THEN 'medium' END], lambda v: v IS NOT NULL)) AS severity FROM k",
    ),
    "A5": (lambda t: checks.a5_repeated(t.y), "", _F("A5", "CASE WHEN peak > 0.2 OR mean > 0.15 THEN 'high' ELSE 'medium' END", _REPEAT) + " WHERE peak > 0.1 OR mean > 0.05"),
    "A6": (
        lambda t: checks.a6_math(t.y), "",
        _F("A6", "CASE WHEN share > 0.3 THEN 'high' WHEN share > 0.1 THEN 'medium' ELSE 'low' END", f"(SELECT book_id, {s.round_half_up(f"count(*) FILTER (WHERE regexp_matches(text, '{quality.BROKEN_MATH}')) / count(*)", 4)} AS share, count(*) FILTER (WHERE regexp_matches(text, '{quality.BROKEN_MATH}')) AS n FROM y GROUP BY book_id)") + " WHERE n > 0",
    ),
    "A7": (
        lambda t: checks.a7_no_text(t.y), f", k AS (SELECT book_id, {s.strip('text')} = '' AS e, {s.strip('title || summary')} <> '' AS d FROM y)",
        _F("A7", "CASE WHEN share > 0.1 OR d > 0 THEN 'high' ELSE 'medium' END", f"(SELECT book_id, {s.round_half_up('count(*) FILTER (WHERE e) / count(*)')} AS share, count(*) FILTER (WHERE e) AS n, count(*) FILTER (WHERE e AND d) AS d FROM k GROUP BY book_id)") + " WHERE n > 0",
    ),
    "A8": (
        lambda t: checks.a8_status(t.y, F.col("expected"), _KNOWN), "",
        _F("A8", "CASE WHEN m = n AND w = 0 THEN 'medium' ELSE 'high' END", f"(SELECT book_id, count(*) AS n, count(*) FILTER (WHERE status IS NULL) AS m, count(*) FILTER (WHERE status <> {_EXPECTED}) AS w FROM y GROUP BY book_id)") + " WHERE m + w > 0",
    ),
    "B7": (
        lambda t: checks.b7_leaks(t.y, ["title", "summary"]), f", f AS ({_FIELD(('title', 'summary'))}), k AS (SELECT book_id, CASE WHEN regexp_matches(v, '^[ \\t\\n]*[\\[{{][ \\t\\n]*\"') THEN 'json' WHEN regexp_matches(v, '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}]') THEN 'cjk' END AS leak FROM f)",
        "SELECT book_id, 'B7' AS code, CASE WHEN count(*) FILTER (WHERE leak = 'json') > 0 THEN 'critical' ELSE 'high' END AS severity FROM k WHERE leak IS NOT NULL GROUP BY book_id",
    ),
    "B8": (lambda t: checks.b8_numbers(t.verdicts), None, "SELECT DISTINCT book_id, 'B8' AS code, 'high' AS severity FROM ({numbers}) WHERE verdict IN ('unverified', 'layerless')"),
    "B9": (lambda t: checks.b9_types(t.y, corpus.PAGE_TYPES), "", _F("B9", "CASE WHEN n > 0.2 * m THEN 'high' ELSE 'medium' END", "(SELECT book_id, count(*) FILTER (WHERE page_type = 'cover') AS n, count(*) AS m FROM y GROUP BY book_id)") + " WHERE n > 0"),
    "B10": (
        lambda t: checks.b10_misattributed(_claiming(t.y), t.books, ["title", "summary"], t.books.where("page_count > 1000000000").select("book_id"), t.books.where(f"{corpus.TURN} % 3 <> 1").select("book_id")), "",
        _ALL(_F("B10", "CASE WHEN n > 5 THEN 'high' ELSE 'medium' END", f"(SELECT book_id, count(*) AS n FROM ({CLAIMS.replace('@pages', 'y')}) GROUP BY book_id)"), "SELECT 'library', 'B10', 'high' FROM (SELECT count(*) AS n FROM b WHERE page_count > 1000000000) WHERE n = 0", f"SELECT 'library', 'B10', 'medium' FROM (SELECT count(*) AS n FROM b WHERE {corpus.TURN} % 3 = 1) WHERE n > 0"),
    ),
    "B11": (lambda t: checks.b11_unquotable(t.y, "src[0-9]$"), "", _F("B11", "'critical'", _n(f"regexp_matches(book_id, 'src[0-9]$') AND regexp_matches(text, '{_PRIVATE}')"))),
    "B14": (
        lambda t: checks.b14_drifted(_moved(t.source)),
        f", d AS (SELECT p.book_id, p.physical_page, {s.word_fold('q.title')} AS t, {s.word_fold('p.text')} AS w FROM p JOIN p q ON p.book_id = q.book_id AND q.physical_page = p.physical_page + CASE WHEN p.physical_page % 10 = 9 THEN 1 ELSE 0 END)",
        _F("B14", "'medium'", _DRIFT),
    ),
    "C12": (
        lambda t: checks.c12_boilerplate(t.y, ["summary", "purpose", "title"]), "",
        _F("C12", "CASE WHEN share > 0.9 THEN 'high' ELSE 'medium' END", f"(SELECT book_id, max(share) AS share FROM ({_ALL(*(f'SELECT * FROM {_share(f)}' for f in ('summary', 'purpose', 'title')))}) GROUP BY book_id)") + " WHERE share > 0.5",
    ),
    "C13": (
        lambda t: checks.c13_coverage(t.y), ", r AS (SELECT book_id, length(summary) / length(text) AS v FROM y WHERE length(text) >= 20), o AS (SELECT book_id, v, row_number() OVER (PARTITION BY book_id ORDER BY v) AS pos, count(*) OVER (PARTITION BY book_id) AS n FROM r)",
        _F("C13", "CASE WHEN v < 0.015 THEN 'high' ELSE 'medium' END", f"(SELECT book_id, {s.round_half_up('v', 4)} AS v FROM o WHERE pos = n // 2 + 1)") + " WHERE v < 0.03",
    ),
    "C14": (
        lambda t: checks.c14_purpose(t.y), "",
        _F("C14", "CASE WHEN share > 0.9 THEN 'high' ELSE 'medium' END", f"(SELECT book_id, count(*) AS n, count(*) FILTER (WHERE {s.strip('purpose')} = '') AS e FROM y GROUP BY book_id) LEFT JOIN {_share('purpose')} USING (book_id)") + " WHERE share > 0.9 OR e > 0.2 * n",
    ),
    "C15": (
        lambda t: checks.c15_units(t.y), "",
        _F("C15", "CASE WHEN f.n > 0 THEN 'high' ELSE 'medium' END", f"(SELECT book_id, count(*) AS m, count(*) FILTER (WHERE {s.strip('unit')} = '') AS e FROM y GROUP BY book_id) LEFT JOIN {_UNITS} f USING (book_id)") + " WHERE f.n > 0 OR e > 0.3 * m",
    ),
    "C16": (lambda t: checks.c16_section(t.y), "", _F("C16", "CASE WHEN n > 50 THEN 'high' ELSE 'medium' END", "(SELECT book_id, count(*) AS n, count(DISTINCT section) AS k FROM y GROUP BY book_id)") + " WHERE k <= 1 AND n > 1"),
    "C21": (
        lambda t: checks.c21_book_title(t.y, t.books), f", f AS (SELECT y.book_id, page_type, {s.rule_fold('y.title')} AS t, {s.rule_fold('b.title')} AS name FROM y JOIN b ON y.book_id = b.book_id)",
        _F("C21", "CASE WHEN k > 0.3 * n THEN 'high' ELSE 'medium' END", "(SELECT book_id, count(*) AS n, count(*) FILTER (WHERE t <> '' AND length(t) >= 12 AND (contains(t, name) OR contains(name, t)) AND page_type NOT IN ('divider', 'contents')) AS k FROM f GROUP BY book_id)") + " WHERE k > 0",
    ),
    "D17": (
        lambda t: checks.d17_guessed(t.source.withColumn("printed_page", F.when(F.col("doc_id") % 2 == 0, F.col("printed_page"))), t.y, t.rows(_RULES, "book_id string, first int, last int, shift int")), "",
        f"SELECT DISTINCT y.book_id, 'D17' AS code, 'high' AS severity FROM y JOIN (VALUES {', '.join(map(str, _RULES))}) r(book_id, first, last, shift) ON y.book_id = r.book_id WHERE (doc_id % 2 <> 0 OR printed_page IS NULL) AND physical_page BETWEEN first AND last AND printed_page = physical_page + shift",
    ),
    "D18": (
        lambda t: checks.d18_stale(
            t.books.select("book_id", F.lit("outline").alias("layer"), F.expr(f"{corpus.TURN} % 4 - 1").alias("hours")),
            t.source.where("doc_id % 29 = 0").select("book_id", "physical_page", F.when(F.col("doc_id") % 2 == 0, "صفحة مصورة").otherwise("fine").alias("description")), t.y,
        ), "",
        _ALL(f"SELECT book_id, 'D18' AS code, 'medium' AS severity FROM b WHERE {corpus.TURN} % 4 > 1", _F("D18", "'high'", _n(f"doc_id % 58 = 0 AND length({s.strip('text')}) >= 20"))),
    ),
    "D19": (
        lambda t: checks.d19_structured(titles.structured_totals(t.source, _arrays()), t.books.where(f"{corpus.TURN} % 3 <> 0")), f", z AS {_TOTALS}",
        _ALL(f"SELECT book_id, 'D19' AS code, 'medium' AS severity FROM b WHERE {corpus.TURN} % 3 = 0", "SELECT book_id, 'D19', 'medium' FROM z WHERE numbers = 0 OR braces = 0", f"SELECT 'library', 'D19', 'medium' FROM (SELECT count(*) AS n FROM b WHERE {corpus.TURN} % 3 = 0) WHERE n > 0"),
    ),
    "D20": (
        lambda t: checks.d20_checksum(
            t.books.select("book_id", F.col("page_count").alias("bytes"), F.when(_last() == 1, "").when(_last() == 2, "none").otherwise(F.sha2("book_id", 256)).alias("checksum")),
            t.books.select(F.sha2("book_id", 256).alias("digest"), F.when(_last() == 3, F.col("page_count") + 1).otherwise(F.col("page_count")).alias("bytes")),
        ), "",
        "SELECT book_id, 'D20' AS code, CASE WHEN ascii(right(book_id, 1)) % 5 = 2 THEN 'critical' ELSE 'high' END AS severity FROM b WHERE ascii(right(book_id, 1)) % 5 IN (1, 2, 3)",
    ),
    "D21": (
        lambda t: checks.d21_dead(t.books.select(F.col("book_id").alias("layer")), t.source.where("lang = 'fr' and doc_id % 7 = 0").select(F.col("book_id").alias("layer"), F.col("doc_id").alias("reader"))), "",
        "SELECT 'library' AS book_id, 'D21' AS code, 'high' AS severity FROM b WHERE book_id NOT IN (SELECT book_id FROM p WHERE lang = 'fr' AND doc_id % 7 = 0)",
    ),
    "D22": (
        lambda t: checks.d22_duplicated(t.source), _SIG,
        "SELECT 'library' AS book_id, 'D22' AS code, 'medium' AS severity FROM (SELECT a.book_id AS l, c.book_id AS r, count(*) AS shared FROM o a JOIN o c ON a.f = c.f AND a.book_id < c.book_id GROUP BY ALL HAVING count(*) >= 3)",
    ),
}


def _whole(code: str) -> str:
    """A check's select, with its further tables inside it, so that selects can be united."""
    _, more, select = CHECKS[code]
    if more is None:  # the verdicts' own query, less the tables that come before it
        return select.format(numbers=R.sql["qc_number_verdicts"].removeprefix(corpus.BASE).replace(", q AS", "WITH q AS", 1))
    return f"SELECT * FROM ({'WITH ' + more.removeprefix(', ') + ' ' if more else ''}{select})"


def _check(code: str):
    def run(spark, sf):
        return CHECKS[code][0](_Layers(spark, sf))

    run.__name__ = f"qc_check_{code.lower()}"
    return run


for _code in CHECKS:
    R.add(Y + _whole(_code))(_check(_code))


@R.add("SELECT book_id, {0} AS hits, count(*) FILTER (WHERE regexp_matches(text, '{1}')) AS pages, {2} AS share FROM (SELECT * REPLACE (CASE WHEN doc_id % 61 = 0 THEN text || ' x ^ 2 ' ELSE text END AS text) FROM p) GROUP BY book_id".format(_COUNT(quality.BROKEN_MATH), quality.BROKEN_MATH, s.round_half_up(f"count(*) FILTER (WHERE regexp_matches(text, '{quality.BROKEN_MATH}')) / count(*)", 4)))
def qc_broken_math(spark, sf):
    p = corpus.pages(spark, sf)
    return quality.broken_math(p.withColumn("text", F.when(F.col("doc_id") % 61 == 0, F.concat("text", F.lit(" x ^ 2 "))).otherwise(F.col("text"))))


@R.add(" " + CLAIMS.replace("@pages", "p"))
def qc_claims(spark, sf):
    p = corpus.pages(spark, sf)
    return quality.claims(_claiming(p), corpus.books(p).select("book_id", F.col("title").alias("name")), ["title", "summary"])


# ---- roll-up ----


def findings(spark, sf) -> DataFrame:
    """All findings of all checks, worked out once; checks that look into texts read what one pass over each layer has seen in its pages."""

    def make() -> DataFrame:
        layers = _Layers(spark, sf)
        marks, signed = layers.marks, layers.signed
        measured = tables.derived(spark, "measures", layers.path, lambda: checks.measures(marks))
        enriched = layers.books.where(f"{corpus.TURN} % 3 <> 0")
        own = {
            "A5": lambda: checks.a5_of(quality.mean_repeats(quality.together(marks, layers.y))),
            "C13": lambda: checks.c13_of(quality.coverage(marks.where("characters >= 20").select("book_id", (F.col("summary") / F.col("characters")).alias("r")))),
            "C14": lambda: checks.c14_purpose(layers.y, measured), "C15": lambda: checks.c15_units(layers.y, measured=measured),
            "D19": lambda: checks.d19_structured(titles.structured_totals(signed, {n: F.col(n) for n in _arrays()}), enriched), "D22": lambda: checks.d22_of(duplicates.shared_pairs(signed)),
        }
        rest = (own[code]() if code in own else run(layers) for code, (run, _, _) in CHECKS.items() if code not in checks.MEASURED)
        return reduce(DataFrame.unionByName, rest, checks.of_measures(measured))

    return tables.derived(spark, "findings", [f"{sf}/documents.parquet"], make)


_FIND = Y + ", find AS (" + " UNION ALL ".join(map(_whole, CHECKS)) + f"""),
sc AS (SELECT b.book_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM b LEFT JOIN find ON b.book_id = find.book_id GROUP BY b.book_id),
score AS (SELECT *, {s.round_half_up('100 - least(80.0::DOUBLE, critical * 12.0::DOUBLE + high * 6.0::DOUBLE + medium * 2.5::DOUBLE + low * 1.0::DOUBLE)')} AS score FROM sc)
"""


@R.add(_FIND + "SELECT * FROM find")
def qc_findings_union(spark, sf):
    return findings(spark, sf)


def _scores(spark, sf):
    return quality.book_scores(_Layers(spark, sf).books, findings(spark, sf))


@R.add(_FIND + "SELECT * FROM score")
def qc_book_scores(spark, sf):
    return _scores(spark, sf)


@R.add(_FIND + "SELECT * FROM score ORDER BY critical DESC, high DESC, medium DESC, low DESC, score, book_id LIMIT 5")
def qc_book_ranking(spark, sf):
    return quality.ranking(_scores(spark, sf)).limit(5)


@R.add(
    _FIND + f", c AS (SELECT unnest({list(CHECKS)}) AS code), w AS (SELECT code, max(CASE severity WHEN 'critical' THEN 2 WHEN 'high' THEN 1 ELSE 0 END) AS worst FROM find GROUP BY code) "
    f"SELECT count(*) AS checks, count(*) FILTER (WHERE worst IS NULL) AS clean, {s.round_half_up('sum(CASE coalesce(worst, 0) WHEN 0 THEN 5.0 WHEN 1 THEN 2.5 ELSE 0.0 END) / (count(*) * 5) * 100')}::DOUBLE AS score, (SELECT {s.round_half_up('avg(score)')} FROM score) AS book_mean FROM c LEFT JOIN w USING (code)"
)
def qc_library_score(spark, sf):
    return quality.library_score(spark.createDataFrame([(c,) for c in CHECKS], "code string"), findings(spark, sf), _scores(spark, sf))


@R.add(_FIND + "SELECT book_id, code FROM find WHERE severity = 'critical' ORDER BY book_id, code")
def qc_review_queue(spark, sf):
    return findings(spark, sf).where("severity = 'critical'").select("book_id", "code").orderBy("book_id", "code")


@R.add(_FIND + "SELECT (SELECT count(*) FROM find WHERE severity = 'critical') AS critical, n AS unverified, (SELECT count(*) FROM find WHERE severity = 'critical') > 0 OR n > 0 AS blocked FROM (SELECT count(*) AS n FROM (" + R.sql["qc_number_verdicts"].removeprefix(corpus.BASE).replace(", q AS", "WITH q AS", 1) + ") WHERE verdict = 'unverified')")
def qc_gate(spark, sf):
    return quality.gate(findings(spark, sf), _Layers(spark, sf).verdicts)
