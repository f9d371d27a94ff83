"""The library's tools as SQL table functions: callable by name from ``spark.sql``, planned by Catalyst like any other query.

``register`` makes temporary views of the tables and the functions over them. Where a call can't be answered, the one row says
why: ``code`` is null for an answer, and the other columns are null for a refusal.
"""

from pyspark.sql import DataFrame, SparkSession

# fixed values: why a call is refused
CODES = ("EMPTY_QUERY", "INVALID_BOOK_ID", "BOOK_NOT_FOUND", "PAGE_REQUIRED", "AMBIGUOUS_PRINTED_PAGE", "PAGE_NOT_FOUND", "PAGE_NUMBER_CONFLICT", "AMBIGUOUS_PAGE_RANGE", "INVALID_PAGE_RANGE", "UNKNOWN_TOOL")
PREFIX = "quire_"
FIELDS = ("text", "title", "summary", "unit", "section", "purpose")

_FOLD = "translate(regexp_replace(lower(coalesce({0}, '')), '[\\\\u064B-\\\\u065F\\\\u0670]', ''), 'إأآٱـ', 'اااا')"
_BAD_BOOK = "CASE WHEN NOT coalesce(x.book, '') RLIKE '(?i)^[a-z0-9][a-z0-9-]{1,80}$' THEN 'INVALID_BOOK_ID' WHEN x.known IS NULL THEN 'BOOK_NOT_FOUND' {more}END AS code"
_PAGE = "code STRING, book_id STRING, physical_page INT, printed_page INT, title STRING, text STRING"
_SHOWN = "SELECT e.code, g.book_id, g.physical_page, g.printed_page, g.title, g.text FROM "


def _asked(parameters: str, more: str = "") -> str:
    """One row: what was asked, and why it is refused. Parameters are read here alone, as they aren't seen deeper down."""
    given = ", ".join(f"{{f}}.{c} AS {c}" for c in parameters.split())
    return f"(SELECT x.*, {_BAD_BOOK.replace('{more}', more)} FROM (SELECT a.*, b.book_id AS known FROM (SELECT {given}) a LEFT JOIN {{p}}books b ON b.book_id = a.book) x) e"


_ASKED_PAGE = (
    "(SELECT x.*, " + _BAD_BOOK.replace("{more}", "WHEN x.physical IS NULL AND x.printed IS NULL THEN 'PAGE_REQUIRED' WHEN size(x.found) > 1 THEN 'AMBIGUOUS_PRINTED_PAGE' WHEN size(x.found) = 0 THEN 'PAGE_NOT_FOUND' WHEN x.printed IS NOT NULL AND NOT coalesce(get(x.found, 0).printed_page = x.printed, FALSE) THEN 'PAGE_NUMBER_CONFLICT' ")
    + " FROM (SELECT a.book, a.physical, a.printed, max(b.book_id) AS known, collect_list(CASE WHEN g.book_id IS NOT NULL THEN struct(g.physical_page, g.printed_page) END) AS found FROM (SELECT {f}.book AS book, {f}.physical AS physical, {f}.printed AS printed) a LEFT JOIN {p}books b ON b.book_id = a.book "
    "LEFT JOIN {p}pages g ON g.book_id = a.book AND (g.physical_page = a.physical OR a.physical IS NULL AND g.printed_page = a.printed) GROUP BY a.book, a.physical, a.printed) x) e"
)
_ASKED_RANGE = _asked(
    "book physical_from physical_to printed_from printed_to",
    "WHEN (x.physical_from IS NOT NULL OR x.physical_to IS NOT NULL) AND (x.printed_from IS NOT NULL OR x.printed_to IS NOT NULL) THEN 'AMBIGUOUS_PAGE_RANGE' "
    "WHEN coalesce(x.physical_to, x.printed_to) IS NULL OR coalesce(x.physical_from, x.printed_from) IS NULL OR coalesce(x.physical_to, x.printed_to) < coalesce(x.physical_from, x.printed_from) THEN 'INVALID_PAGE_RANGE' ",
)
_JOINED = " LEFT JOIN {p}pages g ON e.code IS NULL AND g.book_id = e.book AND "


def _of_books(given: str, known: str) -> str:
    """Whether a book is of the subject and the track that are given; empty ones ask nothing."""
    subject = f"coalesce({given}subject, '') = '' OR contains({_FOLD.format(f"concat({known}subject, ' ', {known}title)")}, {_FOLD.format(f'{given}subject')})"
    track = f"coalesce({given}track, '') = '' OR {_FOLD.format(f"coalesce(nullif({known}track, ''), 'general')")} = {_FOLD.format(f'{given}track')}"
    return f"({subject}) AND ({track})"


_ANY = "(" + " OR ".join(f"coalesce(contains(v.{c}, t), FALSE)" for c in FIELDS) + ")"
_NAMED = ", ".join(f"CASE WHEN contains(v.{c}, t) THEN '{c}' END" for c in FIELDS)

#: name: (parameters, columns, query); every function can be called with named arguments.
TOOLS = {
    "list_books": (
        "subject STRING DEFAULT '', track STRING DEFAULT ''", "book_id STRING, title STRING, subject STRING, track STRING, page_count BIGINT",
        "SELECT b.book_id, b.title, b.subject, b.track, b.page_count FROM (SELECT {f}.subject AS subject, {f}.track AS track) a JOIN {p}books b ON " + _of_books("a.", "b."),
    ),
    "get_book": (
        "book STRING", "code STRING, book_id STRING, physical_page INT, printed_page INT, title STRING, page_type STRING",
        "SELECT e.code, g.book_id, g.physical_page, g.printed_page, g.title, g.page_type FROM " + _asked("book") + _JOINED + "TRUE",
    ),
    "search_books": (
        "query STRING, match STRING DEFAULT 'any', book STRING DEFAULT '', subject STRING DEFAULT '', track STRING DEFAULT ''", "code STRING, book_id STRING, physical_page INT, matched_terms ARRAY<STRING>, matched_in ARRAY<STRING>",
        f"SELECT a.code, v.book_id, v.physical_page, CASE WHEN v.book_id IS NOT NULL THEN filter(a.terms, t -> {_ANY}) END, CASE WHEN v.book_id IS NOT NULL THEN array_distinct(flatten(transform(a.terms, t -> filter(array({_NAMED}), n -> n IS NOT NULL)))) END "
        "FROM (SELECT {f}.match AS match, {f}.book AS book, {f}.subject AS subject, {f}.track AS track, CASE WHEN trim(coalesce({f}.query, '')) = '' THEN 'EMPTY_QUERY' END AS code, filter(CASE WHEN {f}.match = 'phrase' THEN array(" + _FOLD.format("{f}.query") + ") ELSE split(" + _FOLD.format("{f}.query") + ", ' +') END, t -> t <> '') AS terms) a "
        "LEFT JOIN (SELECT w.*, b.subject AS of_subject, b.title AS of_title, b.track AS of_track FROM {p}folded w JOIN {p}books b ON b.book_id = w.book_id) v ON a.code IS NULL AND (coalesce(a.book, '') = '' OR v.book_id = a.book) AND " + _of_books("a.", "v.of_")
        + f" AND CASE WHEN a.match = 'all' THEN size(a.terms) > 0 AND forall(a.terms, t -> {_ANY}) ELSE exists(a.terms, t -> {_ANY}) END WHERE a.code IS NOT NULL OR v.book_id IS NOT NULL",
    ),
    "read_page": ("book STRING, physical INT DEFAULT NULL, printed INT DEFAULT NULL", _PAGE, _SHOWN + _ASKED_PAGE + _JOINED + "g.physical_page = get(e.found, 0).physical_page"),
    "get_page_neighbors": ("book STRING, physical INT DEFAULT NULL, printed INT DEFAULT NULL", _PAGE, _SHOWN + _ASKED_PAGE + _JOINED + "g.physical_page BETWEEN get(e.found, 0).physical_page - 1 AND get(e.found, 0).physical_page + 1"),
    "read_pages_range": (
        "book STRING, physical_from INT DEFAULT NULL, physical_to INT DEFAULT NULL, printed_from INT DEFAULT NULL, printed_to INT DEFAULT NULL", _PAGE,
        _SHOWN + _ASKED_RANGE + _JOINED + "(g.physical_page BETWEEN e.physical_from AND e.physical_to OR g.printed_page BETWEEN e.printed_from AND e.printed_to)",
    ),
}


def register(spark: SparkSession, pages: DataFrame, books: DataFrame, folded: DataFrame | None = None, prefix: str = PREFIX) -> list[str]:
    """Register the tools over a library's tables; their names. pages: the page table, folded: its searchable view, without which there is no search."""
    for name, df in (("pages", pages), ("books", books), ("folded", folded)):
        if df is not None:
            df.createOrReplaceTempView(f"{prefix}{name}")
    ready = {name: tool for name, tool in TOOLS.items() if folded is not None or "{p}folded" not in tool[2]}
    for name, (parameters, columns, query) in ready.items():
        body = query.replace("{p}", prefix).replace("{f}", f"{prefix}{name}")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return [f"{prefix}{name}" for name in ready]


def call(spark: SparkSession, tool: str, prefix: str = PREFIX, **arguments) -> DataFrame:
    """A tool by its name, as a caller gives it; an unknown one is refused with its code."""
    if tool not in TOOLS:
        return spark.createDataFrame([("UNKNOWN_TOOL",)], "code string")
    return spark.sql(f"SELECT * FROM {prefix}{tool}({', '.join(f'{k} => :{k}' for k in arguments)})", args=arguments)
