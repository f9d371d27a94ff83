"""Registered queries of the corpus library: search, catalog, pages, index, documents, consistency, quality and the rest."""

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import audit, consistency, documents, duplicates, grams, inverted, layout, pages, patches, quality, search, semistructured
from quire.operators.numbering import numbered
from quire.plans import corpus
from quire.plans import sqltext as s
from quire.plans.corpus import table
from quire.sources import tables

R = corpus.Registry()

_VIEW = ", v AS (SELECT book_id, physical_page, " + ", ".join(f"{s.fold(f)} AS {f}" for f in search.FIELDS) + " FROM p)"
_ANY = lambda t: "(" + " OR ".join(f"contains({f}, '{t}')" for f in search.FIELDS) + ")"


def _search_sql(terms, match="any", where="TRUE", tail="", columns=""):
    hit = (" AND " if match == "all" else " OR ").join(_ANY(t) for t in terms)
    found = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_ANY(t)} THEN '{t}' END" for t in terms) + "], lambda e: e IS NOT NULL), ',') AS matched_terms"
    pairs = ", ".join(f"CASE WHEN contains({f}, '{t}') THEN '{f}' END" for t in terms for f in search.FIELDS)
    fields = f"[{pairs}]"
    # order of first match: kept by filtering each place on its first position
    where_in = f"array_to_string(list_filter({fields}, lambda e, i: e IS NOT NULL AND list_position({fields}, e) = i), ',') AS matched_in"
    return _VIEW + f" SELECT book_id, physical_page, {found}, {where_in}{columns} FROM v WHERE ({hit}) AND {where} {tail}"


def _found(spark, sf, query, match="any", **filters):
    return search.search(corpus.folded(spark, sf), corpus.books(corpus.pages(spark, sf)), query, match, **filters)


def _found_by_grams(spark, sf, query, match="any", **filters):
    view = corpus.folded(spark, sf)
    held = tables.derived(spark, "grams", [f"{sf}/documents.parquet"], lambda: grams.index(view, search.FIELDS))
    return grams.find(view, held, corpus.books(corpus.pages(spark, sf)), query, match, **filters)


def _joined(hits):
    return hits.withColumns({c: F.array_join(c, ",") for c in ("matched_terms", "matched_in")})


@R.add(_search_sql(["that", "with"]))
def search_any(spark, sf):
    return _joined(_found(spark, sf, "that with"))


@R.add(_search_sql(["that", "with"], "all"))
def search_all(spark, sf):
    return _joined(_found(spark, sf, "That WITH", "all"))


@R.add(_search_sql(["of the"]))
def search_phrase(spark, sf):
    return _joined(_found(spark, sf, "of the", "phrase"))


@R.add(_search_sql(["that"], where="book_id = 'src3'"))
def search_book_filter(spark, sf):
    return _joined(_found(spark, sf, "that", book_id="src3"))


@R.add(_search_sql(["that"], where="book_id IN (SELECT book_id FROM b WHERE track = 'de' AND contains(lower(subject || ' ' || title), 'subject'))"))
def search_track_filter(spark, sf):
    return _joined(_found(spark, sf, "that", track="de", subject="Subject"))


@R.add(
    _VIEW + f", h AS (SELECT book_id, physical_page FROM v WHERE {_ANY('that')} AND {_ANY('with')}) "
    "SELECT book_id, physical_page, (SELECT count(*) FROM h) AS total, CASE WHEN 16 < (SELECT count(*) FROM h) THEN 16 END AS next_offset FROM h ORDER BY book_id, physical_page LIMIT 8 OFFSET 8"
)
def search_page_offset(spark, sf):
    return search.paged(_found(spark, sf, "that with", "all"), 8, 8).select("book_id", "physical_page", "total", "next_offset")


@R.add(_search_sql(["the", "ung"]))
def search_grams_any(spark, sf):
    return _joined(_found_by_grams(spark, sf, "the ung"))


@R.add(_search_sql(["answer", "unit", "für"], "all"))
def search_grams_all(spark, sf):
    return _joined(_found_by_grams(spark, sf, "answer unit FÜR", "all"))


@R.add(_search_sql(["and the"], where="book_id = 'src3'"))
def search_grams_phrase(spark, sf):
    return _joined(_found_by_grams(spark, sf, "and the", "phrase", book_id="src3"))


@R.add("SELECT d.doc_id, q.item_id FROM documents d JOIN benchmark q ON contains(d.text, q.text)", base=False)
def search_batch_benchmark(spark, sf):
    return search.batch(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "item_id", "text")


# ---- catalog ----


@R.add("SELECT * FROM b WHERE contains(lower(subject || ' ' || title), 'subject 1')")
def list_books(spark, sf):
    return corpus.books(corpus.pages(spark, sf)).where(search.allowed(subject="Subject 1"))


@R.add("SELECT DISTINCT subject FROM b")
def list_subjects(spark, sf):
    return pages.subjects(corpus.books(corpus.pages(spark, sf)))


@R.add("SELECT count(*) AS books, CAST(sum(page_count) AS BIGINT) AS pages, CAST(sum(searchable_page_count) AS BIGINT) AS searchable_pages, count(DISTINCT subject) AS subjects FROM b")
def catalog_totals(spark, sf):
    return pages.totals(corpus.books(corpus.pages(spark, sf)))


_STATUS = "CASE WHEN length(text) < 1 THEN 'no-text' WHEN contains(text, chr(65533)) THEN 'damaged-text' WHEN lang = 'de' THEN 'ocr-text' ELSE 'clean-extracted-text' END"


def _status():
    return F.when(F.length("text") < 1, tx.NO_TEXT).when(F.col("text").contains("�"), tx.DAMAGED).when(F.col("lang") == "de", tx.OCR).otherwise(tx.CLEAN)


@R.add(
    f", st AS (SELECT searchable, {_STATUS} AS s FROM x) SELECT count(*) AS pages, count(*) FILTER (WHERE searchable) AS searchable, count(*) FILTER (WHERE s = 'no-text') AS no_text, "
    "count(*) FILTER (WHERE s = 'damaged-text') AS damaged_text, count(*) FILTER (WHERE s = 'ocr-text') AS ocr_text, count(*) FILTER (WHERE s = 'clean-extracted-text') AS clean_extracted_text FROM st"
)
def health_counts(spark, sf):
    return pages.health(corpus.index(corpus.pages(spark, sf)), _status(), (tx.NO_TEXT, tx.DAMAGED, tx.OCR, tx.CLEAN))


@R.add(f"SELECT book_id, CASE WHEN {corpus.TURN} % 5 = 0 THEN 'unknown' WHEN {corpus.TURN} % 3 = 0 OR {corpus.TURN} % 4 = 1 THEN 'stale' ELSE 'fresh' END AS state FROM b")
def manifest_freshness(spark, sf):
    n = F.expr(corpus.TURN)
    b = corpus.books(corpus.pages(spark, sf))
    manifest = b.select("book_id", F.when(n % 5 != 0, F.concat("book_id", F.lit(".json"))).alias("file_name"), n.alias("bytes"), F.lit(1).alias("mtime"))
    found = b.where(n % 3 != 0).select(F.concat("book_id", F.lit(".json")).alias("file_name"), F.when(n % 4 == 1, n + 1).otherwise(n).alias("bytes"), F.lit(1).alias("mtime"))
    return pages.freshness(manifest, found)


# ---- pages ----


_EVIDENCE = f"CASE WHEN length({s.strip('text')}) < 1 THEN 'no-text' WHEN {s.damaged('text')} THEN 'damaged-text' WHEN lang = 'de' THEN 'ocr-text' ELSE 'clean-extracted-text' END AS evidence_status"


def _evidence():
    return tx.evidence_status(F.col("text"), F.col("lang") == "de")


@R.add(f"SELECT book_id, physical_page, printed_page, CASE WHEN printed_page IS NULL THEN 'unverified' ELSE 'stored' END AS printed_page_source, title, page_type, {_EVIDENCE}, searchable FROM p WHERE book_id = 'src3'")
def book_page_map(spark, sf):
    return pages.page_map(corpus.pages(spark, sf).where("book_id = 'src3'"), _evidence())


@R.add(f"SELECT title, text, printed_page, {_EVIDENCE} FROM p WHERE book_id = 'src3' AND physical_page = 5")
def read_page_point(spark, sf):
    return pages.read(corpus.pages(spark, sf).withColumn("evidence_status", _evidence()), "src3", 5, "title", "text", "printed_page", "evidence_status")


_CLASH = ", g AS (SELECT book_id, physical_page, CASE WHEN doc_id % 11 = 0 THEN 7 ELSE printed_page END AS printed_page FROM p)"


def _clash(spark, sf):
    return corpus.pages(spark, sf).select("book_id", "physical_page", F.when(F.col("doc_id") % 11 == 0, 7).otherwise(F.col("printed_page")).alias("printed_page"))


@R.add(_CLASH + " SELECT book_id, printed_page, CASE WHEN count(*) = 1 THEN max(physical_page) END AS physical_page FROM g WHERE printed_page IS NOT NULL GROUP BY book_id, printed_page")
def locate_printed_unique(spark, sf):
    return pages.locate(_clash(spark, sf))


@R.add(
    _CLASH
    + """, r AS (SELECT doc_id AS request_id, book_id, CASE WHEN doc_id % 4 IN (0, 1) THEN CAST(doc_id % 70 AS INTEGER) END AS physical, CASE WHEN doc_id % 4 IN (1, 2) THEN CAST(doc_id % 66 AS INTEGER) END AS printed FROM p),
m AS (SELECT r.request_id, r.physical, r.printed, count(g.physical_page) AS n, max(g.physical_page) AS page, max(g.printed_page) AS number FROM r LEFT JOIN g ON r.book_id = g.book_id AND CASE WHEN r.physical IS NOT NULL THEN g.physical_page = r.physical ELSE g.printed_page = r.printed END GROUP BY 1, 2, 3),
st AS (SELECT request_id, page, CASE WHEN physical IS NULL AND printed IS NULL THEN 'PAGE_REQUIRED' WHEN n > 1 THEN 'AMBIGUOUS_PRINTED_PAGE' WHEN n = 0 THEN 'PAGE_NOT_FOUND' WHEN printed IS NOT NULL AND number IS DISTINCT FROM printed THEN 'PAGE_NUMBER_CONFLICT' ELSE 'OK' END AS status FROM m)
SELECT request_id, status, CASE WHEN status = 'OK' THEN page END AS resolved FROM st"""
)
def resolve_page_status(spark, sf):
    d = F.col("doc_id")
    requests = corpus.pages(spark, sf).select(d.alias("request_id"), "book_id", F.when((d % 4).isin(0, 1), (d % 70).cast("int")).alias("physical"), F.when((d % 4).isin(1, 2), (d % 66).cast("int")).alias("printed"))
    return pages.resolve(requests, _clash(spark, sf))


@R.add("SELECT book_id, physical_page, title FROM p WHERE physical_page BETWEEN 3 AND 9")
def page_range_physical(spark, sf):
    return pages.in_range(corpus.pages(spark, sf), "physical_page", 3, 9).select("book_id", "physical_page", "title")


@R.add("SELECT book_id, physical_page, printed_page FROM p WHERE printed_page BETWEEN 2 AND 6")
def page_range_printed(spark, sf):
    return pages.in_range(corpus.pages(spark, sf), "printed_page", 2, 6).select("book_id", "physical_page", "printed_page")


@R.add(
    ", n AS (SELECT DISTINCT book_id, physical_page AS v FROM x WHERE physical_page BETWEEN 2 AND 60 UNION ALL SELECT DISTINCT book_id, 1 FROM x UNION ALL SELECT DISTINCT book_id, 61 FROM x), "
    "l AS (SELECT book_id, v, lag(v) OVER (PARTITION BY book_id ORDER BY v) AS u FROM n) SELECT book_id, u + 1 AS first_missing, v - 1 AS last_missing FROM l WHERE v - u > 1"
)
def page_range_missing(spark, sf):
    return pages.missing_ranges(corpus.index(corpus.pages(spark, sf)), "physical_page", 2, 60)


@R.add("SELECT book_id, physical_page FROM x WHERE abs(physical_page - 5) <= 1")
def page_neighbors(spark, sf):
    return pages.neighbours(corpus.index(corpus.pages(spark, sf)), 5).select("book_id", "physical_page")


@R.add("SELECT p.book_id, p.physical_page, CASE WHEN physical_page > 1 THEN physical_page - 1 END AS previous, CASE WHEN physical_page < page_count THEN physical_page + 1 END AS next FROM p JOIN b USING (book_id)")
def page_prev_next(spark, sf):
    p = corpus.pages(spark, sf)
    return pages.previous_and_next(p, corpus.books(p))


@R.add("SELECT book_id, title, (SELECT count(*) FROM b) AS total, CAST(least(9, (SELECT count(*) FROM b)) - 4 AS BIGINT) AS returned, CASE WHEN 9 < (SELECT count(*) FROM b) THEN CAST(9 AS BIGINT) END AS next_offset FROM b ORDER BY book_id LIMIT 5 OFFSET 4")
def batch_next_offset(spark, sf):
    return pages.batch(corpus.books(corpus.pages(spark, sf)).select("book_id", "title"), ["book_id"], 4, 5)


# ---- text ----


def _text(name, spark_expr, sql_expr, where="TRUE"):
    def run(spark, sf):
        return table(spark, sf, "documents").where(where).select("doc_id", spark_expr().alias("value"))

    run.__name__ = name
    R.add(f"SELECT doc_id, {sql_expr} AS value FROM documents WHERE {where}" if sql_expr else None, base=False)(run)


_T = lambda: F.col("text")
_text("txt_normalize_digits", lambda: tx.normalise_digits(F.translate(_T(), "aeiou", "٣۴٥۶٧")), "translate(translate(text, 'aeiou', '٣۴٥۶٧'), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')")
_text("txt_clean", lambda: tx.clean(F.regexp_replace(_T(), "e", " \t")), s.clean(r"regexp_replace(text, 'e', ' ' || chr(9), 'g')"))
_text("txt_fold_latin", lambda: tx.fold(_T()), s.fold("text"))
_text("txt_tokens", lambda: F.array_join(tx.tokens(_T()), " "), f"array_to_string({s.tokens('text')}, ' ')")
_text("txt_unique_tokens", lambda: F.size(tx.unique_tokens(_T())), f"CAST(len(list_distinct({s.tokens('text')})) AS INTEGER)")
_text("txt_preview", lambda: tx.preview(_T()), "CASE WHEN length(text) <= 1100 THEN text ELSE substr(text, 1, 700) || ' …[' || CAST(length(text) - 1100 AS VARCHAR) || ' characters omitted]… ' || right(text, 400) END")
_text("txt_compact", lambda: tx.compact(_T(), 280), s.compact("text", 280))
_CUT = f"substr({s.clean('text')}, 1, 140)"
_text("txt_clip_word", lambda: tx.clip_at_word(_T()), f"CASE WHEN length({s.clean('text')}) <= 140 THEN {s.clean('text')} ELSE {s.strip(f'''CASE WHEN length(regexp_extract({_CUT}, '(?s)^(.*) [^ ]*$', 1)) > 84 THEN regexp_extract({_CUT}, '(?s)^(.*) [^ ]*$', 1) ELSE {_CUT} END''')} END")
_text("txt_page_reference", lambda: tx.page_reference(F.concat(F.lit("see page "), F.col("doc_id").cast("string"), F.lit(" of it"))), "CAST(regexp_extract('see page ' || CAST(doc_id AS VARCHAR) || ' of it', 'page ([0-9]{1,4})', 1) AS INTEGER)")
_text("txt_letters_ratio", lambda: tx.round_half_up(F.regexp_count(_T(), F.lit("\\p{L}")) / F.greatest(F.length(_T()), F.lit(1)), 4), s.round_half_up("len(regexp_extract_all(text, '\\p{L}')) / greatest(length(text), 1)", 4))
_text(
    "txt_redact",
    lambda: tx.redact(_T()),
    "substr("
    + s.replaced(
        "text", (r"(?i)bearer[ \t]+[A-Za-z0-9._-]+", "Bearer [hidden]"), (r"(?i)(api[_-]?key|token|secret|password)([\"'' ]*[:=][\"'' ]*)[^ \"'',;\n]+", r"\1\2[hidden]"), (r"(sk|pk|key)-[A-Za-z0-9_-]{12,}", "[hidden]"),
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[mail]"), ("[0-9a-fA-F]{32,}", "[hex]"),
    ) + ", 1, 4000)",
)
_text("txt_strip_slab", lambda: tx.strip_slab(F.concat(F.lit("Book_1.indb 12\n3/4/2024  10:22 AM "), _T(), F.lit(" _________ x"))),
      s.strip(s.replaced(s.clean("'Book_1.indb 12' || chr(10) || '3/4/2024  10:22 AM ' || text || ' _________ x'"), (r"(?i)[A-Za-z0-9_]+\.indb[ \t]+[0-9]{1,4}", " "), (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}[ \t]+[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?([ \t]*[AP]M)?", " "), ("_{6,}", "_"), (r"[ \t]{2,}", " "), ("\n{3,}", "chr(10) || chr(10)"))))
_text("txt_digit_claims", lambda: F.array_join(tx.digit_runs(_T()), " "), f"array_to_string({s.digit_runs('text')}, ' ')")
_text("txt_rule_folds", lambda: tx.rule_fold(_T()), s.rule_fold("text"))
_text("txt_fold_variants", lambda: tx.word_fold(_T()), s.word_fold("text"))
_text("txt_compact_key", lambda: tx.compact_key(_T()), s.replaced("text", (f"{s.SPACE}+", ""), (r"[\x{064B}-\x{065F}\x{0670}]", "")))
_text("txt_sample_long", lambda: tx.sample_long(_T()), "CASE WHEN length(text) <= 6000 THEN text ELSE substr(text, 1, 2000) || chr(10) || '…' || chr(10) || substr(text, CAST(floor(length(text) / 2 - 1000) AS BIGINT), 2000) || chr(10) || '…' || chr(10) || right(text, 2000) END")
_text("txt_parse_int", lambda: tx.parse_int(F.regexp_extract(_T(), "[0-9]+", 0)), "CASE WHEN regexp_matches(regexp_extract(text, '[0-9]+', 0), '^[0-9]{1,9}$') AND TRY_CAST(regexp_extract(text, '[0-9]+', 0) AS INTEGER) > 0 THEN TRY_CAST(regexp_extract(text, '[0-9]+', 0) AS INTEGER) END")
_FOUL = lambda d: F.when(d % 5 == 0, F.concat(F.lit('{"text": "'), _T())).when(d % 7 == 0, F.concat(_T(), F.lit("漢字"))).when(d % 11 == 0, F.concat(_T(), F.repeat(F.lit("▓ђ"), F.ceil(F.length(_T()) / 30).cast("int")))).otherwise(_T())
_FOUL_SQL = "CASE WHEN doc_id % 5 = 0 THEN '{\"text\": \"' || text WHEN doc_id % 7 = 0 THEN text || '漢字' WHEN doc_id % 11 = 0 THEN text || repeat('▓ђ', CAST(ceil(length(text) / 30) AS INTEGER)) ELSE text END"
_OUT_SQL = r"[^\t\n\r\x20-\x7E\x{00A0}-\x{024F}\x{0600}-\x{06FF}\x{2000}-\x{22FF}]"
_VISIBLE = f"regexp_replace(t, '{s.SPACE}+', '', 'g')"
_text(
    "txt_contamination", lambda: F.coalesce(tx.contamination(_FOUL(F.col("doc_id"))), F.lit("fine")),
    "(SELECT CASE WHEN regexp_matches(t, '^[ \\t\\n]*[\\[{][ \\t\\n]*\"') OR regexp_matches(t, '\"(text|summary|title)\"[ \\t\\n]*:|^[ \\t\\n]*(json\\b|```)') THEN 'SERIALIZED_JSON' WHEN contains(t, '漢') THEN 'CJK' "
    f"WHEN len(regexp_extract_all({_VISIBLE}, '{_OUT_SQL}')) / greatest(length({_VISIBLE}), 1) > 0.03 THEN 'OUT_OF_RANGE' ELSE 'fine' END FROM (SELECT {_FOUL_SQL} AS t))",
)
_text("txt_hours_older", lambda: tx.round_half_up((F.col("n_chars") * 1000000) / 3.6e9, 4), s.round_half_up("(n_chars * 1000000) / 3.6e9", 4))
_text("txt_sentence_count", lambda: F.size(F.filter(F.split(tx.clean(_T()), "[.!؟?]"), lambda x: tx.flat(x) != "")), f"CAST(len(list_filter(regexp_split_to_array({s.clean('text')}, '[.!؟?]'), lambda e: {s.flat('e')} <> '')) AS INTEGER)")
# not in SQL: lookaround, or built from other rules than one expression
_text("txt_spread_summary", lambda: tx.spread_summary(_T()), None)
_text("txt_damage", lambda: tx.is_damaged(_T()), s.damaged("text"))
_text("txt_broken_years", lambda: F.size(tx.broken_years(_T())), None)
_text("txt_evidence_status", lambda: tx.evidence_status(_T(), F.col("lang") == "de"), f"CASE WHEN length({s.strip('text')}) < 1 THEN 'no-text' WHEN {s.damaged('text')} THEN 'damaged-text' WHEN lang = 'de' THEN 'ocr-text' ELSE 'clean-extracted-text' END")
_text("txt_folio_values", lambda: F.concat(tx.folio_values(_T()), tx.folio_values(_T(), True)), None)
_text("txt_folio_strip", lambda: tx.strip_folio(F.concat(F.lit("17 1 7 17 "), _T()), F.lit(17)), "CASE WHEN regexp_matches(text, '^(17|1[ \\t]+7)([ \\t\\n]|$)') THEN NULL ELSE regexp_replace(text, '^[ \\t]*\\n*', '') END")
_text("txt_negative_sentences", lambda: semistructured.without_negative_sentences(_T(), "(?i)that"), None)


@R.add()
def txt_normalize_ar(spark, sf):
    from quire.functions import arabic

    return table(spark, sf, "documents").select("doc_id", arabic.normalise(F.col("text")).alias("value"))


@R.add()
def txt_search_forms(spark, sf):
    from quire.functions import arabic

    held = table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")  # a file may be one row group, and one task
    return held.select("doc_id", F.size(arabic.search_tokens(F.col("text"))).alias("value"))


# ---- index ----

_TOK = f", t AS (SELECT doc_id, book_id, unnest(list_distinct({s.tokens('text')})) AS term FROM p)"


def _terms():
    return tx.tokens(F.col("text"))


@R.add(_TOK + " SELECT term, count(*) AS df FROM t GROUP BY term")
def idx_document_frequency(spark, sf):
    return inverted.document_frequency(corpus.pages(spark, sf), _terms())


@R.add(_TOK + " SELECT term, doc_id FROM t")
def idx_postings(spark, sf):
    return inverted.postings(corpus.pages(spark, sf), _terms())


@R.add(_TOK + " SELECT term, count(*) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM t GROUP BY term")
def idx_directory(spark, sf):
    return inverted.first_postings(corpus.pages(spark, sf), _terms())


@R.add(_TOK + ", f AS (SELECT term, count(*) AS df FROM t GROUP BY term) SELECT term, df, CAST(sum(df) OVER (ORDER BY term ROWS UNBOUNDED PRECEDING) - df AS BIGINT) AS start FROM f")
def idx_csr_offsets(spark, sf):
    return inverted.offsets(inverted.document_frequency(corpus.pages(spark, sf), _terms()))


@R.add(
    f", w AS (SELECT doc_id, unnest({s.tokens('text')}) AS keyword, generate_subscripts({s.tokens('text')}, 1) AS pos FROM p), c AS (SELECT doc_id, keyword, count(*) AS n, min(pos) AS pos FROM w GROUP BY 1, 2), "
    "r AS (SELECT doc_id, keyword, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(keyword) DESC, pos) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 10 AND NOT regexp_matches(keyword, '^[0-9]+$')"
)
def idx_top_keywords(spark, sf):
    return inverted.keywords_by_count(corpus.pages(spark, sf), _terms())


@R.add(_CLASH + " SELECT book_id, printed_page, max(physical_page) AS physical_page FROM g WHERE printed_page IS NOT NULL GROUP BY 1, 2")
def idx_printed_map(spark, sf):
    return inverted.printed_map(_clash(spark, sf))


@R.add(", r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM p) SELECT doc_id, CAST(pos // 250 AS INTEGER) AS shard, CAST(pos % 250 AS INTEGER) AS shard_offset FROM r")
def idx_shard_pointer(spark, sf):
    rows = numbered(corpus.pages(spark, sf).select("doc_id", "lang"), "lang", "doc_id", name="at")
    return inverted.shard_pointers(rows, F.col("at") - 1).select("doc_id", "shard", "shard_offset")


@R.add(
    f", e AS (SELECT *, {_EVIDENCE}, len({s.digit_runs('text')}) AS figures, len(regexp_extract_all(text, '[{{}}]')) AS glossary FROM x) SELECT count(*) AS pages, count(DISTINCT book_id) AS books, count(*) FILTER (WHERE searchable OR summary <> '') AS indexed, count(*) FILTER (WHERE searchable) AS searchable, "
    "count(*) FILTER (WHERE NOT searchable) AS needs_ocr, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) FILTER (WHERE length(text) > 0) AS with_text, count(printed_page) AS with_printed_page, count(*) FILTER (WHERE title <> '') AS with_title, count(DISTINCT unit) AS units, "
    "CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest, count(*) FILTER (WHERE figures > 0 OR glossary > 0) AS structured, CAST(sum(figures) AS BIGINT) AS figures, CAST(sum(glossary) AS BIGINT) AS glossary, "
    + ", ".join(f"count(*) FILTER (WHERE evidence_status = '{k}') AS {k.replace('-', '_')}" for k in (tx.NO_TEXT, tx.DAMAGED, tx.OCR, tx.CLEAN)) + " FROM e"
)
def idx_build_stats(spark, sf):
    arrays = {"figures": tx.digit_runs(F.col("text")), "glossary": F.regexp_extract_all("text", F.lit("[{}]"), 0)}
    return documents.statistics(corpus.index(corpus.pages(spark, sf)).withColumn("evidence_status", _evidence()), arrays, (tx.NO_TEXT, tx.DAMAGED, tx.OCR, tx.CLEAN))


@R.add(_TOK + " SELECT term, count(*) AS df FROM t GROUP BY term UNION ALL SELECT 'ال' || term, count(*) FROM t WHERE length(term) > 3 GROUP BY term")
def idx_expanded_frequency(spark, sf):
    from quire.functions import arabic

    return inverted.document_frequency(corpus.pages(spark, sf), arabic.search_tokens(F.col("text")))


@R.add(_TOK + ", f AS (SELECT term, count(*) AS df FROM t GROUP BY term), k AS (SELECT term, CASE WHEN df > 1 THEN df + 1000 ELSE df END AS df FROM f) SELECT term, df, CAST(sum(df) OVER (ORDER BY term ROWS UNBOUNDED PRECEDING) - df AS BIGINT) AS start FROM k")
def idx_csr_global(spark, sf):
    own = inverted.document_frequency(corpus.pages(spark, sf), _terms())
    return inverted.offsets(inverted.with_global(own, own.where("df > 1").select("term", (F.col("df") + 1000).alias("df"))))


# ---- document build ----


@R.add(
    f", l AS (SELECT book_id, lower({s.flat('split_part(text, chr(10), 1)')}) AS line FROM p), n AS (SELECT book_id, count(*) AS n FROM l GROUP BY 1) "
    "SELECT l.book_id, line, count(*) AS pages FROM l JOIN n ON l.book_id = n.book_id WHERE line <> '' GROUP BY l.book_id, line, n.n HAVING count(*) >= greatest(2, ceil(n.n * 0.02))"
)
def doc_running_headers(spark, sf):
    return documents.running_headers(corpus.pages(spark, sf), 2, 0.02)


@R.add("SELECT purpose AS value, count(*) AS n FROM p WHERE purpose <> '' GROUP BY 1 HAVING count(*) >= 5")
def doc_template_purposes(spark, sf):
    return documents.templates(corpus.pages(spark, sf), "purpose", 5)


@R.add("SELECT book_id, summary AS value, count(*) AS n FROM p WHERE summary <> '' GROUP BY 1, 2 HAVING count(*) >= 2")
def doc_template_summaries(spark, sf):
    return documents.templates(corpus.pages(spark, sf), "summary", 2, by_book=True)


@R.add(_CLASH + " SELECT book_id, CASE WHEN min(printed_page - physical_page) = max(printed_page - physical_page) THEN min(printed_page - physical_page) END AS page_offset_hint FROM g WHERE printed_page IS NOT NULL GROUP BY 1")
def doc_offset_hint(spark, sf):
    return documents.offset_hints(_clash(spark, sf))


@R.add(
    "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN printed_page END, CASE WHEN doc_id % 3 = 0 THEN physical_page END) AS printed, "
    "CASE WHEN doc_id % 2 = 0 AND printed_page IS NOT NULL THEN 'parser' WHEN doc_id % 3 = 0 THEN 'footer' ELSE 'unknown' END AS source FROM p"
)
def doc_printed_source(spark, sf):
    d = F.col("doc_id")
    page, source = documents.printed_source(F.when(d % 2 == 0, F.col("printed_page")), F.when(d % 3 == 0, F.col("physical_page")), F.lit(None).cast("int"))
    return corpus.pages(spark, sf).select("doc_id", page.alias("printed"), source.alias("source"))


_POINTS = " + ".join(
    ["w", "least(len(regexp_extract_all(t, '\\p{L}')), 60) / 30.0::DOUBLE"]
    + [f"CASE WHEN {holds} THEN {documents.TITLE_POINTS[name]} ELSE 0 END" for name, holds in (("folio", "regexp_matches(t, '^[0-9]{1,4}( |$)|[ ][0-9]{1,4}$')"), ("one_word", "len(words) = 1"), ("three_words", "len(words) >= 3"), ("short", "length(t) < 8"), ("long", "length(t) > 140"), ("patch", f"regexp_matches(t, '{documents.NO_TITLE}')"))]
    + ["CASE WHEN len(long) > 0 AND body <> '' THEN len(list_filter(long, lambda e: contains(body, e))) / len(long) * 4 ELSE 0 END"]
)


@R.add(
    f", h AS (SELECT lower({s.flat('split_part(text, chr(10), 1)')}) AS line, count(*) AS n FROM p GROUP BY 1), q AS (SELECT doc_id, title, summary, purpose, {s.word_fold('text')} AS body, lower({s.flat('split_part(text, chr(10), 1)')}) AS line FROM p), "
    "c AS (SELECT doc_id, body, unnest([0, 1, 2]) AS i, unnest([2.0::DOUBLE, 1.0, 0.0]) AS w, unnest([title, summary, purpose]) AS raw, h.n >= 2 AS common, line FROM q LEFT JOIN h USING (line)), "
    f"k AS (SELECT *, {s.flat('raw')} AS t FROM c), f AS (SELECT *, list_filter(string_split(t, ' '), lambda e: regexp_matches(e, '\\p{{L}}')) AS words, list_distinct(list_filter(string_split({s.word_fold('t')}, ' '), lambda e: length(e) >= 4)) AS long FROM k), "
    f"g AS (SELECT doc_id, raw, i, common AND lower(t) = line AS furniture, round({_POINTS}, 9) AS points FROM f WHERE len(words) > 0), r AS (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY furniture, points DESC, i) AS n FROM g WHERE points > 0) "
    f"SELECT p.doc_id, {s.clip_at_word('raw')} AS title FROM p JOIN r ON p.doc_id = r.doc_id AND n = 1 UNION ALL SELECT doc_id, NULL FROM p WHERE doc_id NOT IN (SELECT doc_id FROM r)"
)
def doc_title_argmax(spark, sf):
    p = corpus.pages(spark, sf).withColumn("line", F.lower(tx.flat(F.split_part("text", F.lit("\n"), F.lit(1)))))
    common = p.groupBy("line").agg(F.count("*").alias("n")).where("n >= 2").select("line", F.array("line").alias("furniture"))
    best = documents.best_title([(F.col("title"), 2), (F.col("summary"), 1), (F.col("purpose"), 0)], F.col("text"), F.col("furniture"))
    return p.join(common, "line", "left").select("doc_id", best.alias("title"))


@R.add(
    ", k AS (SELECT purpose AS value FROM p GROUP BY 1 HAVING count(*) >= 5) SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'enriched' WHEN purpose <> '' AND purpose NOT IN (SELECT value FROM k) THEN 'page' WHEN length(summary) >= 20 THEN 'derived' ELSE 'fallback' END AS kind FROM p"
)
def doc_purpose(spark, sf):
    p = corpus.pages(spark, sf)
    known = documents.templates(p, "purpose", 5).select(F.col("value").alias("_v"), F.lit(True).alias("_k"))
    rows = p.join(known, F.col("purpose") == F.col("_v"), "left")
    _, kind = documents.purpose(F.when(F.col("doc_id") % 10 == 0, "from enrichment"), F.col("purpose"), F.coalesce("_k", F.lit(False)), F.col("summary"))
    return rows.select("doc_id", kind.alias("kind"))


@R.add("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'better title' ELSE title END AS title, CASE WHEN doc_id % 6 = 0 AND doc_id % 4 <> 0 THEN 'better section' ELSE section END AS section FROM p")
def doc_enrichment_override(spark, sf):
    p = corpus.pages(spark, sf)
    extra = p.where("doc_id % 6 = 0").select("doc_id", F.lit("better title").alias("title"), F.when(F.col("doc_id") % 4 == 0, "  ").otherwise("better section").alias("section"))
    return documents.override(p, extra, ["doc_id"], ["title", "section"]).select("doc_id", "title", "section")


@R.add("SELECT doc_id, array_to_string(list_filter([title, unit, section, purpose], lambda e: " + s.strip("e") + " <> ''), chr(10)) AS value FROM p")
def proj_searchable_text(spark, sf):
    return corpus.pages(spark, sf).select("doc_id", documents.searchable_text(["title", "unit", "section", "purpose"]).alias("value"))


@R.add("SELECT doc_id, length(" + s.strip("text") + ") >= 20 AS searchable, length(" + s.strip("text") + ") < 20 AS needs_ocr FROM x")
def flag_searchable_needs_ocr(spark, sf):
    n = F.length(tx.strip(F.col("text")))
    return corpus.index(corpus.pages(spark, sf)).select("doc_id", (n >= 20).alias("searchable"), (n < 20).alias("needs_ocr"))


@R.add(
    f"SELECT book_id || ':' || CAST(physical_page AS VARCHAR) AS id, book_id, physical_page, printed_page, coalesce(title, '') AS title, coalesce(section, '') AS section, coalesce(unit, '') AS unit, coalesce(page_type, '') AS page_type, searchable, needs_ocr, {_EVIDENCE}, coalesce(text_length, 0) AS text_length, "
    f"printed_page - physical_page AS page_offset, {s.damaged('text')} AS text_damaged, doc_id % 6 = 0 AS enriched, {s.letters_only('text')} AS normalized FROM x"
)
def proj_scan_meta(spark, sf):
    docs = corpus.index(corpus.pages(spark, sf)).withColumn("evidence_status", _evidence()).withColumn("enriched", F.col("doc_id") % 6 == 0)
    return documents.scan_meta(docs)


@R.add("SELECT DISTINCT p.book_id || ':' || CAST(p.physical_page AS VARCHAR) AS id, b.title AS book_title, p.printed_page FROM p JOIN b USING (book_id) WHERE contains(p.text, 'that')")
def proj_citation(spark, sf):
    p = corpus.pages(spark, sf)
    names = corpus.books(p).select("book_id", F.col("title").alias("book_title"))
    return p.where(F.col("text").contains("that")).join(names, "book_id").select(F.concat_ws(":", "book_id", F.col("physical_page").cast("string")).alias("id"), "book_title", "printed_page").distinct()


@R.add(f"SELECT book_id FROM b WHERE track = 'de' AND {corpus.TURN} % 2 = 0")
def filter_tracked(spark, sf):
    b = corpus.books(corpus.pages(spark, sf)).withColumn("supplementary", F.when(F.expr(f"{corpus.TURN} % 2 = 1"), True))
    return b.where(search.tracked("DE")).select("book_id")


# ---- consistency ----


@R.add("SELECT book_id, physical_page FROM p EXCEPT SELECT book_id, physical_page FROM x")
def qc_missing_pages(spark, sf):
    p = corpus.pages(spark, sf)
    return consistency.missing(p, corpus.index(p))


@R.add("SELECT book_id, physical_page FROM x WHERE doc_id % 4 = 0")
def qc_extra_pages(spark, sf):
    p = corpus.pages(spark, sf)
    return consistency.missing(corpus.index(p), p.where("doc_id % 4 <> 0"))


@R.add("SELECT p.book_id, p.physical_page, p.text_length AS source_length, CAST(length(x.text) AS INTEGER) AS index_length FROM p JOIN x USING (book_id, physical_page) WHERE p.text_length >= 20 AND length(x.text) < 20")
def qc_lost_text(spark, sf):
    p = corpus.pages(spark, sf)
    return consistency.lost_text(p, corpus.index(p))


@R.add(
    f", m AS (SELECT p.book_id, p.physical_page, p.text AS a, x.text AS c, {s.flat('x.text')} AS k FROM p JOIN x USING (book_id, physical_page) WHERE length(x.text) < length(p.text) * 0.98), "
    f"g AS (SELECT book_id, physical_page, CAST(length(a) AS INTEGER) AS expected, CAST(length(c) AS INTEGER) AS indexed, CAST(len(list_filter(string_split(a, chr(10)), lambda e: length({s.flat('e')}) >= 25 AND NOT contains(k, {s.flat('e')}))) AS INTEGER) AS lost_lines FROM m) SELECT * FROM g WHERE lost_lines > 0"
)
def qc_truncated_text(spark, sf):
    p = corpus.pages(spark, sf)
    return consistency.truncated(p, corpus.index(p))


@R.add("SELECT book_id, physical_page, 'changed' AS change FROM p JOIN x USING (book_id, physical_page) WHERE p.text <> x.text OR p.searchable <> x.searchable UNION ALL SELECT book_id, physical_page, 'removed' FROM p WHERE doc_id % 37 = 0")
def qc_layer_diff(spark, sf):
    p = corpus.pages(spark, sf)
    return consistency.differing(p, corpus.index(p), ["text", "searchable"])


@R.add("SELECT book_id, physical_page FROM p JOIN x USING (book_id, physical_page) WHERE p.searchable <> x.searchable")
def qc_status_mismatch(spark, sf):
    p = corpus.pages(spark, sf)
    return consistency.differing(p, corpus.index(p), ["searchable"]).where("change = 'changed'").select("book_id", "physical_page")


@R.add("SELECT book_id, physical_page FROM x WHERE physical_page > 40 AND doc_id % 3 = 0")
def qc_orphan_docs(spark, sf):
    p = corpus.pages(spark, sf)
    return consistency.missing(corpus.index(p), p.where("not (physical_page > 40 and doc_id % 3 = 0)"))


@R.add(
    f", k AS (SELECT book_id, CASE WHEN {corpus.TURN} % 5 = 1 THEN '' WHEN {corpus.TURN} % 5 = 2 THEN 'none' ELSE sha256(book_id) END AS checksum FROM b), f AS (SELECT book_id, CASE WHEN checksum = '' THEN 'NO_CHECKSUM' WHEN checksum = 'none' THEN 'CHECKSUM_MISMATCH' WHEN {corpus.TURN} % 5 = 3 THEN 'SIZE_DIFFERS' END AS code FROM k) "
    "SELECT book_id, code, CASE WHEN code = 'CHECKSUM_MISMATCH' THEN 'critical' ELSE 'high' END AS severity FROM f WHERE code IS NOT NULL"
)
def qc_checksum(spark, sf):
    n = F.expr(corpus.TURN)
    b = corpus.books(corpus.pages(spark, sf)).select("book_id", n.alias("bytes"), F.when(n % 5 == 1, "").when(n % 5 == 2, "none").otherwise(F.sha2("book_id", 256)).alias("checksum"))
    digests = b.select(F.sha2("book_id", 256).alias("digest"), F.when(n % 5 == 3, n + 1).otherwise(n).alias("bytes"))
    return consistency.checksum_findings(b, digests)


@R.add(f"SELECT book_id, b.title, CASE WHEN {corpus.TURN} % 2 = 0 THEN 'file-' || book_id END AS file FROM b")
def join_catalog_source(spark, sf):
    b = corpus.books(corpus.pages(spark, sf))
    sources = b.where(f"{corpus.TURN} % 2 = 0").select("book_id", F.concat(F.lit("file-"), "book_id").alias("file"))
    return b.select("book_id", "title").join(sources, "book_id", "left")


@R.add(f"SELECT book_id FROM b WHERE {corpus.TURN} % 3 = 0")
def join_layer_missing(spark, sf):
    b = corpus.books(corpus.pages(spark, sf))
    return consistency.missing(b, b.where(f"{corpus.TURN} % 3 <> 0"), ["book_id"])


@R.add(f"SELECT book_id, physical_page FROM x WHERE doc_id % 29 = 0 AND doc_id % 2 = 0 AND length({s.strip('text')}) >= 20")
def qc_outline_contradiction(spark, sf):
    p = corpus.pages(spark, sf)
    outline = p.where("doc_id % 29 = 0").select("book_id", "physical_page", F.when(F.col("doc_id") % 2 == 0, F.concat("title", F.lit(": لا يوجد نص هنا"))).otherwise(F.col("title")).alias("description"))
    return consistency.contradicted(outline, corpus.index(p))


# ---- quality ----

_OUT = r"[^\t\n\r\x20-\x7E\x{00A0}-\x{024F}\x{0600}-\x{06FF}\x{2000}-\x{22FF}]"
_COUNT = lambda pattern: f"CAST(sum(len(regexp_extract_all(text, '{pattern}'))) AS BIGINT)"


@R.add(
    f"SELECT book_id, {_COUNT(chr(0xFFFD))} AS replacement, {_COUNT(r'[\x{E000}-\x{F8FF}]')} AS private, {_COUNT('[پچژگکی]')} AS persian, {_COUNT(quality.BROKEN_NAMES)} AS broken_names, {_COUNT(_OUT)} AS out_of_range, CAST(sum(length(text)) AS BIGINT) AS characters, "
    f"{s.round_half_up(f'{_COUNT(_OUT)} / greatest(sum(length(text)), 1)', 4)} AS share FROM p GROUP BY book_id"
)
def qc_corruption_counts(spark, sf):
    return quality.corruption(corpus.pages(spark, sf))


_PIECES = lambda name, sign, fold, size, few: (
    f"SELECT book_id, doc_id, size, '{name}' AS kind, unnest(ps) AS piece FROM (SELECT book_id, doc_id, length(text) AS size, list_filter(list_transform(regexp_split_to_array(text, '{sign}'), lambda e: {fold('e')}), lambda e: length(e) >= {size}) AS ps FROM p WHERE length(text) >= 20) WHERE len(ps) >= {few}"
)


@R.add(
    f", c AS ({_PIECES('line', chr(10), s.flat, 12, 4)} UNION ALL {_PIECES('clause', '[.!؟?' + chr(10) + '،؛;]', s.rule_fold, 30, 2)}), d AS (SELECT book_id, doc_id, size, kind, piece, count(*) AS n FROM c GROUP BY ALL), "
    "e AS (SELECT book_id, doc_id, size, kind, sum((n - 1) * length(piece)) AS extra FROM d GROUP BY ALL), f AS (SELECT book_id, doc_id, max(extra / size) AS share FROM e GROUP BY ALL) "
    f"SELECT book_id, {s.round_half_up('avg(share)', 4)} AS mean_share, {s.round_half_up('max(share)', 4)} AS peak_share, count(*) FILTER (WHERE share > 0.1) AS pages_over FROM f WHERE share > 0 GROUP BY book_id"
)
def qc_inner_duplication(spark, sf):
    return quality.inner_duplication(corpus.pages(spark, sf))


@R.add(
    ", f AS (SELECT book_id, 'title' AS field, CASE WHEN doc_id % 13 = 0 THEN '{\"text\": 1}' ELSE title END AS v FROM p UNION ALL SELECT book_id, 'summary', CASE WHEN doc_id % 17 = 0 THEN '漢字' ELSE summary END FROM p), "
    "k AS (SELECT book_id, field, CASE WHEN regexp_matches(v, '^[ \\t\\n]*[\\[{][ \\t\\n]*\"') THEN 'json' WHEN regexp_matches(v, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]') THEN 'cjk' END AS leak FROM f) SELECT book_id, field, leak, count(*) AS n FROM k WHERE leak IS NOT NULL GROUP BY ALL"
)
def qc_leaks(spark, sf):
    d = F.col("doc_id")
    p = corpus.pages(spark, sf).withColumn("title", F.when(d % 13 == 0, '{"text": 1}').otherwise(F.col("title"))).withColumn("summary", F.when(d % 17 == 0, "漢字").otherwise(F.col("summary")))
    return quality.leaks(p, ["title", "summary"])


def _numbers(spark, sf):
    page = F.array(F.col("physical_page").cast("string"), F.coalesce(F.col("printed_page").cast("string"), F.lit("")))
    p = corpus.pages(spark, sf).withColumn("summary", F.concat("summary", F.lit(" 1234 99 "), F.when(F.col("doc_id") % 7 == 0, "").otherwise("unit 77 "), F.col("physical_page").cast("string")))
    return quality.number_verdicts(p, ["title", "summary"], page, F.array(F.lit("99")))


@R.add(
    f", q AS (SELECT book_id, physical_page, text, [CAST(physical_page AS VARCHAR), coalesce(CAST(printed_page AS VARCHAR), '')] AS own, {s.digit_runs('text')} AS proof, title, summary || ' 1234 99 ' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'unit 77 ' END || CAST(physical_page AS VARCHAR) AS summary FROM p), "
    f"f AS (SELECT book_id, physical_page, text, own, proof, 'title' AS field, title AS value FROM q UNION ALL SELECT book_id, physical_page, text, own, proof, 'summary', summary FROM q), n AS (SELECT *, unnest(list_distinct({s.digit_runs('value')})) AS number FROM f) "
    f"SELECT book_id, physical_page, field, number, CASE WHEN length(number) < 2 OR list_contains(own, number) OR list_contains(proof, number) THEN 'proven' WHEN number = '99' THEN 'verified' WHEN regexp_matches(value, '(?i)(unit|lesson|chapter|part|page|الوحدة|الفصل|الدرس)[ ]*[0-9]') THEN 'structural' WHEN {s.strip('text')} = '' THEN 'layerless' ELSE 'unverified' END AS verdict FROM n"
)
def qc_number_verdicts(spark, sf):
    return _numbers(spark, sf)


@R.add("SELECT book_id, page_type AS value, count(*) AS n FROM p WHERE page_type NOT IN ('divider', 'lesson_content', 'parallel_text', 'boxed_recap', 'matching', 'exercises', 'glossary', 'contents') GROUP BY ALL")
def qc_type_histogram(spark, sf):
    return quality.outside_enumeration(corpus.pages(spark, sf), "page_type", corpus.PAGE_TYPES)


@R.add(
    f", w AS (SELECT book_id, physical_page, 'title' AS field, unnest(list_distinct(string_split({s.word_fold('title')}, ' '))) AS token FROM p UNION ALL SELECT book_id, physical_page, 'summary', unnest(list_distinct(string_split({s.word_fold('summary')}, ' '))) FROM p), "
    "o AS (SELECT unnest(['that', 'with', 'from']) AS token, unnest(['src1', 'src2', 'src3']) AS owner) SELECT book_id, physical_page, field, min(owner) AS other FROM w JOIN o USING (token) WHERE owner <> book_id GROUP BY ALL"
)
def qc_misattribution(spark, sf):
    names = spark.createDataFrame([("that", "src1"), ("with", "src2"), ("from", "src3")], "token string, book_id string")
    return quality.misattribution(corpus.pages(spark, sf), names, ["title", "summary"])


@R.add(
    ", r AS (SELECT book_id, length(summary) / length(text) AS v FROM p WHERE length(text) > 0), o AS (SELECT book_id, v, row_number() OVER (PARTITION BY book_id ORDER BY v) AS pos, count(*) OVER (PARTITION BY book_id) AS n, count(*) FILTER (WHERE v < 0.015) OVER (PARTITION BY book_id) AS thin FROM r) "
    f"SELECT book_id, {s.round_half_up('v', 4)} AS median_coverage, thin FROM o WHERE pos = n // 2 + 1"
)
def qc_summary_coverage(spark, sf):
    return quality.summary_coverage(corpus.pages(spark, sf))


@R.add(
    f"SELECT book_id, count(*) AS pages, count(*) FILTER (WHERE {s.strip('purpose')} = '') AS purpose_empty, count(*) FILTER (WHERE length(purpose) < 60) AS purpose_short, count(DISTINCT purpose) AS purpose_distinct, count(*) FILTER (WHERE {s.strip('unit')} = '') AS unit_empty, count(DISTINCT unit) AS unit_distinct, count(DISTINCT section) AS section_distinct FROM p GROUP BY book_id"
)
def qc_purpose_unit_section(spark, sf):
    return quality.field_quality(corpus.pages(spark, sf))


@R.add(
    f", k AS (SELECT book_id, {s.strip('text')} = '' AS e, {s.strip('title || summary')} <> '' AS d FROM x) SELECT book_id, count(*) AS pages, count(*) FILTER (WHERE e) AS empty, count(*) FILTER (WHERE e AND d) AS described, {s.round_half_up('count(*) FILTER (WHERE e) / count(*)')} AS share FROM k GROUP BY book_id"
)
def qc_no_text(spark, sf):
    return quality.no_text(corpus.index(corpus.pages(spark, sf)))


@R.add(f", c AS (SELECT book_id, title, count(*) AS n FROM p WHERE title <> '' GROUP BY ALL) SELECT book_id, CAST(sum(n) AS BIGINT) AS filled, max(n) AS most, {s.round_half_up('max(n) / sum(n)', 4)} AS share FROM c GROUP BY book_id")
def qc_duplicate_share(spark, sf):
    return quality.duplicate_share(corpus.pages(spark, sf), "title")


@R.add(
    f", f AS (SELECT p.book_id, page_type, {s.rule_fold('''CASE WHEN doc_id % 9 = 0 THEN 'The Book ' || p.book_id || ' again' ELSE p.title END''')} AS t, {s.rule_fold('b.title')} AS name FROM p JOIN b ON p.book_id = b.book_id), "
    "c AS (SELECT book_id, t, count(*) AS n, count(*) FILTER (WHERE length(t) >= 12 AND (contains(t, name) OR contains(name, t)) AND page_type NOT IN ('divider', 'contents')) AS k FROM f WHERE t <> '' GROUP BY ALL) "
    f"SELECT book_id, CAST(sum(n) AS BIGINT) AS titled, CAST(sum(k) AS BIGINT) AS as_book_title, max(n) AS most, {s.round_half_up('max(n) / sum(n)', 4)} AS share FROM c GROUP BY book_id"
)
def qc_title_repetition(spark, sf):
    p = corpus.pages(spark, sf)
    renamed = p.withColumn("title", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("The Book "), "book_id", F.lit(" again"))).otherwise(F.col("title")))
    return quality.title_repetition(renamed, corpus.books(p))


@R.add(
    f", o AS (SELECT unit, min(book_id) AS low, max(book_id) AS high FROM p GROUP BY unit HAVING min(book_id) <> max(book_id)), k AS (SELECT p.book_id, physical_page, p.unit, low, high, list_distinct(list_filter(string_split({s.rule_fold('p.unit')}, ' '), lambda e: length(e) >= 3)) AS ws, string_split({s.rule_fold('text')}, ' ') AS body FROM p JOIN o ON p.unit = o.unit) "
    "SELECT book_id, physical_page, unit, CASE WHEN low <> book_id THEN low ELSE high END AS also_in FROM k WHERE len(list_filter(ws, lambda e: list_contains(body, e))) / greatest(len(ws), 1) < 0.8"
)
def qc_foreign_units(spark, sf):
    return quality.foreign_units(corpus.pages(spark, sf))


# ---- duplicates and drift ----

_SIG = f", g AS (SELECT book_id, physical_page, regexp_replace({s.rule_fold('text')}, '[0-9٠-٩۰-۹]+', '#', 'g') AS f FROM p), o AS (SELECT book_id, f, min(physical_page) AS page FROM g WHERE length(f) >= 200 GROUP BY ALL)"


@R.add(_SIG + ' SELECT a.book_id AS "left", c.book_id AS "right", count(*) AS shared FROM o a JOIN o c ON a.f = c.f AND a.book_id < c.book_id GROUP BY ALL')
def dup_cross_book_pairs(spark, sf):
    return duplicates.cross_book_pairs(corpus.pages(spark, sf), 1)


@R.add(
    _SIG + ', d AS (SELECT a.book_id AS "left", c.book_id AS "right", c.page - a.page AS d FROM o a JOIN o c ON a.f = c.f AND a.book_id < c.book_id), r AS (SELECT *, row_number() OVER (PARTITION BY "left", "right" ORDER BY d) AS pos, count(*) OVER (PARTITION BY "left", "right") AS n FROM d) SELECT "left", "right", d AS "offset" FROM r WHERE pos = n // 2 + 1'
)
def dup_pair_offset(spark, sf):
    return duplicates.pair_offsets(corpus.pages(spark, sf))


@R.add("SELECT book_id, doc_id, n FROM (SELECT book_id, doc_id, count(*) OVER (PARTITION BY book_id, summary) AS n FROM p WHERE summary <> '') WHERE n > 1")
def dup_in_book_summary(spark, sf):
    return duplicates.repeated(corpus.pages(spark, sf), "summary")


_KEY = s.replaced("line", (f"{s.SPACE}+", ""), (r"[\x{064B}-\x{065F}\x{0670}]", ""))


@R.add(
    f", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM p), k AS (SELECT doc_id, pos, line, CASE WHEN length({_KEY}) >= 6 THEN {_KEY} ELSE chr(10) || CAST(pos AS VARCHAR) END AS k FROM l), "
    "r AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, line, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS n FROM k) SELECT doc_id, pos AS line_no, line FROM r WHERE n = 1"
)
def dup_first_occurrence(spark, sf):
    return duplicates.first_occurrences(corpus.pages(spark, sf)).withColumnRenamed("at", "line_no")


@R.add(
    f", d AS (SELECT book_id, physical_page, {s.word_fold('title')} AS t, {s.word_fold('text')} AS w FROM p), m AS (SELECT d.book_id, d.physical_page, (list_filter(string_split(c.t, ' '), lambda e, i: length(e) >= 4 AND list_position(string_split(c.t, ' '), e) = i))[1:6] AS head, d.w, concat_ws(' ', a.w, z.w) AS near FROM d "
    "JOIN d c ON d.book_id = c.book_id AND c.physical_page = d.physical_page + CASE WHEN d.physical_page % 10 = 0 THEN 1 ELSE 0 END LEFT JOIN d a ON a.book_id = d.book_id AND a.physical_page = d.physical_page - 1 LEFT JOIN d z ON z.book_id = d.book_id AND z.physical_page = d.physical_page + 1) "
    "SELECT book_id, physical_page FROM m WHERE len(head) >= 3 AND w <> '' AND near <> '' AND len(list_filter(head, lambda e: contains(w, e))) / len(head) < 0.34 AND len(list_filter(head, lambda e: contains(near, e))) / len(head) >= 0.67"
)
def drift_neighbour_titles(spark, sf):
    p = corpus.pages(spark, sf)
    own = p.where("physical_page % 10 <> 0").select("book_id", "physical_page", "title")
    moved = p.select("book_id", (F.col("physical_page") - 1).alias("physical_page"), "title").where("physical_page % 10 = 0")
    titled = p.drop("title").join(own.unionByName(moved), ["book_id", "physical_page"])
    return duplicates.drifted(titled)


@R.add(
    ", n AS (SELECT DISTINCT source AS book_id, doc_id FROM documents WHERE doc_id % 7 <> 0), r AS (SELECT lang, d.doc_id AS n FROM documents d WHERE d.doc_id % 7 <> 0), k AS (SELECT lang, n, n - row_number() OVER (PARTITION BY lang ORDER BY n) AS island FROM r) "
    "SELECT lang, min(n) AS first, max(n) AS last, count(*) AS size FROM k GROUP BY lang, island HAVING count(*) >= 4"
)
def agg_contiguous_runs(spark, sf):
    return duplicates.contiguous_runs(table(spark, sf, "documents").where("doc_id % 7 <> 0"), "lang", "doc_id")


# ---- patches ----


def _patches(spark, sf):
    d = F.col("doc_id")
    p = corpus.pages(spark, sf)
    one = p.where(d % 5 == 0).select("book_id", "physical_page", F.lit("title").alias("field"), F.concat(F.lit("Patched title "), d.cast("string")).alias("value"), F.lit("a.json").alias("source"), F.lit(0).alias("priority"), d.alias("position"))
    two = p.where(d % 10 == 0).select("book_id", "physical_page", F.lit("title").alias("field"), F.when(d % 20 == 0, "Patched").when(d % 30 == 0, "12 folio").otherwise("Reviewed title").alias("value"), F.lit("b.json").alias("source"), F.lit(1).alias("priority"), d.alias("position"))
    three = p.where(d % 15 == 0).select("book_id", "physical_page", F.lit("summary").alias("field"), F.when(d % 45 == 0, "漢字").otherwise("A summary that is long enough to be accepted as one").alias("value"), F.lit("b.json").alias("source"), F.lit(1).alias("priority"), d.alias("position"))
    return one.unionByName(two).unionByName(three)


_PATCH = """, patch AS (
  SELECT book_id, physical_page, 'title' AS field, 'Patched title ' || CAST(doc_id AS VARCHAR) AS value, 'a.json' AS source, 0 AS priority, doc_id AS position FROM p WHERE doc_id % 5 = 0
  UNION ALL SELECT book_id, physical_page, 'title', CASE WHEN doc_id % 20 = 0 THEN 'Patched' WHEN doc_id % 30 = 0 THEN '12 folio' ELSE 'Reviewed title' END, 'b.json', 1, doc_id FROM p WHERE doc_id % 10 = 0
  UNION ALL SELECT book_id, physical_page, 'summary', CASE WHEN doc_id % 45 = 0 THEN '漢字' ELSE 'A summary that is long enough to be accepted as one' END, 'b.json', 1, doc_id FROM p WHERE doc_id % 15 = 0),
coded AS (SELECT *, CASE WHEN value = '漢字' THEN 'CJK' WHEN value = '12 folio' THEN 'TITLE_FOLIO' END AS code FROM patch),
good AS (SELECT * FROM coded WHERE code IS NULL),
last AS (SELECT book_id, physical_page, field, value, source FROM good QUALIFY row_number() OVER (PARTITION BY book_id, physical_page, field ORDER BY priority DESC, source DESC, position DESC) = 1)
"""


@R.add(_PATCH + "SELECT * FROM last")
def patch_last_wins(spark, sf):
    return patches.last_wins(patches.validated(_patches(spark, sf))[0])


@R.add(_PATCH + "SELECT source, book_id, physical_page, field, code, value FROM coded WHERE code IS NOT NULL")
def patch_reject_codes(spark, sf):
    return patches.validated(_patches(spark, sf))[1]


@R.add(
    _PATCH + "SELECT p.book_id, p.physical_page, CASE WHEN doc_id % 5 <> 0 THEN title WHEN doc_id % 20 = 0 THEN 'Patched title ' || CAST(doc_id AS VARCHAR) WHEN doc_id % 30 = 0 OR doc_id % 10 <> 0 THEN 'Patched title ' || CAST(doc_id AS VARCHAR) ELSE 'Reviewed title' END AS title, CASE WHEN doc_id % 15 = 0 AND doc_id % 45 <> 0 THEN 'A summary that is long enough to be accepted as one' ELSE summary END AS summary FROM p"
)
def patch_apply(spark, sf):
    accepted, _ = patches.validated(_patches(spark, sf))
    return patches.apply(corpus.pages(spark, sf).select("book_id", "physical_page", "title", "summary"), accepted, ["title", "summary"])


@R.add(_PATCH + "SELECT l.book_id, l.physical_page, l.field, CASE WHEN starts_with(CASE WHEN l.field = 'title' THEN p.title ELSE p.summary END, l.value) THEN 'applied' ELSE 'pending' END AS state FROM last l JOIN p USING (book_id, physical_page)")
def patch_pending(spark, sf):
    winners = patches.last_wins(patches.validated(_patches(spark, sf))[0])
    return patches.outcome(corpus.pages(spark, sf), winners, ["title", "summary"])


@R.add(
    _PATCH + "SELECT book_id, field, value, arg_min(physical_page, (priority, source, position)) AS holder FROM good GROUP BY book_id, field, value HAVING count(*) > 1"
)
def win_first_holder(spark, sf):
    return patches.first_holder(patches.validated(_patches(spark, sf))[0])


@R.add("SELECT o.book_id, q.subject AS phrase FROM (SELECT DISTINCT subject FROM b) q, (SELECT book_id FROM b) o WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.book_id = o.book_id AND b.subject = q.subject)")
def patch_foreign_phrases(spark, sf):
    return patches.foreign_phrases(corpus.books(corpus.pages(spark, sf)).select("book_id", F.col("subject").alias("phrase")))


@R.add(
    ", v AS (SELECT 'title' AS field, title AS v FROM p UNION ALL SELECT 'summary', summary FROM p UNION ALL SELECT 'purpose', purpose FROM p), c AS (SELECT field, v, count(*) AS n FROM v WHERE v <> '' GROUP BY ALL) "
    f"SELECT field, CAST(sum(n) AS BIGINT) AS filled, count(*) AS distinct_values, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicated_rows, {s.round_half_up('100 * sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)', 1)} AS ratio FROM c GROUP BY field"
)
def patch_duplication_report(spark, sf):
    return patches.duplication_report(corpus.pages(spark, sf), ["title", "summary", "purpose"])


@R.add("SELECT book_id, physical_page, 'title' AS field FROM p WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def patch_pending_exclusion(spark, sf):
    p = corpus.pages(spark, sf)
    wanted, done, tried = (p.where(f"doc_id % {n} = 0").select("book_id", "physical_page", F.lit("title").alias("field")) for n in (2, 3, 5))
    return patches.pending_exclusion(wanted, done, tried.union(tried).union(tried))


# ---- audit and probes ----

_WEAK = f"list_filter([CASE WHEN length(t) < 4 THEN 'WEAK_TITLE' WHEN regexp_matches(t, '(?i)^(untitled|no title|page|continued)\\b') THEN 'PLACEHOLDER_TITLE' END, CASE WHEN length(s) < 40 THEN 'WEAK_SUMMARY' WHEN regexp_matches(s, '(?i)^(untitled|no title|page|continued)\\b') THEN 'PLACEHOLDER_SUMMARY' END, CASE WHEN regexp_matches(t || ' ' || s, '(?i)(\\.indb|undefined|null null|\\[object)') THEN 'JUNK_META' END, CASE WHEN t = s AND t <> '' THEN 'TITLE_EQUALS_SUMMARY' END], lambda e: e IS NOT NULL)"
_CODED = ", ".join(
    f"CASE WHEN {holds} THEN '{code}' END"
    for code, holds in {
        "NO_TEXT": "n < 40 AND flag", "NO_TEXT_BUT_NOT_FLAGGED": "n < 40 AND NOT flag", "SEARCHABLE_FLAG_MISMATCH": "searchable <> (n > 0)", "NEEDSOCR_FLAG_STALE": "n >= 40 AND flag", "OCR_STATUS_MISSING": "NOT flag AND doc_id % 4 = 0",
        "DUMP_SUMMARY": "length(line) >= 40 AND fs <> '' AND starts_with(line, substr(fs, 1, 60))", "DUMP_TITLE": "length(line) >= 40 AND ft <> '' AND starts_with(line, substr(ft, 1, 60))",
        "INDEX_PAGE_MISSING": "nobridge", "INDEX_PAGE_STALE": "NOT nobridge AND doc_id % 33 = 0", "SEARCH_DOC_MISSING": "NOT found", "SEARCH_DOC_WEAK_META": "found AND (length(title) <= 2 OR length(summary) < 20)",
        "SEARCH_DOC_FLAG_MISMATCH": "found AND ds <> (n > 0)", "SEARCH_DOC_EMPTY_PREVIEW": f"found AND n >= 40 AND {s.strip('dp')} = ''", "SEARCH_DOC_NO_TERMS": "found AND n >= 40 AND doc_id % 49 = 0",
    }.items()
)
_ISSUES = f""", pg AS (SELECT * FROM p WHERE doc_id % 101 <> 0),
a AS (
  SELECT pg.book_id, pg.physical_page, pg.doc_id, pg.title, pg.summary, pg.searchable, {s.strip('pg.title')} AS t, {s.strip('pg.summary')} AS s, length({s.strip('pg.text')}) AS n, {s.flat('pg.text')} AS line, {s.flat('pg.title')} AS ft, {s.flat('pg.summary')} AS fs,
    pg.needs_ocr OR pg.doc_id % 97 = 0 AS flag, pg.doc_id % 31 = 0 OR pg.book_id = 'src7' AS nobridge, x.doc_id IS NOT NULL AS found, x.searchable AS ds, CASE WHEN pg.doc_id % 45 = 0 THEN '' ELSE substr(x.text, 1, 50) END AS dp
  FROM pg LEFT JOIN x ON pg.doc_id = x.doc_id),
o AS (SELECT book_id, count(*) - CASE WHEN count(*) % 3 = 0 THEN 1 ELSE 0 END AS entries, count(*) AS pages FROM pg GROUP BY book_id),
issue AS (
  SELECT book_id, physical_page, unnest(list_filter([{_CODED}], lambda e: e IS NOT NULL) || {_WEAK}) AS code FROM a
  UNION ALL SELECT DISTINCT book_id, 0, 'INDEX_BOOK_MISSING' FROM a WHERE book_id NOT IN (SELECT book_id FROM a WHERE NOT nobridge)
  UNION ALL SELECT book_id, 0, 'OUTLINE_COUNT_MISMATCH' FROM o WHERE book_id = 'src9' OR entries <> pages
  UNION ALL SELECT book_id, physical_page, 'OUTLINE_FILE_MISSING' FROM a WHERE book_id = 'src9'
  UNION ALL SELECT book_id, physical_page, 'SEARCH_DOC_ORPHAN' FROM x WHERE doc_id % 101 = 0
  UNION ALL SELECT book_id, physical_page, 'DUP_SUMMARY_SAME_BOOK' FROM (SELECT book_id, physical_page, count(*) OVER (PARTITION BY book_id, fs) AS k FROM a WHERE fs <> '') WHERE k > 1
  UNION ALL SELECT book_id, physical_page, 'DUP_TITLE_SAME_BOOK' FROM (SELECT book_id, physical_page, count(*) OVER (PARTITION BY book_id, ft) AS k FROM a WHERE ft <> '') WHERE k > 3)
"""


def _audited(spark, sf):
    d = F.col("doc_id")
    whole = corpus.pages(spark, sf)
    p = whole.where(d % 101 != 0).withColumn("needs_ocr", F.col("needs_ocr") | (d % 97 == 0)).withColumn("ocr_status", F.when(d % 4 == 0, "").otherwise("done"))
    bridge = p.where((d % 31 != 0) & (F.col("book_id") != "src7")).withColumn("title", F.when(d % 33 == 0, F.concat("title", F.lit(" old"))).otherwise(F.col("title")))
    index = corpus.index(whole).withColumn("preview", F.when(d % 45 == 0, "").otherwise(F.substring("text", 1, 50))).withColumn("n_terms", F.when(d % 49 == 0, 0).otherwise(5))
    n = F.count("*")
    outlines = p.where("book_id <> 'src9'").groupBy("book_id").agg((n - F.when(n % 3 == 0, 1).otherwise(0)).alias("entries"))
    return p, audit.issues(p, index, bridge, outlines)


@R.add(_ISSUES + "SELECT * FROM issue")
def audit_issue_codes(spark, sf):
    return _audited(spark, sf)[1]


@R.add(_ISSUES + "SELECT code, book_id, count(*) AS n FROM issue GROUP BY ROLLUP (code, book_id)")
def audit_by_code_book(spark, sf):
    return audit.rollup(_audited(spark, sf)[1])


@R.add(
    _ISSUES + f"SELECT (SELECT count(DISTINCT book_id) FROM pg) AS books, (SELECT count(*) FROM pg) AS pages, (SELECT count(*) FROM a WHERE n >= 40) AS searchable, (SELECT count(*) FROM a WHERE flag) AS vision, "
    + ", ".join(f"count(*) FILTER (WHERE code IN ({', '.join(map(repr, codes))},'')) AS {name}" for name, codes in audit.COUNTERS.items()) + " FROM issue"
)
def audit_statistics(spark, sf):
    return audit.audit_statistics(*_audited(spark, sf))


@R.add(
    ", l AS (SELECT book_id, physical_page, row_number() OVER (PARTITION BY book_id ORDER BY physical_page) - 1 AS pos, count(*) OVER (PARTITION BY book_id) AS n FROM p WHERE length(text) >= 260) "
    "SELECT book_id, physical_page, CASE WHEN pos = floor(n * 0.72::DOUBLE) THEN 'late' WHEN pos = floor(n * 0.5::DOUBLE) THEN 'middle' WHEN pos = n - 1 THEN 'last' ELSE 'deep' END AS position, n AS page_total FROM l WHERE n >= 12 AND (pos = floor(n * 0.72::DOUBLE) OR pos = floor(n * 0.5::DOUBLE) OR pos = n - 1 OR pos = floor(n * 0.88::DOUBLE))"
)
def probe_positions(spark, sf):
    return audit.probe_positions(corpus.pages(spark, sf))


@R.add(
    f", q AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!؟?؛;])[ \\t]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda e: {s.flat('e')}), lambda e: length(e) BETWEEN 60 AND 320 AND NOT regexp_matches(e, '\ufffd|[\\x{{E000}}-\\x{{F8FF}}]')) AS ss FROM p WHERE length(text) >= 260), "
    f"k AS (SELECT doc_id, unnest(ss) AS e, generate_subscripts(ss, 1) AS i FROM q), w AS (SELECT *, list_distinct(list_filter(string_split({s.word_fold('e')}, ' '), lambda v: length(v) >= 5)) AS ws FROM k), "
    f"r AS (SELECT doc_id, e, row_number() OVER (PARTITION BY doc_id ORDER BY len(ws) + least(3, length(e) // 110) DESC, i) AS n FROM w WHERE len(ws) >= 2 AND len(list_filter(ws, lambda v: regexp_matches(v, '{audit.SUSPECT}'))) = 0) "
    "SELECT p.doc_id, r.e AS sentence FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND n = 1"
)
def probe_fact_sentence(spark, sf):
    return corpus.pages(spark, sf).select("doc_id", audit.fact_sentence(F.col("text")).alias("sentence"))


def _probes(spark, sf):
    p = corpus.pages(spark, sf)
    cases = p.where("doc_id % 10 = 0").select(F.concat_ws("#", "book_id", F.col("physical_page").cast("string")).alias("case_id"), "book_id", "physical_page", "printed_page", "doc_id")
    citations = cases.select("case_id", "book_id", F.when(F.col("doc_id") % 20 == 0, F.col("physical_page")).otherwise(-1).alias("physical_page"), F.when(F.col("doc_id") % 30 == 0, F.col("printed_page")).alias("printed_page"))
    return audit.probe_hits(cases, citations)


_PROBES = ", hit AS (SELECT book_id || '#' || CAST(physical_page AS VARCHAR) AS case_id, doc_id % 20 = 0 OR (doc_id % 30 = 0 AND printed_page IS NOT NULL) AS reached FROM p WHERE doc_id % 10 = 0)"


@R.add(_PROBES + " SELECT * FROM hit")
def probe_hit(spark, sf):
    return _probes(spark, sf)


@R.add(_PROBES + " SELECT count(*) AS cases, count(*) FILTER (WHERE reached) AS reached, count(*) FILTER (WHERE length(case_id) % 2 = 0) AS all_terms FROM hit")
def probe_summary(spark, sf):
    return audit.probe_summary(_probes(spark, sf).withColumn("term_hit_ratio", F.when(F.length("case_id") % 2 == 0, 1.0).otherwise(0.5)))


# ---- semi-structured ----


@R.add("SELECT conv_id, turn, role, substr(text, 1, 4000) AS text FROM conversations WHERE role IN ('user', 'assistant') AND turn % 5 <> 4 AND " + s.strip("text") + " <> ''", base=False)
def live_context(spark, sf):
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"))))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 2 == 0, parts).alias("model_content"), "text", (F.col("turn") % 5 == 4).alias("incomplete"))
    return semistructured.history(rows)


@R.add("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type", base=False)
def event_props_json(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count("*").alias("n"))


@R.add("SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id", base=False)
def ord_latest_conversations(spark, sf):
    return semistructured.latest(table(spark, sf, "conversations"))


@R.add("SELECT conv_id, turn, " + "coalesce(nullif(substr(" + s.replaced("role || ' ' || CAST(turn AS VARCHAR)", ("[^A-Za-z0-9_-]", "")) + ", 1, 64), ''), 'default') AS session FROM conversations", base=False)
def proj_messages(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", semistructured.safe_id(F.concat_ws(" ", "role", F.col("turn").cast("string"))).alias("session"))


@R.add(f"SELECT DISTINCT book_id, unnest({s.tokens('title')}) AS term FROM p")
def set_distinct_tokens(spark, sf):
    return inverted.distinct_terms(corpus.pages(spark, sf), tx.tokens(F.col("title")), "book_id")


@R.add(f", t AS (SELECT book_id, unnest(list_distinct({s.tokens('title', 8)})) AS term FROM p) SELECT term, min(book_id) AS book_id FROM t GROUP BY term HAVING count(DISTINCT book_id) = 1")
def set_unique_tokens(spark, sf):
    rows = corpus.pages(spark, sf).select("book_id", F.explode(tx.unique_tokens(F.col("title"), least=8)).alias("term")).groupBy("term")
    ends = rows.agg(F.min("book_id").alias("book_id"), F.max("book_id").alias("high"))
    return ends.where("book_id = high").select("term", "book_id")


@R.add(f"SELECT doc_id, array_to_string(list_filter({s.digit_runs('summary')}, lambda e: NOT list_contains({s.digit_runs('substr(text, 60)')}, e) AND e <> '7'), ' ') AS value FROM p")
def set_unproven_numbers(spark, sf):
    proof = tx.digit_runs(F.substring("text", F.lit(60), F.lit(1 << 30)))
    return corpus.pages(spark, sf).select("doc_id", F.array_join(tx.unproven(tx.digit_runs(F.col("summary")), proof, F.array(F.lit("7"))), " ").alias("value"))


@R.add("SELECT page_type, count(*) AS n FROM p GROUP BY page_type")
def agg_type_distribution(spark, sf):
    return corpus.pages(spark, sf).groupBy("page_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "page_type")


@R.add("SELECT CASE WHEN text_length = 0 THEN 'empty' WHEN text_length < 200 THEN 'thin' ELSE 'intact' END AS integrity, count(*) AS n FROM p GROUP BY 1")
def agg_integrity(spark, sf):
    n = F.col("text_length")
    return corpus.pages(spark, sf).groupBy(F.when(n == 0, "empty").when(n < 200, "thin").otherwise("intact").alias("integrity")).agg(F.count("*").alias("n"))


@R.add(f", w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS word FROM p) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 25")
def agg_word_frequency(spark, sf):
    words = corpus.pages(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


@R.add(f"SELECT book_id, {s.round_half_up(f'{_COUNT(_OUT)} / sum(length(text))', 4)} AS ratio FROM p GROUP BY book_id HAVING sum(length(text)) > 0")
def agg_out_of_range_ratio(spark, sf):
    return quality.corruption(corpus.pages(spark, sf)).where("characters > 0").select("book_id", F.col("share").alias("ratio"))


@R.add("SELECT field, count(*) AS carried FROM (SELECT unnest(['title', 'section', 'unit']) AS field, unnest([title, section, unit]) AS v FROM p) WHERE v <> '' GROUP BY field")
def agg_field_transfer(spark, sf):
    rows = corpus.pages(spark, sf).select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("title", "section", "unit")))).alias("f")).select("f.*")
    return rows.where("v <> ''").groupBy("field").agg(F.count("*").alias("carried"))


@R.add(f"SELECT doc_id, CASE WHEN length(f) >= 200 THEN sha1(f) END AS value FROM (SELECT doc_id, regexp_replace({s.rule_fold('text')}, '[0-9٠-٩۰-۹]+', '#', 'g') AS f FROM documents)", base=False)
def js_sha1_signature(spark, sf):
    return table(spark, sf, "documents").select("doc_id", duplicates.signature(F.col("text")).alias("value"))


@R.add("SELECT doc_id, '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS value FROM documents", base=False)
def js_canonical_map(spark, sf):
    return table(spark, sf, "documents").select("doc_id", semistructured.canonical(F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))).alias("value"))


@R.add("SELECT DISTINCT source AS layer FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'fr' AND doc_id % 7 = 0)", base=False)
def js_dead_layers(spark, sf):
    docs = table(spark, sf, "documents")
    return consistency.dead_layers(docs.select(F.col("source").alias("layer")), docs.where("lang = 'fr' and doc_id % 7 = 0").select(F.col("source").alias("layer"), F.col("doc_id").alias("reader")))


@R.add("SELECT doc_id, coalesce(list_contains([CAST(physical_page AS VARCHAR), coalesce(CAST(printed_page AS VARCHAR), '')], CAST(doc_id % 60 AS VARCHAR)), FALSE) AS declared FROM p")
def js_array_evidence(spark, sf):
    numbers = F.array(F.translate(F.col("physical_page").cast("string"), "0123456789", tx.ARABIC_DIGITS), F.col("printed_page").cast("string"))
    return corpus.pages(spark, sf).select("doc_id", tx.declared(F.col("doc_id") % 60, numbers).alias("declared"))


_PHRASED = f", w AS (SELECT book_id, list_filter(string_split({s.word_fold('v')}, ' '), lambda e: e <> '') AS w FROM (SELECT book_id, unnest([subject || ' — of all', subject, title || ' of ' || track]) AS v FROM b)), phrase AS (SELECT DISTINCT book_id, unnest(list_filter([CASE WHEN len(w) >= 2 THEN array_to_string(w, ' ') END, CASE WHEN len(w) >= 3 THEN array_to_string(w[1:2], ' ') END], lambda e: e IS NOT NULL)) AS phrase FROM w)"


def _subject_phrases(spark, sf):
    b = corpus.books(corpus.pages(spark, sf))
    return patches.subject_phrases(b.withColumns({"title": F.concat("title", F.lit(" of "), "track"), "subject": F.concat("subject", F.lit(" — of all"))}))


@R.add(_PHRASED + " SELECT * FROM phrase")
def js_subject_phrases(spark, sf):
    return _subject_phrases(spark, sf)


@R.add(
    _PHRASED + f", v AS (SELECT book_id, physical_page, {s.word_fold("'see Subject ' || CAST(doc_id % 7 AS VARCHAR) || ' of all that'")} AS v, {s.word_fold('text')} AS own FROM p), h AS (SELECT v.book_id, v.physical_page, q.phrase, row_number() OVER (PARTITION BY v.book_id, v.physical_page ORDER BY length(q.phrase) DESC, q.phrase) AS r "
    "FROM v JOIN (SELECT DISTINCT phrase FROM phrase WHERE length(phrase) >= 6) q ON contains(' ' || v.v || ' ', ' ' || q.phrase || ' ') WHERE NOT EXISTS (SELECT 1 FROM phrase o WHERE o.book_id = v.book_id AND o.phrase = q.phrase) AND NOT (length(own) >= 300 AND contains(own, q.phrase))) SELECT book_id, physical_page, 'summary' AS field, phrase FROM h WHERE r = 1"
)
def patch_foreign_values(spark, sf):
    p = corpus.pages(spark, sf)
    values = p.select("book_id", "physical_page", F.lit("summary").alias("field"), F.concat(F.lit("see Subject "), (F.col("doc_id") % 7).cast("string"), F.lit(" of all that")).alias("value"))
    return patches.foreign_values(values, _subject_phrases(spark, sf), p)


@R.add("SELECT book_id, array_to_string((list_sort(list(physical_page)))[1:5], ',') AS sample FROM p WHERE doc_id % 37 = 0 GROUP BY book_id")
def ord_first_n_samples(spark, sf):
    p = corpus.pages(spark, sf)
    gone = numbered(consistency.missing(p, corpus.index(p)), "book_id", "physical_page", name="at").where("at <= 5")
    return gone.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("physical_page")), lambda x: x.cast("string")), ",").alias("sample"))


@R.add("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang", base=False)
def ord_histogram(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@R.add("SELECT conv_id || '#' || turn AS stream, 0 AS at, role AS event, text AS data FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL UNION ALL SELECT conv_id || '#' || turn, 1, 'message', '[DONE]' FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL".replace(" AS at", ' AS "at"'), base=False)
def sse_events(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("event: "), "role", F.lit("\ndata: "), F.replace("text", F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\ndata: [DONE]")).alias("raw"))
    return semistructured.sse_events(rows.withColumn("stream", F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), "stream", "raw")


@R.add("SELECT doc_id, text AS value FROM documents", base=False)
def json_salvage(spark, sf):
    wrapped = F.to_json(F.struct(F.lit(1).alias("page"), "text"))
    return table(spark, sf, "documents").select("doc_id", semistructured.unwrapped(wrapped).alias("value"))


def _items(spark, sf):
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "[ \n]+")).alias("at", "str"))
    wave = F.floor(F.col("at") % 8 / 3) * 0.4  # baselines of one row differ a little
    return words.select("page", "at", "str", ((F.col("at") % 8) * 60.0).alias("x"), (800.0 - F.floor(F.col("at") / 8) * 12 - wave).alias("y"), (F.length("str") * 5.0).alias("w"), F.lit(10.0).alias("h"))


_ITEMS = (
    "WITH i AS (SELECT doc_id AS page, unnest(w) AS str, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS w FROM documents)), "
    "r AS (SELECT page, -(pos // 8) - 1 AS row, str, (pos % 8) * 60.0::DOUBLE AS x, length(str) * 5.0::DOUBLE AS w FROM i), "
)


@R.add(_ITEMS + "k AS (SELECT * FROM r WHERE trim(str) <> '') SELECT page, CAST(row AS BIGINT) AS row, count(*) AS items FROM k GROUP BY ALL", base=False)
def layout_rows(spark, sf):
    return layout.baselines(_items(spark, sf)).where(F.trim("str") != "").groupBy("page", "row").agg(F.count("*").alias("items"))


@R.add(
    _ITEMS + "k AS (SELECT page, row, x, w, lag(x + w) OVER (PARTITION BY page, row ORDER BY x) AS before FROM r WHERE trim(str) <> ''), c AS (SELECT page, row, count(*) FILTER (WHERE (CASE WHEN before <= x THEN x - before ELSE -60 END) > 28) + 1 AS cells FROM k GROUP BY ALL) "
    "SELECT page, CAST(least(greatest(max(cells), 1), 3) AS INTEGER) AS columns FROM c GROUP BY page", base=False,
)
def layout_columns(spark, sf):
    return layout.columns(layout.rows(layout.baselines(_items(spark, sf)).where(~F.col("str").rlike("[\u0590-\u08FF]"))))


@R.add("WITH w AS (SELECT doc_id AS page, regexp_split_to_array(text, '[ \n]+') AS w FROM documents) SELECT page, CAST(len(w) AS BIGINT) AS items FROM w", base=False)
def layout_dedup(spark, sf):
    """Every item is drawn twice, a fraction of a point apart; one of each stays."""
    once = _items(spark, sf)
    copy = once.withColumn("at", F.col("at") + 1_000_000)
    return layout.deduplicated(once.unionByName(copy)).groupBy("page").agg(F.count("*").alias("items"))


@R.add(
    _ITEMS + "k AS (SELECT page, row, x, w, str, lag(x) OVER o AS b, lag(x + w) OVER o AS e FROM r WHERE trim(str) <> '' WINDOW o AS (PARTITION BY page, row ORDER BY x)), m AS (SELECT *, CASE WHEN e <= x THEN x - e ELSE b - x - w END AS gap FROM k), "
    "l AS (SELECT page, row, string_agg(CASE WHEN b IS NULL THEN '' WHEN gap > 28 THEN ' | ' WHEN gap >= 6 THEN ' ' ELSE '' END || str, '' ORDER BY x) AS line FROM m GROUP BY page, row) SELECT page, string_agg(line, chr(10) ORDER BY row DESC) AS text FROM l GROUP BY page", base=False,
)
def layout_page_text(spark, sf):
    return layout.page_texts(_items(spark, sf))


# ---- books, maps and flags ----


@R.add(
    f", k AS (SELECT DISTINCT book_id, unnest([{s.fold('title')}, {s.fold('subject')}]) AS k FROM b), e AS (SELECT k, CASE WHEN count(*) = 1 THEN min(book_id) END AS book_id FROM k GROUP BY k), r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'book ' || book_id WHEN 1 THEN 'subject ' || right(book_id, 1) ELSE 'none' END AS q FROM p) "
    "SELECT r.doc_id AS request_id, e.book_id FROM r LEFT JOIN e ON r.q = e.k"
)
def resolve_book(spark, sf):
    p = corpus.pages(spark, sf)
    query = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("BOOK "), "book_id")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Subject "), F.right("book_id", F.lit(1)))).otherwise("none")
    return pages.resolve_book(p.select(F.col("doc_id").alias("request_id"), query.alias("query")), corpus.books(p))


@R.add(
    "SELECT x.book_id, x.physical_page, p.text, p.title, p.searchable, x.text <> p.text AS indexed_text_differs, CASE WHEN x.physical_page > 1 THEN x.physical_page - 1 END AS previous, CASE WHEN x.physical_page < page_count THEN x.physical_page + 1 END AS next FROM x JOIN p USING (book_id, physical_page) JOIN b ON b.book_id = x.book_id"
)
def full_page(spark, sf):
    p = corpus.pages(spark, sf)
    return pages.full_page(corpus.index(p).withColumn("title", F.lit("from the index")), p, corpus.books(p), ["title", "searchable"])


@R.add(
    ", l AS (SELECT book_id, physical_page, 'page ' || physical_page || CASE WHEN printed_page IS NOT NULL AND printed_page <> physical_page THEN ' (printed ' || printed_page || ')' ELSE '' END || ': ' || coalesce(nullif(title, ''), page_type) AS line FROM p WHERE physical_page <= 250), "
    "u AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY book_id ORDER BY physical_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) > 2000 AS over FROM l), m AS (SELECT book_id, min(physical_page) AS stop FROM u WHERE over GROUP BY book_id) "
    "SELECT u.book_id, physical_page, line FROM u LEFT JOIN m ON u.book_id = m.book_id WHERE stop IS NULL OR physical_page < stop"
)
def txt_outline_map(spark, sf):
    return pages.outline_map(corpus.pages(spark, sf), 2000)


@R.add(
    f"SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN 'forced' WHEN book_id = 'src4' THEN 'corrupt-book' WHEN {s.strip('text')} = '' THEN 'empty' WHEN doc_id % 5 = 0 OR regexp_matches(text, '^[ \\t\\n]*[\\[{{][ \\t\\n]*\"|\"(text|summary|title)\"[ \\t\\n]*:|^[ \\t\\n]*(json\\b|```)') THEN 'contaminated' "
    "WHEN doc_id % 7 = 0 THEN 'rejected' WHEN doc_id % 11 = 0 THEN 'other-parser' WHEN needs_ocr THEN 'flagged' END AS reason FROM p"
)
def flag_needs_ocr_chain(spark, sf):
    from quire.functions import kinds

    d = F.col("doc_id")
    text = F.when(d % 5 == 0, F.concat(F.lit('{"text": "'), "text")).otherwise(F.col("text"))
    reason = kinds.needs_ocr(text, d % 41 == 0, F.col("book_id") == "src4", F.when(d % 7 == 0, "rejected"), F.when(d % 11 == 0, "layout"), F.col("needs_ocr"))
    return corpus.pages(spark, sf).select("doc_id", reason.alias("reason"))


_THRICE = "len(list_filter(range(1, length(e) - 1), lambda i: lower(e)[i] = lower(e)[i + 1] AND lower(e)[i] = lower(e)[i + 2]))"


@R.add(f"SELECT doc_id, len(list_filter(string_split(text, ' '), lambda e: regexp_matches(e, '^\\p{{L}}{{2,}}$') AND regexp_matches(e, '(?i)[aeiouyäöüáéíóúàèìòùâêîôû]|[\\x{{0621}}-\\x{{064A}}]') AND {_THRICE} = 0)) AS words FROM documents", base=False)
def txt_word_like(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split("text", " "), tx.looks_like_word)).alias("words"))
