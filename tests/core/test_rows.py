"""Fixtures for what SQL cannot say: Arabic search, plans, chains of reasons, files and layout."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import arabic, grounding, kinds
from quire.functions import text as tx
from quire.operators import audit, consistency, layout, pages, patches, quality, search, semistructured
from quire.plans import corpus
from quire.sources import files, sinks


def value(spark, column, *args):
    return spark.range(1).select(column(*(F.lit(a) for a in args)).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("query", "match", "want"),
    [("أحمد", "any", [1, 2]), ("احمد", "any", [1, 2]), ("مُحَمَّد", "any", [3]), ("مـــدرسة", "any", [2]), ("ﷲ", "any", [4]), ("ﬁle", "any", [5]), ("قلم أحمد", "all", [1]), ("كتاب آخر", "phrase", [3]), ("IX", "any", [6]), (" \t", "any", []), ("", "phrase", [])],
)
def test_queries_are_folded_as_the_fields_are(spark, query, match, want):
    rows = [(1, "قلم أحمد", None), (2, "ذهب إحمد", "مدرسة"), (3, "محمد: كتاب اخر", ""), (4, "بسم الله", None), (5, "a file", None), (6, "chapter \u2168", None)]
    view = search.view(spark.createDataFrame([("b", *r) for r in rows], "book_id string, physical_page int, text string, title string"))
    assert sorted(r["physical_page"] for r in search.search(view, None, query, match).collect()) == want
    if not query.strip():
        with pytest.raises(ValueError, match="EMPTY_QUERY"):
            search.asked(view, None, query)


def test_nested_fields_are_searched_as_json(spark):
    rows = spark.createDataFrame([("b", 1, "x", [("Term", 3)], None)], "book_id string, physical_page int, text string, glossary array<struct<word:string,page:int>>, notes array<string>")
    assert [r["matched_in"] for r in search.search(search.view(rows), None, "term").collect()] == [["glossary"]]
    assert search.search(search.view(rows), None, '"page":3').count() == 1


def test_only_what_nfkc_may_change_is_handed_to_python(spark):
    may = lambda t: value(spark, lambda c: c.rlike(arabic._MAY_CHANGE), t)
    assert not any(map(may, ("plain ASCII", "é ß ü Ñ", "محمد ١٢")))
    assert all(map(may, ("ﷲ", "ﬁ", "Ⅸ", "e\u0301", "½", "\u00a0", "ا\u0653")))


def test_filters_on_books_reach_the_stored_pages(spark):
    plan = corpus.pages(spark, "/root/testdata/sf0.001").where("book_id = 'src3'").select("physical_page")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(book_id,src3)" in plan and "ReadSchema: struct<book_id:string,physical_page:int>" in plan and "Exchange" not in plan


def test_reasons_to_read_a_page_again(spark):
    reason = lambda text="a fine text of a page", asked=None, book=None, status=None, parser=None, flag=None: value(spark, lambda: kinds.needs_ocr(F.lit(text).cast("string"), *(F.lit(x).cast(t) for x, t in ((asked, "boolean"), (book, "boolean"), (status, "string"), (parser, "string"), (flag, "boolean")))))
    assert [reason(), reason(asked=True), reason(book=True), reason(None), reason(" \n"), reason('{"text": "x"}'), reason("漢字"), reason(status="rejected"), reason(parser="layout"), reason(parser="json"), reason(flag=True)] == [
        None, "forced", "corrupt-book", "empty", "empty", "contaminated", "contaminated", "rejected", "other-parser", None, "flagged",
    ]
    scrambled = "ب ت كلمة غريبة " * 20 + "▓" * 6
    assert value(spark, tx.corruption_reason, scrambled) == "SCRAMBLED" and reason(scrambled) == "corrupt"
    assert value(spark, tx.corruption_reason, scrambled.replace("▓", "") ) is None
    assert value(spark, tx.corruption_reason, "من كلمة في " * 40 + "▓" * 6) is None


def test_broken_math_and_names(spark):
    rows = spark.createDataFrame([("a", "x ^ 2 and √ ] 3"), ("a", "2 9 + 16 [ √"), ("a", "fine (3) text"), ("b", "بسم هللا")], "book_id string, text string")
    assert {tuple(r) for r in quality.broken_math(rows).collect()} == {("a", 3, 2, 0.6667), ("b", 0, 0, 0.0)}
    assert {r["book_id"]: r["broken_names"] for r in quality.corruption(rows).collect()} == {"a": 0, "b": 1}


def test_counts_in_words_need_proof(spark):
    f = lambda t, *n: spark.range(1).select(grounding.without_count_words(F.lit(t), F.array(*map(F.lit, n)).cast("array<string>")).alias("v")).first()["v"]
    assert f("في الكتاب خمس وحدات كبيرة") == "في الكتاب وحدات كبيرة"
    assert f("في الكتاب خمس وحدات كبيرة", "5") == "في الكتاب خمس وحدات كبيرة"
    assert f("الفصول السبعة، ثم الدرس") == "الفصول، ثم الدرس"


@pytest.mark.parametrize(("raw", "want"), [("a ( ) b", "a b"), (", start; , end :", "start; end"), ("one , two ،، three", "one, two، three"), ("[ ] {}", ""), ("3 .15 stays. ok .", "3 .15 stays. ok"), ("x  y", "x y")])
def test_tidy(spark, raw, want):
    assert value(spark, grounding.tidy, raw) == want


@pytest.mark.parametrize(("word", "want"), [("كتابات", {"كتاب"}), ("مدرسه", {"مدرست", "مدرس", "المدرسه"}), ("بيت", set()), ("ال", set())])
def test_search_forms_by_rule(spark, word, want):
    forms = value(spark, arabic.search_forms, word)
    assert forms[0] == word and want <= set(forms) and len(forms) == len(set(forms))


def test_books_are_found_by_title_or_subject(spark):
    books = spark.createDataFrame([("a", "Algebra", "Math"), ("b", "Geometry", "math"), ("c", "History", "History")], "book_id string, title string, subject string")
    asked = spark.createDataFrame([(1, "ALGEBRA"), (2, "Math"), (3, "history"), (4, "x"), (5, None)], "request_id int, query string")
    assert {tuple(r) for r in pages.resolve_book(asked, books).collect()} == {(1, "a"), (2, None), (3, "c"), (4, None), (5, None)}


def test_foreign_phrases_in_values(spark):
    phrases = spark.createDataFrame([("a", "the history"), ("b", "modern physics"), ("b", "modern physics of light"), ("a", "shared name"), ("b", "shared name")], "book_id string, phrase string")
    values = spark.createDataFrame([("a", 1, "s", "From Modern Physics of light!"), ("a", 2, "s", "a shared name"), ("a", 3, "s", "modern physics"), ("b", 1, "s", "modern physics"), ("a", 4, "s", None)], "book_id string, physical_page int, field string, value string")
    own = spark.createDataFrame([("a", 3, "modern physics " + "word " * 80), ("a", 1, "short")], "book_id string, physical_page int, text string")
    assert [tuple(r) for r in patches.foreign_values(values, phrases, own).collect()] == [("a", 1, "s", "modern physics of light")]


def test_patch_codes_and_warnings(spark):
    rows = [("a", 1, "title", "T" * 95, "f", 0, 0), ("a", 1, "purpose", "short", "f", 0, 1), ("a", 2, "summary", "نص الصفحة مستخرج من كتاب العلوم", "f", 0, 2)]
    accepted, rejects = patches.validated(spark.createDataFrame(rows, "book_id string, physical_page int, field string, value string, source string, priority int, position int"))
    assert {r["field"]: r["warnings"] for r in accepted.collect()} == {"title": ["TITLE_TOO_LONG"], "purpose": ["PURPOSE_SHORT"]}
    assert [r["code"] for r in rejects.collect()] == ["DEAD_TEMPLATE"]


def test_lost_lines_and_severity(spark):
    keys = "book_id string, physical_page int, text string"
    line = "a line of the page that is long enough to count"
    source = spark.createDataFrame([("a", 1, f"{line} one\n{line} two"), ("a", 2, "tiny"), ("b", 1, f"{line} x")], keys)
    index = spark.createDataFrame([("a", 1, "other words"), ("a", 2, ""), ("b", 1, f"{line} x")], keys)
    got = {r["book_id"]: (r["pages"], r["lost"]) for r in consistency.losses(source, index).collect()}
    assert got == {"a": (1, 2 * (len(line) + 4)), "b": (0, 0)}


def test_files_of_patches_keep_earlier_ones(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 12, "y"), ("b", 7, "z")], "book_id string, physical_page int, title string")
    names = [{tuple(r) for r in sinks.write_patches(rows, f"{tmp_path}/p").collect()} for _ in range(3)]
    assert names[0] == {("a", "enrich-a-0003-0012"), ("b", "enrich-b-0007-0007")}
    assert names[1] == {("a", "enrich-a-0003-0012-b1"), ("b", "enrich-b-0007-0007-b1")} and names[2] == {("a", "enrich-a-0003-0012-b2"), ("b", "enrich-b-0007-0007-b2")}
    assert spark.read.json(f"{tmp_path}/p").count() == 9
    report = sinks.patch_report(spark.createDataFrame([("pending", "title"), ("applied", "title")], "state string, field string"), spark.createDataFrame([("CJK",)], "code string"))
    assert {tuple(r) for r in report.collect()} == {("state", "pending", 1), ("state", "applied", 1), ("pending", "title", 1), ("reject", "CJK", 1)}


def test_shard_tables(spark, tmp_path):
    rows = [("a", i, i - 1 if i > 1 else None, f"t{i}", f"word{i % 3} all") for i in range(1, 6)] + [("b", 1, 1, "t", "all")]
    docs = spark.createDataFrame(rows, "book_id string, physical_page int, printed_page int, title string, text string")
    sinks.write_shard_tables(docs, tx.tokens(F.col("text")), f"{tmp_path}/s", 2)
    meta = {(r["book_id"], r["physical_page"]): (r["shard"], r["shard_offset"]) for r in spark.read.parquet(f"{tmp_path}/s/meta").collect()}
    assert meta == {**{("a", i): ((i - 1) // 2, (i - 1) % 2) for i in range(1, 6)}, ("b", 1): (2, 1)}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/s/lookup").collect()} == {("all", 6, 0), ("word0", 1, 6), ("word1", 2, 7), ("word2", 2, 9)}
    assert spark.read.parquet(f"{tmp_path}/s/printed").count() == 5
    assert tuple(spark.read.json(f"{tmp_path}/s/manifest").select("books", "pages", "shards").first()) == (2, 6, 3)
    with pytest.raises(ValueError):
        sinks.write_shard_tables(docs.limit(0), tx.tokens(F.col("text")), f"{tmp_path}/none")


def test_strict_reads_whole_texts_and_manifest(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"id": "b", "n": 1}')
    assert [tuple(r) for r in files.json_strict(spark, f"{tmp_path}/ok.json", "id string, n int").collect()] == [("b", 1)]
    (tmp_path / "bad.json").write_text("{ not json")
    with pytest.raises(Exception, match=r"(?i)malformed|parse"):
        files.json_strict(spark, f"{tmp_path}/bad.json", "id string, n int").collect()
    (tmp_path / "o").mkdir()
    (tmp_path / "o/b1.md").write_text("# outline\n### page 1\n")
    assert files.whole_texts(spark, f"{tmp_path}/o").count() == 1
    held = spark.createDataFrame([("b1", 1), ("b1", 2)], "book_id string, physical_page int")
    facts = spark.createDataFrame([("b1.json", 10, 5)], "file_name string, bytes int, mtime int")
    assert [tuple(r) for r in sinks.manifest(held, facts).select("book_id", "file_name", "bytes", "pages").collect()] == [("b1", "b1.json", 10, 2)]


def test_messages_and_parts(spark):
    parts = json.dumps([{"type": "text", "text": "one"}, {"type": "image_url", "image_url": {"url": "data:image/png;base64,AAAA"}}, {"type": "text", "text": "two"}, {"type": "image_url", "image_url": {"url": "http://x/y.png"}}])
    assert value(spark, semistructured.text_of, parts) == "one\ntwo" and value(spark, semistructured.text_of, "plain") == "plain"
    assert value(spark, semistructured.images_of, parts) == ["data:image/png;base64,AAAA"] and value(spark, semistructured.images_of, "plain") == []
    raw = json.dumps([{"id": "a b!", "role": "user", "content": "hi"}, {"id": None, "role": "system", "content": "x"}, {"role": "assistant", "content": " "}])
    assert [tuple(m) for m in value(spark, semistructured.messages, raw)] == [("ab", "user", "hi")] and value(spark, semistructured.messages, "{bad") == []
    rows = spark.createDataFrame([("c", 0, "user", "shown", "said", False), ("c", 1, "user", "x", None, True), ("c", 2, "assistant", "text", None, None)], "conv_id string, turn int, role string, text string, model_content string, incomplete boolean")
    assert [(r["turn"], r["text"]) for r in semistructured.history(rows).orderBy("turn").collect()] == [(0, "said"), (2, "text")]


def test_rows_without_bucket_edges_and_tables(spark):
    items = [(1, "a", 0.0, 101.1, 10.0, 10.0, 0), (1, "b", 60.0, 100.9, 10.0, 10.0, 1), (1, "c", 0.0, 90.0, 10.0, 10.0, 2), (1, "d", 60.0, 89.0, 10.0, 10.0, 3), (1, "end", 0.0, 50.0, 20.0, 10.0, 4)]
    rows = layout.rows(layout.baselines(spark.createDataFrame(items, "page int, str string, x double, y double, w double, h double, at int")))
    assert [r["line"] for r in rows.orderBy(F.desc("row")).collect()] == ["a | b", "c | d", "end"]
    assert [(r["first"], r["last"], r["columns"], r["rows"]) for r in layout.tables(rows).collect()] == [(-1, -2, 2, [["a", "b"], ["c", "d"]])]


def test_audit_of_a_small_library(spark):
    page = "book_id string, physical_page int, text string, title string, summary string, searchable boolean, needs_ocr boolean, ocr_status string"
    good = "A text that goes on for more than forty characters, as it should."
    held = spark.createDataFrame([("a", 1, good, "A good title", "Some summary that is longer than forty characters is here", True, False, "done"), ("a", 2, "", "", "", True, False, None), ("b", 1, good, good[:30], good[:50], True, True, "done")], page)
    index = spark.createDataFrame([("a", 1, "A good title", "Some summary that is longer", True, "p", 3), ("a", 9, "x", "y", True, "", 0)], "book_id string, physical_page int, title string, summary string, searchable boolean, preview string, n_terms int")
    found = audit.issues(held, index, held.where("book_id = 'a'"), spark.createDataFrame([("a", 3)], "book_id string, entries int"))
    got = {}
    for r in found.collect():
        got.setdefault((r["book_id"], r["physical_page"]), set()).add(r["code"])
    assert got == {
        ("a", 0): {"OUTLINE_COUNT_MISMATCH"}, ("a", 2): {"NO_TEXT_BUT_NOT_FLAGGED", "SEARCHABLE_FLAG_MISMATCH", "OCR_STATUS_MISSING", "WEAK_TITLE", "WEAK_SUMMARY", "SEARCH_DOC_MISSING"}, ("a", 9): {"SEARCH_DOC_ORPHAN"},
        ("b", 0): {"INDEX_BOOK_MISSING", "OUTLINE_COUNT_MISMATCH"}, ("b", 1): {"NEEDSOCR_FLAG_STALE", "DUMP_SUMMARY", "DUMP_TITLE", "INDEX_PAGE_MISSING", "SEARCH_DOC_MISSING", "OUTLINE_FILE_MISSING"},
    }
    assert audit.audit_statistics(held, found).first()["missing_docs"] == 2
