import time

from pyspark.sql import functions as F

from quire.operators import audit, documents, layout, numbering, pages, patches, quality, search, semistructured
from quire.sources import files, sinks


def test_paging_adds_up(spark):
    rows = spark.createDataFrame([("b", i, "that page") for i in range(30)] + [("a", 1, "That one")], "book_id string, physical_page int, text string")
    view = rows.withColumn("text", F.lower("text"))
    hits = lambda: search.search(view, None, "that", fields=("text",))
    got = [(r["book_id"], r["physical_page"]) for o in range(0, 40, 8) for r in search.window(hits(), o, 8).collect()]
    assert got == [("a", 1)] + [("b", i) for i in range(30)]
    last = search.paged(hits(), 24, 8).collect()
    assert len(last) == 7 and {(r["total"], r["next_offset"]) for r in last} == {(31, None)}
    assert search.search(view, None, "   ", fields=("text",)).count() == 0
    assert search.search(view, None, "zzz that", "unknown", fields=("text",)).count() == 31


def test_missing_ranges_and_present_pages_fill_the_range(spark):
    rows = spark.createDataFrame([("a", n) for n in (2, 3, 7, 7, 12)] + [("b", 1)], "book_id string, n int")
    gaps = [tuple(r) for r in pages.missing_ranges(rows, "n", 1, 12).orderBy("book_id", "first_missing").collect()]
    assert gaps == [("a", 1, 1), ("a", 4, 6), ("a", 8, 11), ("b", 2, 12)]


def test_numbering_and_medians(spark):
    rows = spark.createDataFrame([("g", i * 37) for i in range(500)] + [(None, 5), (None, 3), ("h", 9)], "g string, v long")
    got = {(r["g"], r["v"]): r["n"] for r in numbering.numbered(rows, "g", "v", width=100, name="n").collect()}
    assert got == {**{("g", i * 37): i + 1 for i in range(500)}, (None, 3): 1, (None, 5): 2, ("h", 9): 1}
    medians = numbering.upper_medians(spark.createDataFrame([("e", x) for x in (1, 2, 3, 4)] + [("o", x) for x in (5, 5, 1)], "g string, v int"), "g", F.col("v"), F.floor(F.col("v") / 2))
    assert {tuple(r) for r in medians.collect()} == {("e", 3), ("o", 5)}


def test_patches_in_order_with_the_prefix_rule(spark):
    held = spark.createDataFrame([("a", 1, "Old title", None), ("a", 2, "Keep", "s")], "book_id string, physical_page int, title string, summary string")
    rows = [("a", 1, "title", "New long title", "f1", 0, 0), ("a", 1, "title", "New long", "f2", 1, 0), ("a", 1, "title", "�", "f3", 1, 1), ("a", 1, "title", "12 folio", "f3", 1, 2), ("a", 2, "title", "漢字", "f3", 1, 3), ("a", 1, "summary", "x" * 700, "f1", 0, 1), ("a", 9, "title", "no page", "f1", 0, 2), ("a", 2, "summary", " ", "f1", 0, 4)]
    given = spark.createDataFrame(rows, "book_id string, physical_page int, field string, value string, source string, priority int, position int")
    accepted, rejects = patches.validated(given)
    assert sorted((r["field"], r["code"]) for r in rejects.collect()) == [("summary", "EMPTY"), ("title", "CJK"), ("title", "TITLE_FOLIO"), ("title", "U_FFFD")]
    got = {r["physical_page"]: r for r in patches.apply(held, accepted, ["title", "summary"]).collect()}
    assert got[1]["title"] == "New long title" and len(got[1]["summary"]) == 600 and got[2]["title"] == "Keep" and got[2]["summary"] == "s"
    state = {(r["physical_page"], r["field"]): r["state"] for r in patches.outcome(held, patches.last_wins(accepted), ["title", "summary"]).collect()}
    assert state == {(1, "title"): "pending", (1, "summary"): "pending", (9, "title"): "missing"}


def test_foreign_phrases_are_not_own(spark):
    rows = spark.createDataFrame([("a", "algebra"), ("b", "history"), ("a", "library"), ("b", "library"), ("c", "short")], "book_id string, phrase string")
    assert {tuple(r) for r in patches.foreign_phrases(rows).collect()} == {("a", "history"), ("b", "algebra")}


def test_outline_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b1", 1, None, "One", "first"), ("b1", 2, 7, "Two\nlines", "second"), ("b2", 1, 3, None, "x")], "book_id string, physical_page int, printed_page int, title string, description string")
    sinks.write_outlines(rows, f"{tmp_path}/o")
    texts = spark.read.text(f"{tmp_path}/o", wholetext=True)
    got = semistructured.outline_entries(texts).select("book_id", "physical_page", "printed_page", "title", "description")
    assert {tuple(r) for r in got.collect()} == {("b1", 1, None, "One", "first"), ("b1", 2, 7, "Two lines", "second"), ("b2", 1, 3, "", "x")}
    assert {tuple(r) for r in semistructured.outline_counts(texts).collect()} == {("b1", 2), ("b2", 1)}


def test_negative_sentences_go(spark):
    clean = lambda text, has: spark.range(1).select(semistructured.without_negative_sentences(F.lit(text), has_text=F.lit(has)).alias("v")).first()["v"]
    assert clean("Define the terms. There is no text here.", True) == "Define the terms."
    assert clean("Define the terms. There is no text here.", False) == ""
    assert clean("All good. Fine.", False) == "All good. Fine."


def test_events_and_tool_calls(spark):
    raw = 'event: delta\ndata: {"a":1}\n\ndata: two\ndata: lines\r\n\r\n: comment\n\nevent: done\ndata: end'
    got = semistructured.sse_events(spark.createDataFrame([("s", raw)], "k string, raw string"), "k", "raw").orderBy("at").collect()
    assert [(r["event"], r["data"]) for r in got] == [("delta", '{"a":1}'), ("message", "two\nlines"), ("message", ""), ("done", "end")]
    parts = spark.createDataFrame([("s", 2, 0, "", '"x"}'), ("s", 0, 0, "search", "{"), ("s", 1, 0, None, '"q":'), ("s", 0, 1, "read", None)], "stream string, at int, call int, name string, arguments string")
    assert {tuple(r) for r in semistructured.assembled_calls(parts).collect()} == {("s", 0, "search", '{"q":"x"}'), ("s", 1, "read", "")}


def test_json_in_text(spark):
    un = lambda t: spark.range(1).select(semistructured.unwrapped(F.lit(t)).alias("v")).first()["v"]
    assert un('{"page": 1, "text": "a\\nb"}') == "a\nb"
    assert un('{"text": "raw\nline", "x": 1}') == "raw\nline"
    assert un('{"text": "cut off here') == "cut off here"
    assert un("plain text") == "plain text"
    fenced = lambda t: spark.range(1).select(semistructured.fenced_json(F.lit(t)).alias("v")).first()["v"]
    assert fenced('ok\n```json\n{"a": 1}\n```') == '{"a": 1}' and fenced('so {"b": 2} then') == '{"b": 2}' and fenced("none") is None
    quiz = '{"questions":[{"question":"q1","options":["a","b"],"answer":"b"},{"question":"q2","options":["a","b"],"answer":"1"},{"question":"q3","options":["a"],"answer":"a"},{"question":"","options":["a","b"],"answer":"a"},{"question":"q5","options":["a","b"],"answer":"c"}]}'
    got = spark.range(1).select(semistructured.quiz_questions(F.lit(quiz)).alias("v")).first()["v"]
    assert [(q["question"], q["answer_at"]) for q in got] == [("q1", 1), ("q2", 1)]


def test_layout(spark):
    items = [(1, "Hello", 0.0, 100.0, 30.0, 0), (1, "world", 36.0, 100.5, 30.0, 1), (1, "cell", 120.0, 100.0, 20.0, 2), (1, "below", 0.0, 80.0, 30.0, 3), (1, "below", 0.2, 80.1, 30.0, 4), (2, "ب", 50.0, 10.0, 5.0, 0), (2, "ا", 60.0, 10.0, 5.0, 1), (2, " ", 70.0, 10.0, 5.0, 2)]
    df = spark.createDataFrame(items, "page int, str string, x double, y double, w double, at int")
    lines = layout.rows(layout.deduplicated(df))
    assert {tuple(r) for r in layout.page_text(lines).collect()} == {(1, "Hello world | cell\nbelow"), (2, "اب")}
    assert {tuple(r) for r in layout.columns(lines).collect()} == {(1, 2), (2, 1)}
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b c d e f x a b c d e f y".split())], "page int, at int, word string")
    assert [r["word"] for r in layout.without_repeated_blocks(words).orderBy("at").collect()] == list("abcdefxy")


def test_scores_and_gate(spark):
    books = spark.createDataFrame([("a",), ("b",), ("c",)], "book_id string")
    found = spark.createDataFrame([("a", "A1", "critical"), ("a", "A2", "low"), *[("b", "A2", "critical")] * 9], "book_id string, code string, severity string")
    assert {r["book_id"]: r["score"] for r in quality.book_scores(books, found).collect()} == {"a": 87.0, "b": 20.0, "c": 100.0}
    verdicts = spark.createDataFrame([("proven",)], "verdict string")
    assert quality.gate(found, verdicts).first()["blocked"] and not quality.gate(found.limit(0), verdicts).first()["blocked"]


def test_titles_and_facts(spark):
    rows = spark.createDataFrame([("12", "A proper title here", "A proper title here and its text"), (None, "", "x")], "a string, b string, text string")
    best = documents.best_title([(F.col("a"), 3), (F.col("b"), 1)], F.col("text"))
    assert [r["t"] for r in rows.select(best.alias("t")).collect()] == ["A proper title here", None]
    text = "Too short. The quick animal jumped across several enormous wooden fences yesterday. Nothing else happened at all that day in the old town."
    assert spark.range(1).select(audit.fact_sentence(F.lit(text), page=0).alias("v")).first()["v"].startswith("The quick animal")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "books").mkdir()
    (tmp_path / "books/b-1.json").write_text('{"id": "b-1", "title": "T", "pages": [{"physicalPage": 1, "fullText": "one"}, {"physicalPage": 1, "fullText": "uno"}, {"physicalPage": 0}]}')
    (tmp_path / "books/bad.json").write_text("{ not json")
    books = files.json_tolerant(spark, f"{tmp_path}/books", files.BOOK)
    assert [tuple(r)[:4] for r in files.catalog_pages(books).collect()] == [("b-1", 1, None, "uno")]
    assert files.json_tolerant(spark, f"{tmp_path}/none", files.BOOK).count() == 0
    (tmp_path / "extra").mkdir()
    (tmp_path / "extra/b-1.json").write_text('{"schemaVersion": 1, "bookId": "b-1", "pages": {"٣": {"title": "x"}}}')
    (tmp_path / "extra/b-2.json").write_text('{"schemaVersion": 1, "bookId": "other", "pages": {"1": {"title": "x"}}}')
    assert [(r["book_id"], r["physical_page"], r["title"]) for r in files.enrichment(spark, f"{tmp_path}/extra").collect()] == [("b-1", 3, "x")]
    (tmp_path / "patches").mkdir()
    (tmp_path / "patches/generated-1.json").write_text('[{"bookId": "b", "physicalPage": 1, "title": "g"}]')
    (tmp_path / "patches/review.json").write_text('{"patches": [{"bookId": "b", "physicalPage": 1, "title": "r", "summary": "s"}]}')
    (tmp_path / "patches/broken.json").write_text('{"x": ')
    (tmp_path / "patches/rejected-1.json").write_text('{"count": 2, "rejects": [{"bookId": "b", "physicalPage": 1, "field": "title", "code": "CJK"}, {"bookId": "b", "physicalPage": 1, "field": "title", "code": "CJK"}]}')
    entries, errors = files.patch_files(spark, f"{tmp_path}/patches")
    assert [r["source"] for r in errors.collect()] == ["broken.json"]
    values = files.patch_values(entries, {"title": "title", "summary": "summary"})
    assert {(r["field"], r["value"]) for r in patches.last_wins(values).collect()} == {("title", "r"), ("summary", "s")}
    assert [tuple(r) for r in files.reject_ledger(spark, f"{tmp_path}/patches/rejected-*.json").collect()] == [("b", 1, "title", 2)]
    facts = files.file_facts(spark, f"{tmp_path}/patches", digest=True).collect()
    assert len(facts) == 4 and all(len(r["digest"]) == 64 and not r["is_pdf"] for r in facts)
    table = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "book_id string, physical_page int, text string")
    sinks.write_index(table, f"{tmp_path}/index")
    sinks.write_books(spark.createDataFrame([("a", 1, "new")], table.schema), f"{tmp_path}/index")
    assert {(r["book_id"], r["text"]) for r in files.first_readable(spark, f"{tmp_path}/nothing", f"{tmp_path}/index").collect()} == {("a", "new"), ("b", "z")}
    sinks.write_shards(table.coalesce(1), f"{tmp_path}/shards", 2)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 3
    sinks.write_report(table, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 3
    (tmp_path / "code").mkdir()
    (tmp_path / "code/a.py").write_text("open('used-layer')")
    assert {tuple(r) for r in files.readers_of(spark, f"{tmp_path}/code", spark.createDataFrame([("used-layer",), ("dead-layer",)], "layer string")).collect()} == {("used-layer", 1), ("dead-layer", 0)}


def test_streamed_calls(spark, tmp_path):
    from quire.streaming import calls

    schema = "stream string, call int, at int, name string, arguments string, done boolean"
    for i, rows in enumerate(([("s", 0, 1, None, '"q"}', False), ("s", 1, 0, "read", "{}", True)], [("s", 0, 0, "search", "{", False), ("s", 0, 2, None, "", True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
    query = calls.assemble(read).writeStream.format("memory").queryName("calls").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
    want = {("s", 0, "search", '{"q"}'), ("s", 1, "read", "{}")}
    try:
        end = time.time() + 60
        while time.time() < end and {tuple(r) for r in spark.sql("SELECT * FROM calls").collect()} != want:
            time.sleep(0.5)
        assert {tuple(r) for r in spark.sql("SELECT * FROM calls").collect()} == want
    finally:
        query.stop()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert calls.activity(events).agg(F.sum("n")).first()[0] == events.count()


def test_batch_search_of_short_queries(spark):
    texts = [(1, "one two three four"), (2, "one\ntwo"), (3, ""), (4, None), (5, "threefour"), (6, "two three")]
    asked = ["one", "two three", "one\ntwo", "", " ", "hree", "two three four", "one two three four", None, "a  b"]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    got = sorted(map(tuple, search.batch(docs, queries, "item_id", "text").collect()))
    assert got == sorted((d, i) for d, t in texts for i, q in enumerate(asked) if t is not None and q is not None and q in t)


def test_gate_counts_unverified_numbers(spark, monkeypatch):
    from quire.plans import checks

    monkeypatch.setattr(checks, "findings", lambda *_: spark.createDataFrame([("a", "A1", "high")], "book_id string, code string, severity string"))
    monkeypatch.setattr(checks, "_numbers", lambda *_: spark.createDataFrame([("proven",), ("unverified",)], "verdict string"))
    assert tuple(checks.R.queries["qc_gate"](spark, "").first()) == (0, 1, True)
