"""What must not grow with the tables: how often a text moves, how many folders a stored table has, what a call derives."""

import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quire.functions import arabic
from quire.functions import text as tx
from quire.operators import boxes, duplicates, grams, layout, quality, search
from quire.operators.numbering import numbered
from quire.plans import checks as plans
from quire.plans import library
from quire.sources import shards, tools


def _exchanges(df, column: str) -> int:
    plan = df._jdf.queryExecution().executedPlan()
    todo, seen = [plan.initialPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Exchange") and column in [node.output().apply(i).name() for i in range(node.output().size())]:
            seen += 1
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return seen


def test_pages_are_numbered_with_one_move(spark, monkeypatch):
    rows = [("a" if i % 3 else "b", i * 997 % 20_000, f"t{i}") for i in range(300)] + [("a", 5, "again"), ("a", 5, "and again"), (None, 1, "x"), (None, 9000, "y")]
    docs = spark.createDataFrame(rows, "book string, id long, text string")
    want = {}
    for book, n, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want.setdefault(book, []).append(n)
    for few in (200_000, 1):
        monkeypatch.setattr("quire.operators.numbering.FEW", few)
        got = numbered(docs, "book", "id", laid=True)
        assert few == 1 or _exchanges(got, "text") == 1
        found = [(r["book"], r["number"], r["id"], r["text"]) for r in got.collect()]
        assert len(found) == len(rows) == len({f[3] for f in found}) and [f[:2] for f in found] == sorted((f[:2] for f in found), key=lambda f: (f[0] is not None, f))
        assert all([f[2] for f in sorted((f for f in found if f[0] == b), key=lambda f: f[1])] == n for b, n in want.items())


def test_a_library_has_few_stretches(spark, tmp_path):
    assert grams.span_for(10) == grams.SPAN and all(n / grams.span_for(n) <= grams.STRETCHES for n in (10**5, 10**6, 10**8))
    held = spark.range(1, 40_001).select(F.lit("b").alias("book_id"), F.col("id").cast("int").alias("physical_page"), F.lit("abc").alias("text"))
    grams.stretched(held, grams.span_for(40_000), laid=True).write.partitionBy(*grams.KEYS).parquet(f"{tmp_path}/view")
    assert len(os.listdir(f"{tmp_path}/view/book_id=b")) <= grams.STRETCHES + 1
    assert spark.read.parquet(f"{tmp_path}/view").count() == 40_000


def test_grams_are_those_of_all_texts(spark):
    texts = ["abcabc", "é😀x日本", None, "", "ab", "nul\x00\x00\x00x"]
    want = {t[i : i + 3].rstrip("\0") for t in texts if t for i in range(len(t) - 2)}
    assert set(grams.grams_of(texts).tolist()) == want and isinstance(grams.grams_of([None]), np.ndarray)
    assert grams.grams_of(["abcde"], 4).tolist() == ["abcd", "bcde"]
    view = spark.createDataFrame([("b", i, t, t, 0) for i, t in enumerate(texts)], "book_id string, physical_page int, text string, title string, stretch int")
    held = grams.index(view, ("text", "title"))
    assert sorted(r["gram"] for r in held.collect()) == sorted(want)
    for query in ("l\x00\x00", "x日", "cab"):
        assert grams.find(view, held, None, query, "phrase", fields=("text",)).count() == search.search(view, None, query, "phrase", fields=("text",)).count() == 1


def test_shards_share_folders(spark, tmp_path):
    docs = spark.range(1, 1001).select(F.lit("b").alias("book_id"), F.col("id").cast("int").alias("physical_page"), F.concat(F.lit("text "), "id").alias("text"))
    shards.write(docs, f"{tmp_path}/s", [], 1)
    assert len([d for d in os.listdir(f"{tmp_path}/s/docs") if "=" in d]) == 1 + 999 // shards.VOLUME
    assert [(r["text"], r["shard"]) for r in shards.page(spark, f"{tmp_path}/s", "b", 700).collect()] == [("text 700", 699)]
    assert shards.read(spark, f"{tmp_path}/s", shards.pointers(spark, f"{tmp_path}/s")).count() == 1000


def test_tools_without_search_need_no_folded_view(spark):
    pages = spark.createDataFrame([("aa", 1, 1, "One", "text")], "book_id string, physical_page int, printed_page int, title string, text string").withColumn("page_type", F.lit("x"))
    books = spark.createDataFrame([("aa", "Alpha", "Maths", "de", 1)], "book_id string, title string, subject string, track string, page_count long")
    assert tools.register(spark, pages, books, prefix="g_") == [f"g_{n}" for n in tools.TOOLS if n != "search_books"]
    assert [r["text"] for r in tools.call(spark, "read_pages_range", "g_", book="aa", printed_from=1, printed_to=2).collect()] == ["text"]


def test_signs_out_of_range_are_counted_beside_ascii(spark):
    signs = "aZ ~\t\n\r\x00\x7f\u0085 éɐЖصݐ–�漢😀"
    rows = [(signs * k, "x" * n) for k in (0, 1, 3) for n in (0, 40, 2000)]
    texts = [a + b for a, b in rows] + [None, "كلمةab ab كلمة", "كلab abكل", "كلab", "  \n"]
    outside = lambda c: not (c in "\t\n\r" or " " <= c <= "~" or "\xa0" <= c <= "ɏ" or "؀" <= c <= "ۿ" or " " <= c <= "⋿")
    held = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "id int, text string, book_id string")
    assert {r[0]: r[1] for r in held.select("id", tx.out_of_range(F.col("text"))).collect()} == {i: None if t is None else sum(map(outside, t)) for i, t in enumerate(texts)}
    assert quality.corruption(held).first()["out_of_range"] == sum(outside(c) for t in texts if t for c in t)

    def damaged(t):
        spaces = " \t\n\x0b\f\r"
        seen = [c for c in t if c not in spaces]
        known = lambda c: "!" <= c <= "~" or "\xa0" <= c <= "ɏ" or "؀" <= c <= "ۿ" or "ݐ" <= c <= "ݿ" or "ﭐ" <= c <= "﷿" or "ﹰ" <= c <= "﻿" or " " <= c <= "⋿" or "" <= c <= ""
        words = t.translate({ord(c): " " for c in spaces}).split(" ")
        both = sum(any("ء" <= c <= "ي" for c in w) and any(c.isascii() and c.isalpha() for c in w) for w in words)
        return "�" in t or both >= 2 or len(seen) >= 40 and sum(not known(c) for c in seen) / len(seen) >= 0.02

    kept = [t.replace("�", "") for t in texts if t is not None] + ["ɐ" + "y" * n for n in (38, 39, 48, 49, 50)]
    got = spark.createDataFrame(list(enumerate(kept)), "id int, text string").select("id", tx.is_damaged(F.col("text"))).collect()
    assert {r[0]: r[1] for r in got} == {i: damaged(t) for i, t in enumerate(kept)}


def test_boxes_move_once_and_packed(spark):
    rows = spark.range(4000).selectExpr("id div 1000 AS page", "id % 1000 AS at", "'s' AS str", "double(id % 8 * 60) AS x", "double(-(id % 1000 div 8) * 12) AS y", "50D AS w", "10D AS h")
    twice = rows.unionByName(rows.selectExpr("page", "at + 1000000 AS at", "str", "x + 2 AS x", "y + 0.5 AS y", "w", "h"))
    got = boxes.overlapping(twice)
    assert _exchanges(got, "page") == 1 and _exchanges(got, "x") == 0
    want = {(p, i, i + 1_000_000) for p in range(4) for i in range(1000)}
    for cell in (4096.0, 50.0):
        found = [(r["page"], r["first"], r["second"]) for r in boxes.overlapping(twice.repartition(5), cell=cell).collect()]
        assert len(found) == len(want) and set(found) == want


def test_checks_leave_texts_where_they_are(spark):
    pages = spark.createDataFrame([("b", i, f"{i} Tiger Horse Mouse", f"text of {i + 1} tiger horse mouse" if i % 4 == 0 else "another") for i in range(12)], "book_id string, physical_page int, title string, text string")
    assert _exchanges(quality.inner_duplication(pages, "physical_page"), "piece") == _exchanges(quality.inner_duplication(pages, "physical_page"), "text") == 0
    drifted = duplicates.drifted(pages)
    assert _exchanges(drifted, "text") + _exchanges(drifted, "before") + _exchanges(drifted, "after") <= 1
    assert sorted(r["physical_page"] for r in drifted.collect()) == [1, 3, 5, 7, 9]


def test_repeats_are_those_of_lines_and_clauses(spark):
    line, clause = "a line of some length", "one clause that - is long (enough) to count"
    texts = [f"{line}\n {line} \nother line of words\nyet another line\n", f"{line}\n{line}", f"{clause}. x! One  CLAUSE that is long; one clause\u064e that is long, enough, to count؟ end", "short", None, ""]
    texts += [f"{clause}\t.{clause.upper()}\n" * 3 + f"{line}\n" * 4]

    def share(t):
        marks, space = {*map(chr, range(0x64B, 0x653)), "\u0670", "\u0640"}, " \t\n\x0b\f\r"
        flat = lambda x: re.sub("[ \t\n\x0b\f\r]+", " ", x).strip(space)
        rule = lambda x: flat("".join(" " if c in "-–—:،,؛;.()[]{}«»\"'’“”" else c for c in x if c not in marks)).lower()
        out = []
        for pieces, size, few in (([flat(p) for p in t.split("\n")], 12, 4), ([rule(p) for p in re.split("[.!؟?\n،؛;]", t)], 30, 2)):
            kept = [p for p in pieces if len(p) >= size]
            out += [(sum(map(len, kept)) - sum(map(len, set(kept)))) / len(t)] if len(kept) >= few else []
        return max(out) if out else None

    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", quality.repeated_share(F.col("text")).alias("s")).collect()
    assert {r[0]: r[1] for r in got} == {i: share(t) if t and len(t) >= 20 else None for i, t in enumerate(texts)}


def test_findings_are_worked_out_once(spark):
    dir_ = "/root/testdata/sf0.001"
    want = sorted(plans.findings(spark, dir_).collect())
    layers = plans._Layers(spark, dir_)
    each = [r for run, _, _ in plans.CHECKS.values() for r in run(layers).collect()]
    assert sorted(each) == want
    for query in (plans.qc_findings_union, plans.qc_book_scores, plans.qc_library_score, plans.qc_gate):
        plan = query(spark, dir_)._jdf.queryExecution().optimizedPlan().toString()
        assert "/pages" not in plan and plan.count("Relation [") <= 4


def test_layout_moves_packed_pages(spark, monkeypatch):
    said = ["a", "b", None, " ", "ب", "tail"]
    items = [(p, said[(i * 7 + (p or 0)) % 6], float(i % 5) * 20 + (0.2 if i % 3 else 0.0), float(i // 5 * 6), None if i % 29 == 0 else 9.5, i) for p in (1, 2, 3, None) for i in range(60)]
    items += [(p, s, x and x + 0.1, y, w, at + 100) for p, s, x, y, w, at in items[::2]]
    df = spark.createDataFrame(items, "page int, str string, x double, y double, w double, at int")
    once = layout.deduplicated(df)
    assert _exchanges(once, "str") == 0 and _exchanges(layout.rows(df), "str") == 0 and _exchanges(once, "b") == 1
    want = {}
    for p, s, x, y, w, at in items:
        want.setdefault((p, s, int(x + 0.5), int(y + 0.5)), []).append((at, x, y, w))
    want = sorted(((p, s, *min(v, key=lambda f: f[0])) for (p, s, _, _), v in want.items()), key=str)
    for most, parts in ((1 << 18, 1), (10, 3)):
        monkeypatch.setattr(layout, "ITEMS", most)
        assert sorted(map(tuple, layout.deduplicated(df.repartition(parts)).collect()), key=str) == want
    sizes = [r["size"] for r in layout.packed(spark.range(20_000).selectExpr("id div 1000 AS page", "id AS at", "double(id % 8) AS x")).selectExpr("length(b) AS size").collect()]
    assert sum(sizes) < 20_000  # below a byte an item


ITEMS = "page int, at int, str string, x double, y double, w double, h double"


def test_page_texts_follow_baselines(spark, monkeypatch):
    # a line that wavers over the edge of two buckets, which lie 2 apart, and one that was painted twice
    items = [(1, 0, "one", 0.0, 101.2, 15.0, 10.0), (1, 1, "line", 25.0, 100.8, 20.0, 10.0), (1, 2, "wavers", 55.0, 98.8, 30.0, 10.0), (1, 3, "below", 0.0, 90.0, 25.0, 10.0), (1, 9, "below", 0.1, 90.1, 25.0, 10.0)]
    df = spark.createDataFrame(items, ITEMS)
    monkeypatch.setattr(library, "_items", lambda spark, sf: df)
    got = library.layout_page_text(spark, None)
    one_by_one = layout.page_text(layout.rows(layout.deduplicated(layout.baselines(df))))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in one_by_one.collect()] == [(1, "one line wavers\nbelow")]
    assert _exchanges(got, "str") == _exchanges(got, "line") == 0 and _exchanges(got, "b") == 1


def test_page_texts_equal_their_stages(spark, monkeypatch):
    pick = random.Random(3)
    odd = lambda v: pick.choice([None, float("nan"), v, v, v, v, v, v, v, v])
    items = []
    for page in [*range(30), None]:
        for at in range(pick.choice([1, 5, 40, 120])):
            y, h = pick.choice([pick.randrange(20) * 16.0, pick.uniform(0, 320)]), pick.choice([1.0, 10.0, 10.0, 30.0])
            items.append((page, at if at else None, pick.choice(["a", "b c", "", " ", None, "\t", "سلام", "دنيا", "end"]), odd(pick.randrange(12) * 20.0), odd(y) if at % 3 == 0 else y, pick.choice([0.0, 9.0, 18.0, None]), odd(h)))
    df = spark.createDataFrame(items, ITEMS)
    want = sorted(map(tuple, layout.page_text(layout.rows(layout.deduplicated(layout.baselines(df)))).collect()), key=str)
    assert sum(text.count("\n") for _, text in want) > 200
    for most in (1 << 18, 50):
        monkeypatch.setattr(layout, "ITEMS", most)
        assert sorted(map(tuple, layout.page_texts(df.repartition(3)).collect()), key=str) == want
    assert layout.page_texts(df.where("page < 0")).count() == 0


def test_lines_are_made_of_packed_pages(spark):
    held = spark.range(4000).selectExpr("id div 1000 AS page", "id % 1000 AS at", "concat('s', id) AS str", "double(id % 8 * 60) AS x", "double(-(id % 1000 div 8) * 12) AS y", "50D AS w", "10D AS h")
    got = boxes.lines(held)
    assert _exchanges(got, "str") == 0 and _exchanges(got, "b") == 1
    assert got.count() == 4 * 125


def _nodes(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_search_forms_are_worked_out_once(spark):
    texts = spark.createDataFrame([("ﻛﺘﺎﺑﺎﺕ in Ｗｏｒｄ and هللا",), (None,), ("plain words of plain text",), ("",)], "text string")
    plan = _nodes(texts.select(arabic.search_tokens(F.col("text")).alias("f")))
    cleaning = tx.BIDI_MARKS  # in both steps of cleaning, which each later one had worked out again
    assert plan.count(cleaning) == 2
    got = [r["f"] for r in texts.select(arabic.search_tokens(F.col("text")).alias("f")).collect()]
    assert set(got[0]) >= {"كتابات", "كتاب", "in", "word", "الword", "and"} and got[1] == got[3] == []
    assert got[2] == ["plain", "الplain", "words", "الwords", "of", "text", "الtext"]
    bare = F.when(F.lit(True), F.col("w"))
    for word, forms in (("words", ["words", "الwords"]), ("abc", ["abc"]), ("بيت", 2), ("قلم", 1)):
        found = spark.createDataFrame([(word,)], "w string").select(arabic.search_forms(bare).alias("f")).first()["f"]
        assert found == forms if isinstance(forms, list) else found[0] == word and len(found) >= 1


def test_rows_of_one_key_repeat_each_other(spark):
    line = "a line of some length"
    text = "\n".join(f"{line} {i}" for i in range(4))
    pages = spark.createDataFrame([("b", 1, text), ("b", 1, text), ("b", 2, text), (None, None, text), (None, None, text)], "book_id string, doc_id long, text string")
    got = {r["book_id"]: (r["mean_share"], r["pages_over"]) for r in quality.inner_duplication(pages).collect()}
    share = round(4 * (len(line) + 2) / len(text), 4)
    assert got == {"b": (share, 1), None: (share, 1)}
