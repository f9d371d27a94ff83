"""Page kinds, grounded numbers, titles and mentions on small fixtures and against plain loops."""

import random

from pyspark.sql import functions as F

from quire.functions import answers, arabic, grounding, kinds, repairs
from quire.operators import titles


def _one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first()["v"]


def test_page_type(spark):
    kind = lambda t: _one(spark, kinds.page_type(F.col("text")), t)
    long = "a sentence of the lesson that goes on for a while without any mark of its kind at all\n" * 6
    assert [kind(t) for t in (None, "", "short")] == ["divider"] * 3
    assert kind("Contents\n" + long) == "contents" and kind("1) a\n2) b\n3) c\n4) d\n" + long) == "exercises"
    assert kind("Glossary\n" + long) == "glossary" and kind(long) == "lesson_content"


def test_title_line(spark):
    title = lambda t: _one(spark, kinds.title_line(F.col("text")), t)
    assert title(None) is None and title("") is None and title("12\n7") is None
    assert title("12\nsome line of words\nUnit one: light") == "Unit one: light" and title("first line\nother line") == "first line"


def test_exercises(spark):
    rows = spark.createDataFrame([("matching", None, None), (None, "١٢ - اكتب", None), (None, None, "اختر الجواب"), (None, None, "12 اختر"), (None, None, None)], "k string, t string, x string")
    assert [r[0] for r in rows.select(kinds.is_exercise(F.col("k"), F.col("t"), F.col("x"))).collect()] == [True, True, True, False, False]


def test_grounded(spark):
    allowed, held = F.array(F.lit("7")), grounding.numbers_of(F.lit("in 1,952 and ٣"))
    put = lambda t: _one(spark, grounding.grounded(F.col("text"), held, allowed), t)
    assert put("from 1952 to 1960 (12)") == "from 1952 to" and put("7 of ٣ or 3") == "7 of ٣ or 3"
    assert put(None) == "" and put("") == "" and put("5") == ""
    assert _one(spark, grounding.ungrounded(F.col("text"), held, allowed), "8 7 8") == ["8", "8"]


def test_folios(spark):
    bare = lambda t, a, b=None: _one(spark, grounding.without_folios(F.col("text"), F.lit(a).cast("int"), F.lit(b).cast("int")), t)
    assert bare("17 013 words 17 here 13 17", 17, 13) == "words 17 here" and bare("17 17", 17) == "17" and bare("5 a", None) == "5 a" and bare(None, 1) == ""


def test_fields(spark):
    assert _one(spark, grounding.field(F.col("text"), 5), " N/A ") == "" and _one(spark, grounding.field(F.col("text"), 5), "a  b cdefg") == "a b c"
    assert _one(spark, grounding.derived_title(F.col("text")), None) == "" and _one(spark, grounding.derived_summary(F.col("text")), None) == ""


def test_told_apart(spark):
    draw = random.Random(3)
    rows = [(f"b{n % 2}", n, draw.choice(["one", "on e", "two", None]), draw.random() < 0.9) for n in range(1, 400)]
    want, last = set(), {}
    for book, page, title, searchable in rows:
        if searchable:
            title, key = title or "", (title or "").replace(" ", "")
            given = f"{title} — page {page}" if last.get(book) == key else title
            last[book] = given.replace(" ", "")
            want.add((book, page, given))
    got = titles.told_apart(spark.createDataFrame(rows, "book_id string, physical_page int, title string, searchable boolean"))
    assert {tuple(r) for r in got.collect()} == want
    assert titles.told_apart(spark.createDataFrame([], "book_id string, physical_page int, title string, searchable boolean")).count() == 0


def test_foreign_mentions(spark):
    phrases = spark.createDataFrame([("a", "old chemistry"), ("b", "new physics"), ("c", "new physics of light"), ("b", "shared name"), ("a", "shared name")], "book_id string, phrase string")
    rows = [("a", 1, "see book New Physics of light"), ("a", 2, "book shared name"), ("a", 3, "the old chemistry book"), ("b", 4, "book Old  Chemistry, book new physics"), ("a", 5, None), ("a", 6, "book new"), ("a", 7, "")]
    got = titles.foreign_mentions(spark.createDataFrame(rows, "book_id string, physical_page int, value string"), phrases)
    assert {tuple(r) for r in got.collect()} == {("a", 1, "new physics of light"), ("b", 4, "old chemistry")}


def test_years(spark):
    got = titles.implausible_years(spark.createDataFrame([("عام 1050 م",), ("x (1050 م",), (None,), ("عام 1950 م",)], "text string"))
    assert {r["year"] for r in got.collect()} == {1050}


def test_damage(spark):
    rows = spark.createDataFrame([(" االكتاب",), (" االكتاب �",), ("�",), ("fine",), (None,)], "text string")
    assert tuple(titles.damage_decomposition(rows, "(^|[ ])اال", "$1ال").first()) == (1, 1, 1)


def test_repairs(spark):
    put = lambda t: _one(spark, repairs.clean(F.col("text")), t)
    assert put(None) == "" and put("a  b\r\n\n\n\nc \u200f") == "a b\n\nc" and put("½ ﬁ Ⅸ") == "½ ﬁ Ⅸ"
    assert put("قال \uf048 و\uf04a") == "قال صلى الله عليه وسلم ورضي الله عنهم" and put("\uf001") == "\uf001"
    assert put("القرآن الكرمي، الكرميين") == "القرآن الكريم، الكرميين" and put("باهلل اهلل هلل") == "بالله الله هلل"
    assert put("االنتاج واالنتاج (االله") == "النتاج واالنتاج (الله" and put("املعلم العاملون معامل") == "المعلم العاملون معامل"
    assert put(put("االنتاج اﷲ")) == put("االنتاج اﷲ") == "النتاج الله" and put("\ufee3\ufea4\ufee4\ufeaa") == "محمد"
    assert _one(spark, arabic.normalise(F.col("text")), "االقتصاد \uf056") == "القتصاد رحمه الله"


def test_answers(spark):
    read = lambda t: tuple(_one(spark, answers.reading(F.col("text")), t))
    assert read(None) == read("\ufeff \n") == (None, answers.EMPTY) and read("words {not} json") == (None, answers.NOT_JSON)
    assert read('x ```json\n{"text": "a\\n\u00e9"}\n``` {"text": "b"}') == ("a\n\u00e9", None) and read('say {"fullText": "f", "text": 3} ok') == ("f", None)
    assert read('{"note": {"text": "deep"}}') == (None, answers.MISSING) and read('{"text": "cut') == (None, answers.SERIALISED) and read('["text"]') == (None, answers.NOT_JSON)
    assert read('```\nno\n``` {"text": ""}') == ("", None)
    canonical = lambda t: _one(spark, answers.canonical(F.col("text")), t)
    assert canonical('{"b":[{"z":1,"a":null}], "a" : {"d":"x","c":true}}') == '{"a":{"c":true,"d":"x"},"b":[{"a":null,"z":1}]}'
    assert canonical("{") is None and canonical(None) is None and canonical('{"a":1,"a":2}') is None and canonical("[2,1]") == "[2,1]"
