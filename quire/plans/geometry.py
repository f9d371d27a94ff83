"""Queries over positioned boxes and over titles that depend on the page before; they join those of ``library``."""

from pyspark.sql import functions as F

from quire.functions import kinds
from quire.operators import boxes, titles
from quire.plans import corpus
from quire.plans import sqltext as s
from quire.plans.corpus import table
from quire.plans.details import _points
from quire.plans.library import R, _items

_WORDS = "WITH w AS (SELECT doc_id AS page, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda e: e <> '') AS w FROM documents)"


def _laid(spark, sf):
    """Every document's words as boxes, eight a row with a gap in the middle, and under every fifth row a fraction between two rows."""
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.filter(F.split("text", "\\s+"), lambda x: x != "").alias("w"))
    each = words.select("page", F.posexplode("w").alias("at", "str"))
    row, column = F.floor(F.col("at") / 8), F.col("at") % 8
    laid = each.select("page", "str", (column * 60.0 + F.when(column >= 4, 200.0).otherwise(0.0)).alias("x"), (-row * 60.0).alias("y"), F.lit(40.0).alias("w"), F.lit(10.0).alias("h"), "at")
    rows = words.where(F.size("w") > 0).select("page", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 8).cast("int"))).alias("row")).where("row % 5 = 2")
    part = lambda said, x, off, w, i: F.struct(said.alias("str"), F.lit(x).alias("x"), (-F.col("row") * 60.0 - off).alias("y"), F.lit(w).alias("w"), F.lit(10.0).alias("h"), (F.lit(10_000_000) + F.col("row") * 3 + i).alias("at"))
    number = F.col("row").cast("string")
    parts = F.array(part(F.concat(F.lit("n"), number), 95.0, 22.0, 20.0, 0), part(F.lit("===="), 80.0, 30.0, 50.0, 1), part(F.concat(F.lit("d"), number), 95.0, 38.0, 20.0, 2))
    return laid.unionByName(rows.select("page", F.inline(parts)))


@R.add(
    _WORDS + ", r AS (SELECT page, w, unnest(generate_series(0, (len(w) - 1) // 8)) AS row FROM w WHERE len(w) > 0), l AS (SELECT page, row * 2 AS pos, array_to_string(w[8 * row + 1:8 * row + 4], ' ') || CASE WHEN len(w) > 8 * row + 4 THEN '  ' || array_to_string(w[8 * row + 5:8 * row + 8], ' ') ELSE '' END AS text, "
    "CASE WHEN len(w) > 8 * row + 4 THEN 2 ELSE 1 END AS segments FROM r UNION ALL SELECT page, row * 2 + 1, 'n' || row || ' / d' || row, 1 FROM r WHERE row % 5 = 2), f AS (SELECT page, count(*) AS n FROM r WHERE row % 5 = 2 GROUP BY page) "
    "SELECT l.page, CAST(row_number() OVER (PARTITION BY l.page ORDER BY pos) AS INTEGER) AS line, text, CAST(segments AS INTEGER) AS segments, CAST(coalesce(n, 0) AS INTEGER) AS fractions FROM l LEFT JOIN f ON f.page = l.page", base=False,
)
def layout_fractions(spark, sf):
    """Distinct words only: what is repeated would go before rows are formed."""
    told = _laid(spark, sf).withColumn("str", F.when(F.col("at") < 10_000_000, F.concat("str", F.lit("\x01"), F.col("at").cast("string"))).otherwise(F.col("str")))
    return boxes.lines(told).withColumn("text", F.regexp_replace("text", "\x01[0-9]+", ""))


_TWICE = (
    "WITH i AS (SELECT doc_id AS page, unnest(generate_series(0, len(w) - 1)) AS pos, w FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS w FROM documents)), o AS (SELECT page, CAST(pos AS BIGINT) AS place, pos // 8 AS row, (pos % 8) * 60.0::DOUBLE AS x, 800.0::DOUBLE - (pos // 8) * 12 - ((pos % 8) // 3) * 0.4::DOUBLE AS y, length(w[pos + 1]) * 5.0::DOUBLE AS w FROM i), "
    "b AS (SELECT * FROM o UNION ALL SELECT page, place + 1000000, row, x + 2, y + 0.5::DOUBLE, w FROM o) "
)


@R.add(
    _TWICE + "SELECT a.page, a.place AS first, c.place AS second FROM b a JOIN b c ON a.page = c.page AND a.row = c.row AND a.place < c.place WHERE a.w > 0 AND c.w > 0 AND least(a.x + a.w, c.x + c.w) > greatest(a.x, c.x) "
    "AND (least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * (least(a.y, c.y) + 10 - greatest(a.y, c.y)) >= 0.5::DOUBLE * 10 * least(a.w, c.w)", base=False,
)
def layout_overlaps(spark, sf):
    """Every box and its copy, painted a little off: those that cover half of each other."""
    once = _items(spark, sf)
    both = once.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    moved = both.withColumns({"at": F.col("at").cast("long") + F.col("k") * 1_000_000, "x": F.col("x") + F.col("k") * 2, "y": F.col("y") + F.col("k") * 0.5})
    return boxes.overlapping(moved.drop("k")).select("page", "first", "second")


@R.add()
def layout_repeats(spark, sf):
    """What is left of every document's words when each run of six or more that occurred before is dropped."""
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "[ \n]+")).alias("at", "word"))
    return boxes.without_repeats(words).groupBy("page").agg(F.count("*").alias("words"), F.max("at").alias("last"))


@R.add(
    f"WITH l AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), k AS (SELECT page, line, {s.replaced('text', (f'{s.SPACE}+', ''), (r'[\x{064B}-\x{065F}\x{0670}]', ''))} AS k FROM l) "
    "SELECT page, count(*) - count(k) FILTER (WHERE length(k) >= 6) + count(DISTINCT CASE WHEN length(k) >= 6 THEN k END) AS lines FROM k GROUP BY page", base=False,
)
def layout_ghosts(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return boxes.without_ghosts(lines).groupBy("page").agg(F.count("*").alias("lines"))


_KEY = lambda x: s.replaced(x, (f"{s.SPACE}+", ""), (r"[\x{064B}-\x{065F}\x{0670}]", ""))
_BODY = "CASE WHEN physical_page % 9 BETWEEN 2 AND 5 THEN 'One short title' || chr(10) || text ELSE text END"


@R.add(
    ", l AS (SELECT book_id, physical_page, list_filter(list_transform(string_split(" + s.clean(_BODY) + f", chr(10)), lambda e: {s.strip('e')}), lambda e: e <> '') AS every FROM p), m AS (SELECT book_id, physical_page, list_filter(every, lambda e: length(e) BETWEEN 3 AND 150 AND regexp_matches(e, '\\p{{L}}')) AS l FROM l), "
    f"k AS (SELECT book_id, physical_page, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM m), g AS (SELECT book_id, physical_page, list({{'t': substr(e, 1, 140), 's': {_points('e')}}} ORDER BY {_points('e')} DESC, i) AS l FROM k GROUP BY ALL), "
    "o AS (SELECT p.book_id, p.physical_page, row_number() OVER (PARTITION BY p.book_id ORDER BY p.physical_page) AS place, g.l FROM p LEFT JOIN g ON g.book_id = p.book_id AND g.physical_page = p.physical_page), "
    f"q AS (SELECT *, list_filter(l, lambda e: {_KEY('e.t')} <> {_KEY('l[1].t')})[1] AS other, substr(l[1].t, 1, 140 - length(' — page ' || physical_page)) || ' — page ' || physical_page AS numbered FROM o), "
    f"z AS (SELECT book_id, physical_page, place, l[1].t AS first, {_KEY('l[1].t')} AS k, CASE WHEN other.s > l[1].s - {titles.LOSS}::DOUBLE THEN other.t ELSE numbered END AS second FROM q), "
    f"t AS (SELECT book_id, physical_page, place, first AS title FROM z WHERE place = 1 UNION ALL SELECT z.book_id, z.physical_page, z.place, CASE WHEN {_KEY('t.title')} = z.k THEN z.second ELSE z.first END FROM t JOIN z ON z.book_id = t.book_id AND z.place = t.place + 1) "
    "SELECT book_id, physical_page, title FROM t"
)
def win_chained_titles(spark, sf):
    body = F.when((F.col("physical_page") % 9).between(2, 5), F.concat(F.lit("One short title\n"), "text")).otherwise(F.col("text"))
    p = corpus.pages(spark, sf)
    return titles.chained(p.select("book_id", "physical_page", kinds.ranked_titles(body).alias("titles")), 16)


R.sql["win_chained_titles"] = R.sql["win_chained_titles"].replace("WITH pages_ AS", "WITH RECURSIVE pages_ AS", 1)
