import random
import re
from html import unescape

import numpy as np
import pytest

from quire.llm import html


def table(a, b):
    """LCS length by the plain recurrence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1 << 27, 10])
def test_longest_common_subsequence(most):
    pick = random.Random(1)
    for n in range(400):
        a, b = ([pick.randint(0, pick.choice([2, 5, 30])) for _ in range(pick.randint(0, 25))] for _ in range(2))
        got = html.common(a, b, most)
        assert got == sorted(set(got)) and len(got) == table(a, b)
        at = iter(b)
        assert all(a[i] in at for i in got)


CASES = [
    ("", [], []),
    ("plain &amp; simple", ["plain & simple"], [0]),
    ("<p>a<br>b\n c&nbsp;d</p>e", ["a b c d", "e"], [0, 0]),
    ("<title>t</title><script>var x='</p>';</script><p>one<p>two<b>three", ["one", "twothree"], [0, 0]),
    ("<body class='sidebar'><nav><ul><li><a href='x>y'>m</a></ul></nav><article><header><h1>T</h1></header><p>x<footer>f</footer></article><footer>g", ["m", "T", "x", "f", "g"], [2, 1, 1, 2, 2]),
    ('<div class="ad">buy</div><div id=cookieNotice>ok?</div><div class="main-content">text <span class="ad">!</span>more</div><section class=comments>c</section>', ["buy", "ok?", "text more", "!", "c"], [3, 3, 1, 3, 3]),
    ('<div class="has-sidebar"><p class="promo">x<p>y</div>', ["x", "y"], [3, 0]),
    ("<main><aside>s</aside>t<form>f<button>b</button></form><article class=comment>no</article>u", ["s", "t", "fb", "no", "u"], [2, 1, 2, 3, 1]),
    ("<article>a < b && c</article><!-- x --><!doctype html><p>open <a href=\"", ["a < b && c", "open"], [1, 0]),
    ("</div></p>x<style>", ["x"], [0]),
    ("<article>1<!-- never closed", ["1"], [1]),
    ("<p>&lt;b&gt; &#233;&copy;</p>", ["<b> é©"], [0]),
]


@pytest.mark.parametrize("page, texts, zones", CASES)
def test_lines_and_zones(page, texts, zones):
    assert html.lines_of(page) == (texts, zones)


def test_long_and_odd_pages_take_linear_time():
    for page in ("<" * 300_000, '<a b="' * 50_000, "<div>" * 100_000 + "x", "<!--" * 100_000, "<p class='" * 50_000, "&" * 300_000, "<script>" * 50_000):
        html.lines_of(page)


SITE = "<ul><li>Home<li>News<li>About us</ul><div>{}</div><div>All rights reserved</div>"
TABLE = "page_id long, url string, html string, text string, host string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], TABLE)


def test_differencing_deletes_what_neighbours_share(spark):
    bodies = [f"<p>Story {i}<p>It has {i * i} lines" for i in range(40)]
    rows = [(i, f"http://Site.org/{i % 4}/{i}", SITE.format(b)) for i, b in enumerate(bodies)]
    rows += [(100, "http://alone.org/", SITE.format("<p>Only one"))]
    for parts in (1, 7):
        got = {r["page_id"]: r for r in html.extract(rows_of(spark, rows).repartition(parts)).collect()}
        for i, (_, _, _) in enumerate(rows[:-1]):
            assert got[i]["text"] == f"Story {i}\nIt has {i * i} lines" and got[i]["n_shared"] == 4
    assert got[100]["text"].startswith("Home\nNews") and got[100]["n_shared"] == 0


def test_neighbours_are_the_nearest_paths_on_the_host(spark):
    pick = random.Random(4)
    rows = [(f"h{pick.randint(0, 3)}", f"/{pick.randint(0, 10**6)}", i, [i]) for i in range(500)]
    rows += [("", "", 1000, [1000])]
    got = html.neighbours(spark.createDataFrame(rows, "host string, path string, page long, lines array<long>").repartition(6)).collect()
    assert len(got) == len(rows)
    order = sorted(rows)
    at = {r[2]: i for i, r in enumerate(order)}
    for r in got:
        i = at[r["page"]]
        for name, k in (("before", i - 1), ("after", i + 1)):
            near = order[k] if 0 <= k < len(order) and order[k][0] == r["host"] else None
            assert r[name] == (near[3] if near else None)


def test_markup_keeps_copied_articles_and_drops_unshared_menus(spark):
    page = lambda i, story: f"<nav>menu {i}</nav><div class=ad>advert {i}</div><article><h1>T</h1><p>{story}</article><footer>foot {i}</footer>"
    rows = [(i, f"http://a.org/{i}", page(i, "a copied story")) for i in range(6)] + [(6, "http://a.org/3", page(3, "a copied story")), (7, None, None), (None, "no host", ""), (8, "x://", "<p>y")]
    got = html.extract(rows_of(spark, rows))
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        want = {7: "", None: "", 8: "y"}.get(r["page_id"], "T\na copied story")
        assert (r["text"], r["n_chars"]) == (want, len(want))
    alone = {r["page_id"]: r["text"] for r in html.extract(rows_of(spark, rows), markup=False).collect()}
    assert alone[0] == "menu 0\nadvert 0\nfoot 0"
    assert html.extract(rows_of(spark, rows).limit(0)).count() == 0


def test_given_pages_against_their_article_elements(spark):
    from quire.llm.queries import op12_html_extraction

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = op12_html_extraction(spark, sf).collect()
    assert sorted(r["page_id"] for r in found) == sorted(pages)
    for r in found:
        inner = re.search("(?s)<article>(.*?)</article>", pages[r["page_id"]])[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_verdicts():
    zones, shared = np.array([0, 2, 0, 3]), np.array([True, False, False, False])
    assert html.kept(zones, shared).tolist() == [False, False, True, False]
    assert html.kept(zones, shared, False).tolist() == [False, True, True, True]
    assert html.kept(np.array([3, 3, 2]), np.array([True, False, False])).tolist() == [False, True, False]
    assert html.kept(np.array([1, 0, 2]), np.array([True, False, False])).tolist() == [True, False, False]
