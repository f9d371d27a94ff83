"""Lines from boxes, overlaps, repeated blocks and chained titles, against plain loops."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import boxes, layout, titles

BOXES = "page int, str string, x double, y double, w double, h double, at int"


def row(page, y, words, at, x=0.0, step=60.0, w=40.0):
    return [(page, s, x + step * i, y, w, 10.0, at + i) for i, s in enumerate(words)]


def lines(spark, rows):
    return [(r["text"], r["segments"], r["fractions"]) for r in boxes.lines(spark.createDataFrame(rows, BOXES)).orderBy("page", "line").collect()]


def test_fractions_take_the_nearest_parts(spark):
    rows = row(1, 100.0, ["x", "=", "====", "z"], 0) + [(1, "1", 125.0, 108.0, 10.0, 10.0, 10), (1, "2", 140.0, 108.0, 10.0, 10.0, 11), (1, "7", 132.0, 92.0, 12.0, 10.0, 12), (1, "9", 132.0, 84.0, 12.0, 10.0, 13)]
    assert lines(spark, rows) == [("x = 2 1 / 7 z", 1, 1), ("9", 1, 1)]
    # off the middle, too far, a blank to fill in, and letters are no fraction
    assert lines(spark, [(1, "====", 0.0, 50.0, 60.0, 10.0, 0), (1, "1", 0.0, 58.0, 10.0, 10.0, 1)]) == [("1", 1, 0), ("====", 1, 0)]
    assert lines(spark, [(1, "====", 0.0, 50.0, 60.0, 10.0, 0), (1, "1", 25.0, 75.0, 10.0, 10.0, 1)]) == [("1", 1, 0), ("====", 1, 0)]
    assert lines(spark, [(1, "____", 0.0, 50.0, 60.0, 10.0, 0), (1, "1", 25.0, 58.0, 10.0, 10.0, 1)]) == [("1", 1, 0), ("____", 1, 0)]
    assert lines(spark, [(1, "====", 0.0, 50.0, 60.0, 10.0, 0), (1, "5", 25.0, 42.0, 10.0, 10.0, 1)]) == [("/ 5", 1, 1)]


def test_segments_directions_and_rows(spark):
    rows = row(1, 100.0, ["a", "b"], 0) + row(1, 101.0, ["c", "d"], 2, x=400.0) + row(2, 100.0, ["سلام", "دنيا"], 0) + row(2, 100.0, ["آخر"], 5, x=500.0) + [(3, " ", 0.0, 0.0, 1.0, 1.0, 0), (4, "x", None, 0.0, 1.0, 1.0, 0)]
    assert lines(spark, rows) == [("a b  c d", 2, 0), ("آخر  دنيا سلام", 2, 0)]
    assert boxes.lines(spark.createDataFrame([], BOXES)).count() == 0


def test_twins_and_ghosts(spark):
    rows = row(1, 100.0, ["same", "word"], 0) + row(1, 100.5, ["same", "word"], 4, x=5.0) + row(1, 100.0, ["word"], 9, x=200.0)
    assert lines(spark, rows) == [("same word  word", 2, 0)]
    held = spark.createDataFrame([(1, 1, "a ghost line"), (1, 2, "aghost  line"), (1, 3, "abc"), (1, 4, "abc"), (2, 1, "a ghost line")], "page int, line int, text string")
    assert sorted((r["page"], r["line"]) for r in boxes.without_ghosts(held).collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]


class Box:
    def __init__(self, said, x, y, w, h, at):
        self.said, self.x, self.y, self.w, self.h, self.at, self.end = said, x, y, w, h, at, x + w


def plain_rows(made):
    """Box by box: each joins the first row that is in reach; what a box as tall as the tallest so far can't reach is done with."""
    rows, done, tallest = [], 0, 0.0
    for box in sorted(made, key=lambda b: (-b.y, b.x, b.at)):
        tallest = max(tallest, box.h)
        while done < len(rows) and rows[done][0].y - box.y > max(0.9, 0.34 * tallest):
            done += 1
        near = [r for r in rows[done:] if abs(r[0].y - box.y) <= max(0.9, 0.34 * max(b.h for b in [*r, box]))]
        if near:
            near[0].append(box)
        else:
            rows.append([box])
    out = []
    for r in rows:
        kept = []
        for box in sorted(r, key=lambda b: (b.x, b.at)):
            if not any(k.said == box.said and abs(k.x - box.x) <= 0.6 * max(k.h, box.h) for k in kept):
                kept.append(box)
        out.append(kept)
    return out


def plain_fractions(rows):
    base, taken, made = [r[0].y for r in rows], [], 0
    for own, r in enumerate(rows):
        for rule in r:
            sign = set("".join(rule.said.split()))
            if rule in taken or len(sign) != 1 or sign <= set("-—–_.•\xb7…") or "".join(sign).isalnum() or rule.w < 2.2 * rule.h:
                continue
            parts = {True: [], False: []}
            for k, other in enumerate(rows):
                off = base[k] - rule.y
                inside = sorted((b for b in other if b.x >= rule.x - 0.4 * rule.h and b.end <= rule.end + 0.4 * rule.h), key=lambda b: b.x)
                if k != own and 0.15 * rule.h <= abs(off) <= 1.9 * rule.h and 0 < len(inside) <= 8 and abs((inside[0].x - rule.x) - (rule.end - inside[-1].end)) <= 0.45 * rule.w:
                    parts[off > 0].append((abs(off), k, inside))
            over, under = (min(parts[side], key=lambda f: f[:2])[2] if parts[side] else [] for side in (True, False))
            if over or under:
                told = [" ".join(s for b in sorted(part, key=lambda b: -b.x) if (s := b.said.strip())) for part in (over, under)]
                rule.said = f"{told[0]} / {told[1]}" if over else f"/ {told[1]}"
                taken += over + under
                made += 1
    return [left for r in rows if (left := [b for b in r if b not in taken])], made


def plain_lines(page):
    made = [Box(*b) for b in sorted(page, key=lambda b: b[-1])]
    gone = plain_repeats([b.said for b in made], 6)
    rows, n = plain_fractions(plain_rows([b for i, b in enumerate(made) if i not in gone]))
    out = []
    for r in sorted(rows, key=lambda r: -r[0].y):
        limit = max(1.6 * (float(np.median([b.w for b in r])) or 10), 2.4 * (float(np.median([b.h for b in r])) or 10), 26.0)
        parts = [[r[0]]]
        for before, box in zip(r, r[1:], strict=False):
            parts = [*parts, [box]] if box.x - before.end > limit else [*parts[:-1], [*parts[-1], box]]
        letters = lambda p: sum(len(b.said) for b in r if re.search(p, b.said))  # noqa: E731, B023
        back = -1 if letters("[\u0600-\u06ff]") > letters("[A-Za-zÀ-ɏ]") else 1
        said = [s for part in parts[::back] if (s := " ".join(" ".join(b.said for b in part[::back]).split()))]
        out += [("  ".join(said), len(said))] if said else []
    return [(text, parts, n) for text, parts in out]


def random_page(pick):
    kind, out = pick.randrange(5), []
    for i in range(pick.choice([0, 1, 2, 8, 30, 90])):
        y = (pick.randrange(12) * 12.0, pick.randrange(40) * 3.0, pick.uniform(0, 120), pick.randrange(60) * 2.0, pick.choice([50.0, 58.0, 42.0, 51.0]))[kind]
        x, w, h = pick.choice([pick.uniform(0, 400), pick.randrange(20) * 20.0]), pick.choice([10.0, 20.0, 40.0, 60.0, 60.0, 0.0, -5.0]), 10.0 if kind < 2 else pick.choice([4.0, 10.0, 10.0, 30.0, 0.0])
        out.append((pick.choice(["a", "word", "====", "****", "--", "سلام", "دنيا", "x y", "pad ", "n\xa0bsp", "7", "+", "tab\tx", f"w{pick.randrange(30)}", f"w{pick.randrange(30)}"]), x, y, w, h, i))
    return out + [(s, x + 300, y - 300, w, h, at + 1000) for s, x, y, w, h, at in out[:20]] * (kind == 0)


def test_lines_equal_the_loop(spark, monkeypatch):
    pick = random.Random(12)
    pages = [random_page(pick) for _ in range(300)]
    rows = [(p, *b) for p, page in enumerate(pages) for b in page]
    pick.shuffle(rows)
    want = {p: told for p, page in enumerate(pages) if (told := plain_lines(page))}
    assert sum(t[0][2] for t in want.values()) > 50
    df = spark.createDataFrame(rows, BOXES)
    for most in (1 << 18, 500):
        monkeypatch.setattr(layout, "ITEMS", most)
        got = {}
        for r in sorted(boxes.lines(df).collect(), key=lambda r: (r["page"], r["line"])):
            got.setdefault(r["page"], []).append((r["text"], r["segments"], r["fractions"]))
            assert r["line"] == len(got[r["page"]])
        assert got == want


def plain_repeats(words, size):
    """Word by word: a run that occurred earlier is dropped as far as both places agree."""
    seen, gone, i = {}, set(), 0
    while i + size <= len(words):
        gram = tuple(words[i : i + size])
        if gram not in seen:
            seen[gram] = i
            i += 1
            continue
        first, n = seen[gram], 0
        while i + n < len(words) and words[first + n] == words[i + n]:
            n += 1
        gone |= set(range(i, i + n))
        i += n
    return gone


def test_repeated_blocks_with_shifts(spark):
    pick = random.Random(8)
    pages = [[pick.choice("abcd") for _ in range(pick.randint(0, 60))] for _ in range(80)]
    for p in pages[:40]:  # copies with a word before, between or behind
        p += [pick.choice("xyz")] * pick.randint(0, 2) + p[pick.randint(0, 3) :] + ["q"] + p[:20]
    rows = [(i, at, w) for i, p in enumerate(pages) for at, w in enumerate(p)] + [(99, 0, None), (99, 1, "a")]
    got = {(r["page"], r["at"]) for r in boxes.without_repeats(spark.createDataFrame(rows, "page int, at int, word string"), 3).collect()}
    assert got == {(i, at) for i, p in enumerate(pages) for at in range(len(p)) if at not in plain_repeats(p, 3)} | {(99, 0), (99, 1)}


def test_overlaps_equal_all_pairs(spark):
    pick = random.Random(6)
    rows = [(pick.randint(0, 2), "s", pick.uniform(-200, 300), pick.uniform(-100, 200), pick.choice([0.0, 5.0, 60.0, 200.0]), pick.choice([8.0, 40.0, 150.0]), i) for i in range(220)]
    got = sorted((r["page"], r["first"], r["second"], round(r["share"], 9)) for r in boxes.overlapping(spark.createDataFrame(rows, BOXES), 0.3).collect())
    want = []
    for p, _, x, y, w, h, i in rows:
        for q, _, a, b, c, d, j in rows:
            wide, high = min(x + w, a + c) - max(x, a), min(y + h, b + d) - max(y, b)
            if p == q and i < j and w * c > 0 and wide > 0 and high > 0 and wide * high / min(w * h, c * d) >= 0.3:
                want.append((p, i, j, round(wide * high / min(w * h, c * d), 9)))
    assert len(want) > 100 and got == sorted(want)


def test_chained_titles_equal_the_loop(spark):
    pick = random.Random(9)
    rows = []
    for book in ("a", "b", None):
        page = 0
        for _ in range(150):
            page += pick.randint(1, 2)
            rows.append((book, page, sorted(((pick.choice(["One", "O ne", "Two", "Three"]), pick.choice([1.0, 2.0, 4.0, 7.0])) for _ in range(pick.choice([0, 1, 1, 2, 3]))), key=lambda t: -t[1])))
    rows += [("c", n, [("Same", 5.0)]) for n in range(1, 30)] + [("d", n, [("Same", 5.0), ("Other", 3.0)]) for n in range(1, 30)] + [("e", 1, None)]
    key, want, last = (lambda t: None if t is None else "".join(t.split())), {}, {}
    for book, page, found in rows:
        if book is None:
            continue
        title = None
        if found:
            before = last.get(book)
            points = [(p - (titles.LOSS if before is not None and key(t) == before else 0), t) for t, p in found]
            title = max(points, key=lambda x: x[0])[1] if before != key(found[0][0]) else None
            if title is None:
                rest = [x for x in points if key(x[1]) != before]
                title = rest[0][1] if rest and rest[0][0] > points[0][0] else f"{found[0][0]} — page {page}"
            elif key(title) != key(found[0][0]):
                title = found[0][0]
        last[book] = key(title)
        want[(book, page)] = title
    df = spark.createDataFrame(rows, "book_id string, physical_page int, titles array<struct<title:string,points:double>>").where("book_id is not null")
    for span in (4096, 5, 1):
        assert {(r["book_id"], r["physical_page"]): r["title"] for r in titles.chained(df, span).collect()} == want
    assert tx.compact_key(F.lit("a")) is not None
