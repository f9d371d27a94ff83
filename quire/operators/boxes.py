"""Lines of a page from its boxes, where the order of steps matters: rows, fractions, segments, and what was painted twice.

boxes: page, str, x, y, w, h and at (the box's place in its page); y grows upwards. Boxes move packed by page, and a kernel works on
many whole pages at once; what needs no order (overlapping boxes, ghost lines) is joins and grouping.
"""

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.layout import _by_page

# fixed values: how far a box may lie from a row's baseline, in its height and at least
ROW_REACH, ROW_LEAST = 0.34, 0.9
# fixed values of fractions, in heights of the rule: its least width, from where to where a part may lie off it, how far it may
# stick out; how many boxes a part may have; how much of the rule's width it may be off its middle
RULE_WIDTH, PART_NEAR, PART_FAR, PART_OUT, PART_BOXES, PART_OFF = 2.2, 0.15, 1.9, 0.4, 8, 0.45
# fixed values of a gap that divides segments: median widths, median heights, and at least
GAP_WIDTHS, GAP_HEIGHTS, GAP_LEAST = 1.6, 2.4, 26.0
# fixed values: twins in a row lie so many heights apart at most; a block is repeated from so many boxes on; a ghost line has so many signs
TWIN_REACH, BLOCK, GHOST = 0.6, 6, 6

_ARABIC, _LATIN = "[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]", "[A-Za-zÀ-ɏ]"
_BLANKS = frozenset("-—–_.•\xb7…")


def _repeated(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes)
    gone, seen, i = np.zeros(n, bool), {}, 0
    while i + size <= n:
        first = seen.setdefault(codes[i : i + size].tobytes(), i)
        if first == i:
            i += 1
            continue
        differ = np.flatnonzero(codes[i:] != codes[first : first + n - i])
        length = int(differ[0]) if len(differ) else n - i
        gone[i : i + length] = True
        i += length
    return gone


def repeats(words: list, size: int = BLOCK) -> np.ndarray:
    """Which words lie in a run of ``size`` or more that an earlier place has: from each place, the run along one diagonal, as far as it goes."""
    return _repeated(np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int), size)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _order(*keys: np.ndarray) -> np.ndarray | slice:
    """The order by ``keys``, the first one leading; boxes mostly come in it already."""
    tied, right = np.ones(max(len(keys[0]) - 1, 0), bool), True
    for k in keys:
        right = right and not (tied & (k[1:] < k[:-1])).any()
        tied &= k[1:] == k[:-1]
    return slice(None) if right else np.lexsort(keys[::-1])


def _per_page_repeated(page: np.ndarray, codes: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """``repeats`` of each page; only pages where the hash of a run occurs twice are walked through."""
    gone, n = np.zeros(len(codes), bool), max(len(codes) - size + 1, 0)
    hashes = page[:n].astype(np.uint64)
    for k in range(size):
        hashes = (hashes ^ codes[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    whole = page[:n] == page[size - 1 :][:n]
    order = np.argsort(hashes[whole], kind="stable")
    twice = np.flatnonzero(np.diff(hashes[whole][order]) == 0)
    starts = _runs(page)
    for p in np.unique(page[:n][whole][order][twice]):
        k = np.searchsorted(page[starts], p)
        span = slice(starts[k], starts[k + 1] if k + 1 < len(starts) else len(page))
        gone[span] = _repeated(codes[span], size)
    return gone


def _row_reach(height):
    return np.maximum(ROW_LEAST, ROW_REACH * height)


def _joined(y: list, h: list, tallest: list) -> list[int]:
    """Boxes from the top down: the place of the first box of each one's row."""
    first, base, height, out, low = [], [], [], [], 0
    for i, (at, own, tall) in enumerate(zip(y, h, tallest, strict=True)):
        while low < len(base) and base[low] - at > max(ROW_LEAST, ROW_REACH * tall):
            low += 1
        for k in range(low, len(base)):
            if abs(base[k] - at) <= max(ROW_LEAST, ROW_REACH * max(height[k], own)):
                height[k] = max(height[k], own)
                break
        else:
            k = len(base)
            first.append(i)
            base.append(at)
            height.append(own)
        out.append(first[k])
    return out


def _rows_of(page: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Rows of boxes that come by page and from the top down: a box joins the first row whose baseline (its first box's) is near enough.

    What is farther apart than the page's tallest box reaches never joins; what lies within the lowest one's reach is one row. Only the rest
    is joined box by box. A row's number is the place of its first box.
    """
    starts = _runs(page)
    sizes = np.diff(np.append(starts, len(page)))
    most, least = (np.repeat(_row_reach(f.reduceat(h, starts)), sizes) for f in (np.maximum, np.minimum))
    new = np.append(True, (page[1:] != page[:-1]) | (y[:-1] - y[1:] > most[1:]))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(page))
    row = np.repeat(begin, end - begin)
    held, tallest = -1, None
    for i in np.flatnonzero(~(y[begin] - y[end - 1] <= least[begin])).tolist():
        a, b = int(begin[i]), int(end[i])
        k = int(np.searchsorted(starts, a, "right")) - 1
        if k != held:
            held, tallest = k, np.maximum.accumulate(h[starts[k] : starts[k] + sizes[k]])
        own = tallest[a - starts[k] : b - starts[k]]
        row[a:b] = a + np.array(_joined(y[a:b].tolist(), h[a:b].tolist(), own.tolist()))
    return row


def _twins(page: np.ndarray, row: np.ndarray, code: np.ndarray, x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which boxes, in order of their row from the left, say the same as one kept before, about where it lies."""
    order = np.lexsort((code, row))
    starts = _runs(row[order], code[order])
    sizes = np.diff(np.append(starts, len(order)))
    tallest = np.repeat(np.maximum.reduceat(h[order], starts), sizes)
    near = np.append(False, (x[order][1:] - x[order][:-1] <= TWIN_REACH * tallest[1:]))
    near[starts] = False
    gone = np.zeros(len(order), bool)
    for s in np.flatnonzero(np.add.reduceat(near, starts, dtype=int)).tolist():
        same = order[starts[s] : starts[s] + sizes[s]]
        reach, kept = TWIN_REACH * float(tallest[starts[s]]), []
        for i, at, own in zip(same.tolist(), x[same].tolist(), h[same].tolist(), strict=True):
            for left, high in reversed(kept):
                if at - left > reach:
                    kept.append((at, own))
                    break
                if abs(left - at) <= TWIN_REACH * max(high, own):
                    gone[i] = True
                    break
            else:
                kept.append((at, own))
    return gone


def _one_sign(said: str) -> bool:
    signs = set("".join(said.split()))
    return len(signs) == 1 and not (signs <= _BLANKS or signs.copy().pop().isalnum())


def _rules(values: pa.Array, code: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the boxes that are rules of fractions: wide, and of one sign."""
    may = np.flatnonzero(~pc.match_substring_regex(values, "[0-9A-Za-z]").to_numpy(zero_copy_only=False)[code] & (w >= RULE_WIDTH * h))
    each, back = np.unique(code[may], return_inverse=True)
    return may[np.array([_one_sign(s) for s in values.take(pa.array(each)).to_pylist()], bool)[back]] if len(may) else may


def _fractions(page: np.ndarray, row: np.ndarray, rules: np.ndarray, values: pa.Array, code: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict]:
    """Each rule takes the nearest part above and below it. Which boxes go, and what the rules that took parts say."""
    starts = _runs(row)
    ends, base = np.append(starts[1:], len(row)), y[starts]
    order = np.lexsort((base, page[starts]))
    pages = _runs(page[starts])
    begins = np.searchsorted(page[starts][pages], page[rules])
    upto = np.append(pages[1:], len(starts))
    low, high = pages[begins].tolist(), upto[begins].tolist()
    owns = (np.searchsorted(starts, rules, "right") - 1).tolist()
    heights, order, starts, ends = base[order].tolist(), order.tolist(), starts.tolist(), ends.tolist()
    base, xs, rights, ys, hs, ws = base.tolist(), x.tolist(), (x + w).tolist(), y.tolist(), h.tolist(), w.tolist()
    taken, made, wide = np.zeros(len(row), bool), {}, bool((w >= 0).all())
    said = lambda i: made[i] if i in made else values[code[i]].as_py()
    for rule, own, a, b in zip(rules.tolist(), owns, low, high, strict=True):
        if taken[rule]:
            continue
        left, right, at, tall, parts = xs[rule], rights[rule], ys[rule], hs[rule], {}
        reach = abs(2 * PART_FAR * tall)
        for k in sorted(order[bisect_left(heights, at - reach, a, b) : bisect_right(heights, at + reach, a, b)]):
            off = base[k] - at
            if k == own or not PART_NEAR * tall <= abs(off) <= PART_FAR * tall:
                continue
            inside = []
            for i in range(bisect_left(xs, left - PART_OUT * tall, starts[k], ends[k]), ends[k]):
                if rights[i] <= right + PART_OUT * tall:
                    inside.append(i)
                if len(inside) > PART_BOXES or wide and xs[i] > right + PART_OUT * tall:
                    break
            if 0 < len(inside) <= PART_BOXES and abs((xs[inside[0]] - left) - (right - rights[inside[-1]])) <= PART_OFF * ws[rule] and abs(off) < parts.get(off > 0, (np.inf,))[0]:
                parts[off > 0] = (abs(off), inside)
        if parts:
            over, under = (parts.get(side, (0, []))[1] for side in (True, False))
            side = lambda part: " ".join(s for i in sorted(part, key=lambda i: -xs[i]) if (s := said(i).strip()))
            made[rule] = f"{side(over)} / {side(under)}" if over else f"/ {side(under)}"
            taken[over + under] = True
    return taken, made


def _medians(values: np.ndarray, row: np.ndarray, starts: np.ndarray) -> np.ndarray:
    held, n = values[np.lexsort((values, row))], np.diff(np.append(starts, len(row)))
    found = (held[starts + (n - 1) // 2] + held[starts + n // 2]) / 2
    return np.where(found == 0, 10, found)


def _told(row: np.ndarray, values: pa.Array, code: np.ndarray, x: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[list, list]:
    """Each row's text and how many segments it has; boxes come by row, from the left.

    A row is cut where a gap is wider than words and letters explain, and read from the right if it has more Arabic than Latin letters.
    """
    starts = _runs(row)
    ends = np.append(starts[1:], len(row))
    length = pc.utf8_length(values).to_numpy()
    arabic, latin = (np.add.reduceat(np.where(pc.match_substring_regex(values, p).to_numpy(zero_copy_only=False), length, 0)[code], starts) for p in (_ARABIC, _LATIN))
    limit = np.maximum(np.maximum(GAP_WIDTHS * _medians(w, row, starts), GAP_HEIGHTS * _medians(h, row, starts)), GAP_LEAST)
    cut = np.append(True, x[1:] - (x + w)[:-1] > np.repeat(limit, ends - starts)[1:])
    cut[starts] = True
    at = np.arange(len(row))
    at = np.where(np.repeat(arabic > latin, ends - starts), np.repeat(starts + ends - 1, ends - starts) - at, at)
    begin = _runs(np.cumsum(cut)[at])
    parts = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)), pa.int32()), values.take(pa.array(code[at])))
    said = [" ".join(s.split()) for s in pc.binary_join(parts, " ").to_pylist()]
    upto = np.searchsorted(begin, np.append(starts, len(row))).tolist()
    kept = [[s for s in said[a:b] if s] for a, b in zip(upto, upto[1:], strict=False)]
    return ["  ".join(k) for k in kept], [len(k) for k in kept]


def _lines(table: pa.Table) -> pa.Table:
    """(p, line, text, segments, fractions) of many pages' boxes."""
    held = table.column("str").combine_chunks().dictionary_encode()
    values = held.dictionary
    b = {c: table.column(c).to_numpy() for c in ("p", "x", "y", "w", "h", "at")} | {"code": held.indices.to_numpy().astype(np.int64)}
    sub = lambda which: {k: v[which] for k, v in b.items()}
    b = sub(_order(b["p"], b["at"]))
    b = sub(~_per_page_repeated(b["p"], b["code"]))
    b = sub(_order(b["p"], -b["y"], b["x"], b["at"]))
    made = np.zeros(0, np.int64)
    if len(b["p"]):
        b["row"] = _rows_of(b["p"], b["y"], b["h"])
        b = sub(_order(b["row"], b["x"], b["at"]))
        b = sub(~_twins(b["p"], b["row"], b["code"], b["x"], b["h"]))
        rules = _rules(values, b["code"], b["w"], b["h"])
        if len(rules):
            taken, merged = _fractions(b["p"], b["row"], rules, values, *(b[c] for c in ("code", "x", "y", "w", "h")))
            at = np.array(list(merged), np.int64)
            made, b["code"][at] = b["p"][at], len(values) + np.arange(len(at))
            values = pa.concat_arrays([values, pa.array(merged.values(), values.type)])
            b = sub(~taken)
    if not len(b["p"]):
        return pa.table({"p": pa.array([], pa.int64()), "line": pa.array([], pa.int32()), "text": pa.array([], pa.string()), "segments": pa.array([], pa.int32()), "fractions": pa.array([], pa.int32())})
    text, parts = _told(b["row"], values, *(b[c] for c in ("code", "x", "w", "h")))
    starts = _runs(b["row"])
    page, top = b["p"][starts], b["y"][starts]
    order = np.lexsort((-top, page))
    order = order[np.array([t != "" for t in text], bool)[order]]
    page = page[order]
    line = np.arange(len(page)) - np.searchsorted(page, page) + 1
    count = np.bincount(made, minlength=int(page.max(initial=0)) + 1)[page]
    text, segments = pa.array(text, pa.string()).take(pa.array(order)), pa.array(np.array(parts)[order], pa.int32())
    return pa.table({"p": pa.array(page, pa.int64()), "line": pa.array(line, pa.int32()), "text": text, "segments": segments, "fractions": pa.array(count, pa.int32())})


def lines(boxes: DataFrame) -> DataFrame:
    """(page, line, text, segments, fractions) from the top down: repeated blocks and twins go, rows are formed, fractions merged, segments divided.

    Boxes that say nothing, or have a null place or size, have no part. fractions: how many the page has.
    """
    real = boxes.where(F.trim("str") != "").select("page", "str", *(F.col(c).cast("double") for c in ("x", "y", "w", "h")), F.col("at").cast("long")).dropna()
    return _by_page(real, _lines, "line int, text string, segments int, fractions int")


def without_ghosts(page_lines: DataFrame, least: int = GHOST) -> DataFrame:
    """Lines less those that an earlier line of the page says too, white space and vowel marks apart; lines of fewer than ``least`` signs stay."""
    key = tx.compact_key(F.col("text"))
    first = page_lines.withColumn("_key", F.when(F.length(key) >= least, F.sha2(key, 256)).otherwise(F.concat_ws(" ", F.lit("line"), "line")))
    return first.groupBy("page", "_key").agg(F.min_by(F.struct(*page_lines.columns), "line").alias("f")).select("f.*")


def without_repeats(words: DataFrame, size: int = BLOCK) -> DataFrame:
    """Words (page, at, word) less those of runs that an earlier place of the page has (``repeats``)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        return table.filter(pa.array(~repeats(table.column("word").to_pylist(), size)))

    held = words.select("page", F.col("at").cast("long"), F.coalesce("word", F.lit("")).alias("word"))
    return held.groupBy("page").applyInArrow(run, held.schema)


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


# fixed value: pairs that are looked at in one go
_PAIRS = 1 << 20


def _met(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray):
    """Pairs of boxes whose extents meet along the axis on which fewer do, a bounded number at a time: places of both."""
    found = []
    for low, high in ((y, y + h), (x, x + w)):
        order = np.argsort(low, kind="stable")
        count = np.searchsorted(low[order], high[order], "left") - np.arange(len(order)) - 1  # those that begin later and before its end
        found.append((int(np.maximum(count, 0).sum()), order, np.maximum(count, 0)))
    _, order, count = min(found, key=lambda f: f[0])
    upto, start = np.cumsum(count), 0
    while start < len(count):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _PAIRS, "right")))
        n = count[start:end]
        first = np.repeat(np.arange(start, end), n)
        second = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first + 1
        yield order[first], order[second]
        start = end


def _packed(boxes: DataFrame) -> DataFrame:
    """(page, i, j, b): boxes of one batch and cell as one compressed value, columns after each other; they are regular, and little moves."""

    keys = ("page", "i", "j")

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for column in (table.column(c).combine_chunks() for c in keys):
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            starts = begins(table)
            if len(starts) * 16 > len(table):  # boxes that don't come cell by cell
                table = table.sort_by([(c, "ascending") for c in keys])
                starts = begins(table)
            values = [table.column(c).to_numpy() for c in ("at", "x", "y", "w", "h")]
            ends = np.append(starts[1:], len(table))
            b = [pa.compress(b"".join(v[s:e].tobytes() for v in values), "zstd", asbytes=True) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            kept = table.select(keys).take(pa.array(starts))
            yield from kept.append_column("n", pa.array(ends - starts, pa.int32())).append_column("b", pa.array(b, pa.binary())).combine_chunks().to_batches()

    return boxes.mapInArrow(run, f"page {dict(boxes.dtypes)['page']}, i long, j long, n int, b binary")


def overlapping(boxes: DataFrame, share: float = 0.5, cell: float = 4096.0) -> DataFrame:
    """(page, first, second, share): pairs of boxes of one page whose rectangles overlap by ``share`` of the smaller one, by their places.

    Boxes meet in the cells of a coarse grid that they touch, which are packed before they move and swept there; of the cells that
    a pair shares, the one where the overlap begins tells of it, so no pair is told twice. Boxes without extent overlap nothing.
    """
    kinds = dict(boxes.dtypes)
    held = boxes.where("w > 0 and h > 0").select("page", F.col("at").cast("long"), *(F.col(c).cast("double") for c in ("x", "y", "w", "h"))).dropna()
    dealt = held.withColumn("i", F.explode(_cells(F.col("x"), F.col("x") + F.col("w"), cell))).withColumn("j", F.explode(_cells(F.col("y"), F.col("y") + F.col("h"), cell)))
    sizes = np.cumsum([0, *(np.dtype(t).itemsize for t in ("i8", "f8", "f8", "f8", "f8"))])

    def run(table: pa.Table) -> pa.Table:
        parts = [[], [], [], [], []]
        for n, b in zip(table.column("n").to_pylist(), table.column("b").to_pylist(), strict=True):
            data = pa.decompress(b, n * int(sizes[-1]), "zstd", asbytes=True)
            for k, part in enumerate(parts):
                part.append(np.frombuffer(data, np.int64 if k == 0 else np.float64, n, n * int(sizes[k])))
        at, x, y, w, h = (np.concatenate(p) for p in parts)
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        r, t, area, out = x + w, y + h, w * h, []
        for a, b in _met(x, y, w, h):
            left, low = np.maximum(x[a], x[b]), np.maximum(y[a], y[b])
            wide, high = np.minimum(r[a], r[b]) - left, np.minimum(t[a], t[b]) - low
            part = wide * high / np.minimum(area[a], area[b])
            good = (at[a] != at[b]) & (wide > 0) & (high > 0) & (np.floor(left / cell) == i) & (np.floor(low / cell) == j) & (part >= share)
            one, two = at[a[good]], at[b[good]]
            out.append((np.minimum(one, two), np.maximum(one, two), part[good]))
        first, second, part = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        page = pa.repeat(table.column("page")[0], len(first))
        return pa.table({"page": page, "first": first, "second": second, "share": part})

    pairs = _packed(dealt.select("page", "i", "j", "at", "x", "y", "w", "h")).groupBy("page", "i", "j").applyInArrow(run, f"page {kinds['page']}, first long, second long, share double")
    return pairs.select("page", *(F.col(c).cast(kinds["at"]) for c in ("first", "second")), "share")
