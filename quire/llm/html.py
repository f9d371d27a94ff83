"""HTML extraction by differencing each page with the pages nearest to it by URL path on its host.

A page is cut into text lines, one per block of markup. The pages of a host lie in order of their paths, so the nearest ones by
path are a page's neighbours. Its lines and a neighbour's are aligned by a longest common subsequence; lines that they share
are the site's, not the article's, and are deleted. Pages of equal lines on one host are one page here, as copies would delete
each other.

Differencing alone deletes an article's line that a neighbour's article repeats, and keeps a menu or an advert that the
neighbours happen not to show. So markup has a say: the lines of an ``article`` or main element are kept even if they are
shared, what is marked as menu, header, footer, sidebar, notice, advert, form or comments goes even if it isn't, and where a
page marks its article all else goes. Of what no markup tells apart differencing decides alone.
"""

import re
from collections import deque
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._scratch import stored
from quire.llm._text import slices
from quire.llm.urls import host_of, path_of

PLAIN, MAIN, NAMED, MARKED = 0, 1, 2, 3  # of a line: unmarked; in the article; in an element, or under a class, that is no article

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)(?:>|\Z)""", re.S)
_SKIPPED = frozenset("script style title template noscript textarea svg math iframe object audio video canvas head".split())
_CLOSED = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in _SKIPPED}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_HELD = frozenset("article aside blockquote button details dialog div dl fieldset figure footer form header main menu nav ol search section select table ul".split())
_NO_ARTICLE = frozenset("aside button dialog fieldset footer form menu nav search select".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_ABOUT = frozenset("has have is no not with without".split())
_MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
_OTHER_WORDS = frozenset(
    "ad ads advert advertisement advertising advertorial adverts alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disqus footer form gdpr header "
    "login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion recommended related replies search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)


@lru_cache(maxsize=8192)
def _zone(tag: str, attributes: str, outer: int) -> int:
    """The zone inside an element, given the one around it."""
    if outer >= NAMED or tag in ("body", "html"):
        return outer
    if tag in _NO_ARTICLE or (tag == "header" and outer != MAIN):
        return NAMED
    main = tag in ("article", "main")
    for _, *values in _ATTRIBUTE.findall(attributes):
        for name in "".join(values).split():
            said = [w.lower() for w in _WORD.findall(name)]
            if not said or said[0] in _ABOUT:
                continue
            if any(w in _OTHER_WORDS for w in said) and not (outer == MAIN and said[-1] == "header"):
                return MARKED
            main |= said[-1] in _MAIN_WORDS or said[0] in _MAIN_WORDS
    return MAIN if main else outer


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """The text lines of a page in order, and their zones.

    A line is the text of one block: references decoded, white space turned into single spaces. ``br`` is white space. Scripts, styles,
    comments of the markup and the head hold no text. End tags that close nothing are passed over, unclosed elements end with the one around them.
    """
    texts, zones = [], []
    held: list[tuple[str, int]] = []
    zone, block, own, aside = PLAIN, [], PLAIN, []

    def flush():
        for parts, z in ((block, own), *(([a], z) for a, z in aside)):
            line = " ".join(unescape("".join(parts)).split())
            if line:
                texts.append(line)
                zones.append(z)
        block.clear()
        aside.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            chunk = page[at:end]
            if not block and not aside:
                own = zone
            if zone == own:
                block.append(chunk)
            elif zone >= NAMED:
                aside.append((chunk, zone))
            else:
                flush()
                own = zone
                block.append(chunk)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in _SKIPPED:
            if not m[1]:
                stop = _CLOSED[tag].search(page, at)
                if tag != "head" or stop:
                    at = stop.end() if stop else size
            continue
        if tag == "br":
            if block:
                block.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            continue
        if m[1]:
            for i in range(len(held) - 1, -1, -1):
                if held[i][0] == tag:
                    del held[i:]
                    break
        else:
            while held and held[-1][0] in ("p", "li", "td", "tr") and tag in _BLOCK:  # of these only marked ones are held
                held.pop()
            zone = held[-1][1] if held else PLAIN
            inner = _zone(tag, m[3], zone)
            if tag in _HELD or inner != zone:
                held.append((tag, inner))
        zone = held[-1][1] if held else PLAIN
    flush()
    return texts, zones


def _bits(a: list, b: list):
    """Row by row of ``a`` the bit-parallel LCS vector over ``b``: a zero where the length grows."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    v = full = (1 << len(b)) - 1
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(row: int, width: int) -> np.ndarray:
    """LCS lengths with the first 0, 1, ... ``width`` elements, from a vector of ``_bits``."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(width // 8 + 1, "little"), np.uint8), bitorder="little")[:width]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common(a: list, b: list, most: int = 1 << 27) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; ``most``: bits that are held at a time."""
    there = set(b)
    place = [i for i, x in enumerate(a) if x in there]
    mine, here = [a[i] for i in place], set(a)
    other = [x for x in b if x in here]
    head = 0
    while head < min(len(mine), len(other)) and mine[head] == other[head]:
        head += 1
    out, mine, other, place = place[:head], mine[head:], other[head:], place[head:]
    if not mine or not other:
        return out
    if len(mine) * len(other) > most and len(mine) > 1:
        middle = len(mine) // 2
        left = _lengths(deque(_bits(mine[:middle], other), 1)[0], len(other))
        right = _lengths(deque(_bits(mine[middle:][::-1], other[::-1]), 1)[0], len(other))[::-1]
        cut = int(np.argmax(left + right))
        parts = common(mine[:middle], other[:cut], most), [middle + i for i in common(mine[middle:], other[cut:], most)]
        return out + [place[i] for part in parts for i in part]
    rows = list(_bits(mine, other))
    i, j, found = len(mine), len(other), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                found.append(place[i])
    return out + found[::-1]


def kept(zones: np.ndarray, shared: np.ndarray, markup: bool = True) -> np.ndarray:
    """Which lines are the article's."""
    if not markup:
        return ~shared
    if (zones == MAIN).any():
        return zones == MAIN
    open_ = (zones == PLAIN) & ~shared
    return open_ if open_.any() or not (zones == MARKED).any() else (zones == MARKED) & ~shared  # a class on everything tells nothing


def _hash(lines: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines]


def _line_lists(rows: DataFrame) -> DataFrame:
    """(id, host, path, lines, page) per row: hashes of its lines in order and of the whole list."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "html"):
                lists = [_hash(lines_of(x)[0]) if x else [] for x in piece.column("html").to_pylist()]
                page = [_hash([str(x)])[0] for x in lists]
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(lists, pa.list_(pa.int64())), pa.array(page, pa.int64())], ["id", "host", "path", "lines", "page"])

    return rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html").mapInArrow(run, "id long, host string, path string, lines array<long>, page long")


def neighbours(pages: DataFrame) -> DataFrame:
    """``pages`` with ``before`` and ``after``: the lines of the nearest pages of the host in order of path, null at its ends. pages: host, path, page, lines.

    The rows are range-partitioned, so a large host is spread; a partition's first and last rows meet its neighbours' by the partitions' order.
    """
    place = [F.col(c) for c in ("host", "path", "page")]
    ranged = stored(pages.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("part").orderBy("host", "path", "page")
    held = F.struct("host", "lines")
    ranked = ranged.withColumns({"_before": F.lag(held).over(inside), "_after": F.lead(held).over(inside)})
    ends = ranged.groupBy("part").agg(F.min_by(held, F.struct(*place)).alias("first"), F.max_by(held, F.struct(*place)).alias("last"))  # two rows of each partition
    order = Window.orderBy("part")
    ends = ends.select(F.col("part").alias("_part"), F.lag("last").over(order).alias("_last"), F.lead("first").over(order).alias("_first"))
    both = ranked.join(ends, F.col("part") == F.col("_part"))
    own = lambda c: F.when(c["host"] == F.col("host"), c["lines"])
    return both.select(*pages.columns, own(F.coalesce("_before", "_last")).alias("before"), own(F.coalesce("_after", "_first")).alias("after"))


def shared_lines(rows: DataFrame) -> DataFrame:
    """(id, shared): the places of the lines that a row of (id, url, html) shares with a neighbour; ids without such lines are left out."""
    lists = stored(_line_lists(rows), "lines")
    pages = lists.groupBy("host", "page").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))

    def run(batches):
        for batch in batches:
            out = []
            for mine, *others in zip(*(batch.column(c).to_pylist() for c in ("lines", "before", "after")), strict=True):
                out.append(sorted({i for other in others if other for i in common(mine, other)}))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(out, pa.list_(pa.int32()))], ["host", "page", "shared"])

    met = neighbours(pages).select("host", "page", "lines", "before", "after").mapInArrow(run, "host string, page long, shared array<int>").where(F.size("shared") > 0)
    return lists.select("id", "host", "page").distinct().join(met, ["host", "page"]).select("id", "shared")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", markup: bool = True) -> DataFrame:
    """(key, url, text, n_chars, n_lines, n_shared) per row of ``pages``: the article's lines, joined by line feeds.

    n_lines: lines of the whole page; n_shared: those that a neighbour shares. A null html is an empty one, and a page without
    article lines has the empty text. URLs that are null or without host lie on the empty host. Repeated rows and keys keep a row
    each, a null key stays null, other columns aren't read. markup=False: by differencing alone.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("id", F.xxhash64("url", "html"))
    shared = shared_lines(rows).withColumnRenamed("id", "_id")
    both = rows.join(shared, F.col("id") == F.col("_id"), "left").select("key", "url", "html", "shared")

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "html"):
                out = []
                for page, places in zip(piece.column("html").to_pylist(), piece.column("shared").to_pylist(), strict=True):
                    texts, zones = lines_of(page)
                    mask = np.zeros(len(texts), bool)
                    mask[places or []] = True
                    text = "\n".join([texts[i] for i in np.flatnonzero(kept(np.array(zones, int), mask, markup))])
                    out.append((text, len(text), len(texts), int(mask.sum())))
                text, *counts = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array(text, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], [key, url, "text", "n_chars", "n_lines", "n_shared"])

    return both.mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, `{url}` string, text string, n_chars long, n_lines long, n_shared long")
