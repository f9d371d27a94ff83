"""Benchmark decontamination by greedy string tiling.

The benchmark's distinct texts are dealt to blocks of bounded size, one block unless it has over 16 million characters, and
every block meets all documents in one pass: its seeds (hashes of ``seed`` consecutive words) are joined with the documents'
rolling Karp-Rabin hashes inside the scan, so nothing of a document is shuffled. Every document and item that share as many
seeds as the wanted coverage needs are tiled: the longest common runs of words that do not overlap earlier tiles are marked
again and again until none of ``seed`` words is left. Tiles may lie in any order, so a passage whose sentences were moved is
still covered.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._scratch import stored
from quire.llm._text import PUNCTUATION, power, shingle_hashes, slices, word_hashes

#: Signs beyond ASCII that divide words: Latin-1 marks, general and CJK punctuation.
MARKS = "[\\x{00A0}-\\x{00A9}\\x{00AB}-\\x{00B1}\\x{00B4}-\\x{00B8}\\x{00BB}\\x{00BF}\\x{00D7}\\x{00F7}\\x{2000}-\\x{206F}\\x{3000}-\\x{303F}]+"


def hashed_words(column: pa.Array):
    """Hashes of the lower-cased words of every row and the rows' first words."""
    odd = pc.fill_null(pc.match_substring_regex(column, MARKS), False)
    if pc.any(odd).as_py():
        column = pc.if_else(odd, pc.replace_substring_regex(column, MARKS, " "), column)
    return word_hashes(column, PUNCTUATION)


class _Words:
    """A sequence of word hashes with the sums that give the Karp-Rabin hash of any run by one subtraction, and the words that no tile has marked."""

    def __init__(self, words: np.ndarray):
        self.words, self.free = words, np.ones(len(words), bool)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power("up", len(words)), out=self.sums[1:])
        self.down = power("down", len(words))

    def runs(self, n: int):
        """Hashes of all runs of n free words, and their places."""
        if len(self.words) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        used = np.concatenate([[0], np.cumsum(~self.free)])
        place = np.flatnonzero(used[n:] == used[:-n])
        return (self.sums[place + n] - self.sums[place]) * self.down[place], place

    def equal(self, at: int, other: "_Words", to: int, n: int) -> bool:
        return np.array_equal(self.words[at : at + n], other.words[to : to + n])


def tile(item: np.ndarray, doc: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of word hashes: (place in item, place in doc, length), longest first.

    Words are compared by value. Of equal lengths the tile that begins first in the item, then in the document, is taken.
    """
    one, two = _Words(item), _Words(doc)
    tiles = []
    length = _longest(one, two, min(len(item), len(doc)), seed)
    while length:
        for a, places in _matches(one, two, length):
            if not one.free[a : a + length].all():
                continue
            for b in places:
                if two.free[b : b + length].all() and one.equal(a, two, b, length):
                    tiles.append((int(a), int(b), length))
                    one.free[a : a + length] = False
                    two.free[b : b + length] = False
                    break
        length = _longest(one, two, length - 1, seed)
    return tiles


def _matches(one: _Words, two: _Words, n: int):
    """(place in item, its places in doc in order) of every run of n free words that both sides hold by their hash, in order of the item.

    The places of one hash are walked on by all its items together: a place that is taken stays so.
    """
    ha, pa_ = one.runs(n)
    hb, pb = two.runs(n)
    order = np.argsort(hb, kind="stable")
    hb, pb = hb[order], pb[order]
    begin, end = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
    walked = {}
    for i in np.flatnonzero(end > begin):
        yield pa_[i], _untaken(walked, int(begin[i]), int(end[i]), pb, two.free, n)


def _untaken(walked: dict, begin: int, end: int, places, free, n):
    at = walked.get(begin, begin)
    while at < end:
        if free[places[at] : places[at] + n].all():
            yield places[at]
        elif at == walked.get(begin, begin):
            walked[begin] = at + 1  # no longer free, and will not be again
        at += 1


def _longest(one: _Words, two: _Words, most: int, seed: int) -> int:
    """The length of the longest common run of free words, from seed to most, or 0; by halving, as a run of n words holds one of n - 1."""
    low, high, best = seed, most, 0
    while low <= high:
        n = (low + high) // 2
        ha, pa_ = one.runs(n)
        hb, pb = two.runs(n)
        both, at, to = np.intersect1d(ha, hb, return_indices=True)
        if any(one.equal(pa_[i], two, pb[j], n) for i, j in zip(at, to, strict=True)):
            best, low = n, n + 1
        else:
            high = n - 1
    return best


def _near(places: np.ndarray, reach: int, total: int):
    """Stretches of a document that can hold tiles: hits with ``reach`` words on either side, merged."""
    begin, end = np.maximum(places - reach, 0), np.minimum(places + reach, total)
    new = np.concatenate([[True], begin[1:] > np.maximum.accumulate(end)[:-1]])
    starts = np.flatnonzero(new)
    return zip(begin[starts], np.maximum.reduceat(end, starts), strict=True)


class _Block:
    """The word hashes and seeds of some benchmark texts; bounded by the characters of a block.

    Tiles that cover ``least`` of an item lie over at least ``need`` of its seeds, as a tile of n words has n - seed + 1 of them.
    So a document that holds the item meets it even without the ``need`` - 1 seeds that most items share: these are left out of
    ``seeds``, the index by which documents find items, and openings that many items have in common stay out of it.
    """

    def __init__(self, items: list, texts: list, seed: int, least: float):
        hashes, first = hashed_words(pa.array(texts, pa.string()))
        self.items = items
        self.words = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        size = np.diff(first)
        rolled, at = shingle_hashes(hashes, first, seed)
        self.whole = [rolled[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.need = np.maximum(np.ceil(np.ceil(least * size - 1e-9) / seed).astype(np.int64), 1)
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        #: Of each length under ``seed`` the texts of that many words, by their hash; they are matched whole.
        self.short: dict[int, dict[int, list]] = {}
        for i in np.flatnonzero((size > 0) & (size < seed)):
            self.short.setdefault(int(size[i]), {}).setdefault(int(rolled[at[i]]), []).append(i)
        tiled = size[owner] >= seed
        rolled, owner = rolled[tiled], owner[tiled]
        _, kind, times = np.unique(rolled, return_inverse=True, return_counts=True)
        order = np.lexsort((rolled, -times[kind], owner))
        rolled, owner = rolled[order], owner[order]
        turn = np.arange(len(owner)) - np.searchsorted(owner, owner)  # among the item's seeds, the commonest first
        rare = turn >= self.need[owner] - 1
        rolled, owner = rolled[rare], owner[rare]
        order = np.lexsort((owner, rolled))
        rolled, owner = rolled[order], owner[order]
        new = np.ones(len(rolled), bool)
        new[1:] = (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])
        self.seeds, self.owner = rolled[new], owner[new]
        self.shift = np.uint64(64 - min(26, max(16, int(16 * len(self.seeds)).bit_length())))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self.seeds >> self.shift] = True


def _candidates(rolled: np.ndarray, at: np.ndarray, block: _Block, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of every row that holds one of the item's indexed seeds, in order; about ``at_once`` hits are spread at a time."""
    place = np.flatnonzero(block.maybe[rolled >> block.shift])
    begin, end = np.searchsorted(block.seeds, rolled[place], "left"), np.searchsorted(block.seeds, rolled[place], "right")
    hit = np.flatnonzero(end > begin)
    row, begin, wide = np.searchsorted(at, place[hit], "right") - 1, begin[hit], (end - begin)[hit]
    ends = np.cumsum(wide)
    codes, i = np.zeros(0, np.int64), 0
    while i < len(hit):
        stop = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + at_once, "right")))
        w = wide[i:stop]
        spread = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        owner = block.owner[np.repeat(begin[i:stop], w) + spread]
        codes = np.union1d(codes, np.repeat(row[i:stop], w) * len(block.items) + owner)
        i = stop
    return codes // len(block.items), codes % len(block.items)


def _places(seeds: np.ndarray, order: np.ndarray, held: np.ndarray, need: int) -> np.ndarray | None:
    """Where a row, whose sorted hashes are ``held`` and lie at ``order``, has an item's seeds; None if it holds fewer than ``need``."""
    begin, end = np.searchsorted(held, seeds, "left"), np.searchsorted(held, seeds, "right")
    there = end > begin
    if np.count_nonzero(there) < need:
        return None
    ranges = np.unique(np.stack([begin[there], end[there]], 1), axis=0)  # a seed that the item repeats has one range
    return np.sort(np.concatenate([order[x:y] for x, y in ranges]))


def _whole(hashes: np.ndarray, first: np.ndarray, keys, block: _Block):
    """Every row that holds a text of fewer words than a seed has: one tile, where it stands first."""
    for n, known in block.short.items():
        rolled, at = shingle_hashes(hashes, first, n)
        place = np.flatnonzero(np.isin(rolled, np.fromiter(known, np.uint64, len(known))))
        row = np.searchsorted(at, place, "right") - 1
        _, new = np.unique(np.stack([row.astype(np.uint64), rolled[place]]), axis=1, return_index=True)
        for k in np.sort(new):
            begin = int(place[k] - at[row[k]])
            for owner in known[int(rolled[place[k]])]:
                if np.array_equal(hashes[first[row[k]] + begin : first[row[k]] + begin + n], block.words[owner]):
                    yield keys[int(row[k])].as_py(), block.items[owner], n, n, [{"item_word": 0, "doc_word": begin, "words": n}]


def _scan(batches, block: _Block, seed: int, least: float):
    for batch in batches:
        for piece in slices(batch, "text", 1 << 20):
            keys = piece.column("key")
            hashes, first = hashed_words(piece.column("text"))
            rolled, at = shingle_hashes(hashes, first, seed)
            out, last = list(_whole(hashes, first, keys, block)), -1
            for row, owner in zip(*_candidates(rolled, at, block), strict=True):
                if row != last:
                    last, text, own = row, hashes[first[row] : first[row + 1]], rolled[at[row] : at[row + 1]]
                    order = np.argsort(own)
                    held = own[order]
                places = _places(block.whole[owner], order, held, block.need[owner])
                if places is None:
                    continue
                item = block.words[owner]
                # words farther from every seed than the item is long cannot belong to a tile
                where = np.concatenate([np.arange(x, y) for x, y in _near(places, len(item) + seed, len(text))])
                gaps = np.flatnonzero(np.diff(where) != 1) + 1
                real = np.insert(where, gaps, -1)
                tiles = [(x, int(real[y]), n) for x, y, n in tile(item, np.insert(text[where], gaps, 0), seed)]
                covered = sum(n for _, _, n in tiles)
                if covered >= least * len(item):
                    tiles.sort()
                    out.append((keys[int(row)].as_py(), block.items[owner], covered, len(item), [{"item_word": x, "doc_word": y, "words": n} for x, y, n in tiles]))
            if out:
                yield [list(x) for x in zip(*out, strict=True)]


def _blocks(items: DataFrame, most: int) -> tuple[DataFrame, DataFrame, list]:
    """The rows (item, node), the distinct texts with their block, and the blocks.

    Equal texts are one node, however many items have them. Texts are dealt by hash, more finely until no block of several texts
    has over ``most`` characters.
    """
    node = F.unhex(F.md5("text"))
    held = stored(items.select("item", node.alias("node"), "text"), "benchmark")
    texts = held.groupBy("node").agg(F.first("text").alias("text")).withColumn("size", F.length("text") + 1)
    total = texts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = 1 if total <= most else -(-2 * total // most)
    while True:
        dealt = texts.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)))
        sums = dealt.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("texts"))
        if sums.where((F.col("size") > most) & (F.col("texts") > 1)).isEmpty():
            return held.select("item", "node"), dealt, sorted(r["part"] for r in sums.select("part").toLocalIterator())
        parts *= 2


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", seed: int = 5, least: float = 0.8, block_chars: int = 1 << 24) -> DataFrame:
    """(key, item, covered, words, tiles, coverage) for every document that holds ``least`` of an item's words in tiles.

    Words are what ASCII signs, blanks, controls and the ``MARKS`` leave between them, lower-cased. Items of fewer than ``seed``
    words cannot be tiled: they match as a whole, as one run of their own length. Items without a word and null and empty texts match nothing. Repeated documents and items
    give a row each. tiles lists item_word, doc_word and words of every tile. The benchmark may have any size: each block of at
    most ``block_chars`` characters of distinct texts (one text at least) is sent to the tasks, where it takes about 10 bytes a
    character, and costs one pass over ``docs``. Where there are several, each pass's rows are stored and its block is released before the next.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null")
    named, bounded, parts = _blocks(items, block_chars)
    kind = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("node", T.BinaryType()), T.StructField("covered", T.LongType()), T.StructField("words", T.LongType()),
        T.StructField("tiles", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("item_word", "doc_word", "words")]))),
    ])
    found = spark.createDataFrame([], kind)
    for part in parts:
        held = bounded.where(F.col("part") == part).select("node", "text").orderBy("node").collect()  # block_chars characters, or one text
        sent = spark.sparkContext.broadcast(_Block([bytes(r["node"]) for r in held], [r["text"] for r in held], seed, least))

        def run(batches, sent=sent):
            from pyspark.sql.pandas.types import to_arrow_schema

            schema = to_arrow_schema(kind)
            for out in _scan(batches, sent.value, seed, least):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

        met = rows.mapInArrow(run, kind)
        if len(parts) > 1:
            met = stored(met, "met")
            sent.destroy()
        found = found.union(met)
    # a text that many items share, found in many documents, is a product of both: each pair is a row of the result
    out = found.join(named.withColumnRenamed("item", item), "node").withColumn("coverage", F.col("covered") / F.col("words"))
    return out.select(key, item, "covered", "words", "tiles", "coverage")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept; a null key is matched like any other.

    A contaminated row goes with all rows of its key.
    """
    bad = stored(contamination(docs, benchmark, key, **options).select(F.col(key).alias("_bad")).distinct(), "contaminated")
    return docs.join(bad, docs[key].eqNullSafe(bad["_bad"]), "left_anti")
