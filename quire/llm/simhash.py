"""Near-duplicate detection by SimHash fingerprints and a binary-trie self-join.

Fingerprints that agree on some blocks of bits meet in one unit of work. Inside a unit the sorted fingerprints form an
implicit binary trie (a node is a range of rows). The join walks pairs of nodes together, from the top bit down, adds up
the bits in which the two sides differ, and drops a pair as soon as the sum exceeds the budget. A unit returns a spanning
forest of the links it found, never all pairs, so a group of n copies costs n - 1 rows. Groups above ``unit_rows`` are
dealt out as pairs of chunks, so that no task holds a whole hot group, and no link is lost.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._scratch import forget, stored
from quire.llm._text import by_row, lower_ascii, mix, raw, shingle_hashes, slices, word_hashes, words

_LANES = np.uint64(0x0101010101010101)


def vote(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of each row's hashes: a bit is 1 if it is set in over half of them; a row without hashes gets zero."""
    count = np.diff(at)
    # 8 counters of 8 bits fit in a 64-bit lane, so runs of at most 255 hashes are added at once
    runs = -(-count // 255)
    row = np.repeat(np.arange(len(count)), runs)
    ends = np.concatenate([[0], np.cumsum(runs)])
    begin = at[:-1][row] + 255 * (np.arange(ends[-1]) - ends[:-1][row])
    ones = np.zeros((len(begin), 64), np.int64)
    if len(begin):
        for b in range(8):
            lanes = np.add.reduceat((hashes >> np.uint64(b)) & _LANES, begin)
            ones[:, b::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    total = by_row(ones, ends)
    return ((total * 2 > count[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _joined(column: pa.Array):
    """A-Z lower-cased text whose words are divided by one space; the words' places in it."""
    data, offsets = raw(column)
    low = lower_ascii(data)
    begin, end, first = words(low, offsets)
    length = end - begin
    place = np.concatenate([[0], np.cumsum(length + 1)])
    inside = np.repeat(begin - place[:-1], length + 1) + np.arange(place[-1])
    out = np.full(place[-1], 32, np.uint8)
    letter = np.ones(place[-1], bool)
    letter[place[1:] - 1] = False
    out[letter] = low[inside[letter]]
    return out.tobytes(), place[:-1], place[1:] - 1, first


def _xxh64_shingles(column: pa.Array, width: int):
    text, begin, end, first = _joined(column)
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(made)), made)
    head = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    tail = np.minimum(head + width, first[1:][row]) - 1
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(text[a:b], 42) for a, b in zip(begin[head].tolist(), end[tail].tolist(), strict=True)], np.uint64)
    return hashes, at


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): the 64-bit SimHash over the XXH64 (seed 42) of every ``width``-word shingle, repeats included.

    A null, empty or blank text has fingerprint zero. Repeated keys keep a row each. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(vote(*_xxh64_shingles(piece.column("text"), width)).view(np.int64))], ["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("fp", T.LongType())]))


# ---------------------------------------------------------------------------------------------------------------------
# the trie join inside a unit


def _cut(codes: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """For nodes [low, high) of sorted codes that agree above ``bit``: where that bit turns from 0 to 1."""
    ones = np.concatenate([[0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
    return high - (ones[high] - ones[low])


def trie_pairs(codes: np.ndarray, roots: np.ndarray, budget: int, small: int = 64):
    """Yield (left, right) index arrays of all links between the two sides of each root pair.

    codes: fingerprints, sorted within every node. roots: rows (low, high, low, high) of the two nodes; a node may be
    paired with itself. Pairs whose sizes multiply to ``small`` or less are compared at once.
    """
    a, b, c, d = roots.T.astype(np.int64)
    spent = np.zeros(len(a), np.int64)
    for bit in range(63, -2, -1):
        done = ((b - a) * (d - c) <= small) | (bit < 0)
        if done.any():
            yield from _compare(codes, a[done], b[done], c[done], d[done], budget)
        a, b, c, d, spent = (x[~done] for x in (a, b, c, d, spent))
        if not len(a):
            return
        left, right, same = _cut(codes, a, b, bit), _cut(codes, c, d, bit), a == c
        children = [(a, left, c, right, spent), (left, b, right, d, spent), (a, left, right, d, spent + 1), (left, b, c, right, spent + 1)]
        children[3] = tuple(x[~same] for x in children[3])  # a node with itself has its mixed pair once
        a, b, c, d, spent = (np.concatenate(x) for x in zip(*children, strict=True))
        keep = (a < b) & (c < d) & (spent <= budget)
        a, b, c, d, spent = (x[keep] for x in (a, b, c, d, spent))


def _compare(codes, a, b, c, d, budget, at_once: int = 1 << 20):
    sizes = (b - a) * (d - c)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + at_once, "right")))
        pick = slice(begin, stop)
        size = sizes[pick]
        pair = np.repeat(np.arange(stop - begin), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wide = (d - c)[pick][pair]
        left, right = a[pick][pair] + k // wide, c[pick][pair] + k % wide
        near = (left < right) & (np.bitwise_count(codes[left] ^ codes[right]) <= budget)
        yield left[near], right[near]
        begin = stop


def _forest(n: int, pairs, holds=None, at_once: int = 1024) -> np.ndarray:
    """The smallest index that links reach, for each of n rows; with ``holds``, only by links for which it is true."""
    label = np.arange(n)
    if holds is not None:
        pairs = ((x[i : i + at_once], y[i : i + at_once]) for x, y in pairs for i in range(0, len(x), at_once))
    for left, right in pairs:
        if holds is not None:  # what is connected already needs no proof
            apart = label[left] != label[right]
            left, right = left[apart], right[apart]
            true = holds(left, right)
            left, right = left[true], right[true]
        while True:
            x, y = label[left], label[right]
            apart = x != y
            if not apart.any():
                break
            left, right = left[apart], right[apart]
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(deeper := label[label], label):
                label = deeper
    return label


def _alike(hashes: np.ndarray, at: np.ndarray, similarity: float, at_once: int = 1 << 20):
    """A function of index arrays (left, right): whether the Jaccard similarity of two rows' sets is ``similarity`` or more."""
    ids = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    size, kinds = np.diff(at), int(ids.max(initial=0)) + 1

    def members(rows):
        n = size[rows]
        pair = np.repeat(np.arange(len(rows)), n)
        return pair * kinds + ids[np.repeat(at[:-1][rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def holds(left, right):
        small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
        out = large == 0
        open_ = np.flatnonzero((large > 0) & (small >= similarity * large * (1 - 1e-9)))
        ends = np.cumsum((small + large)[open_])
        begin = 0
        while begin < len(open_):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + at_once, "right")))
            pick = open_[begin:stop]
            both = np.sort(np.concatenate([members(left[pick]), members(right[pick])]))
            shared = np.bincount(both[1:][both[1:] == both[:-1]] // kinds, minlength=len(pick))
            out[pick] = shared / (small[pick] + large[pick] - shared) >= similarity
            begin = stop
        return out

    return holds


def _unit_links(table: pa.Table, budget: int, far: int | None, exact: tuple[int, float] | None = None):
    """Star links (node, root) of every unit in a table that holds whole units, sorted by unit, side and fingerprint."""
    codes = table.column("fp").to_numpy().view(np.uint64)
    unit, side = table.column("unit").to_numpy(), table.column("side").to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])]))
    high = np.append(edge[1:], len(codes))
    key, second = unit[edge], side[edge]
    lone = table.column("lone").to_numpy()[edge].astype(bool)  # a chunk against itself
    roots = [np.stack([edge, high, edge, high], 1)[lone]]
    both = np.flatnonzero((key[1:] == key[:-1]) & (second[1:] != second[:-1]))
    roots.append(np.stack([edge[both], high[both], edge[both + 1], high[both + 1]], 1))
    pairs = trie_pairs(codes, np.concatenate(roots), budget)
    if far is not None:
        flat = pa.chunked_array(table.column("sig").chunks, table.column("sig").type).combine_chunks()
        signature = np.frombuffer(b"".join(flat.to_pylist()), np.uint64).reshape(len(codes), -1)
        pairs = ((x[ok], y[ok]) for x, y in pairs for ok in [np.bitwise_count(signature[x] ^ signature[y]).sum(1) <= far])
    holds = _alike(*_sets(table.column("text").combine_chunks(), exact[0]), exact[1]) if exact else None
    label = _forest(len(codes), pairs, holds)
    moved = np.flatnonzero(label != np.arange(len(codes)))
    node = table.column("node")
    return pa.table({"a": node.take(pa.array(moved)), "b": node.take(pa.array(label[moved]))})


def trie_links(nodes: DataFrame, budget: int = 3, blocks: int = 4, unit_rows: int = 1024, far: int | None = None, given: str | None = None, exact: tuple[int, float] | None = None, unit_size: int = 1 << 20) -> DataFrame:
    """Links (a, b) that connect all nodes whose fingerprints differ in ``budget`` bits or fewer.

    nodes: node (any type), fp long and, with ``far``, sig binary: then a link also needs signatures that differ in at
    most ``far`` bits. given: a column with the unit of each row; only rows of one unit are compared, with no blocks. Of
    ``blocks`` blocks at most ``budget`` can differ, so two linked fingerprints agree on blocks - budget of them: each such choice is a table.
    With ``exact`` (width, similarity), text string and size long a link also needs that Jaccard similarity of the two texts'
    sets of ``width``-word shingles, and a group is also dealt out if its sizes sum to more than ``unit_size``.
    More blocks make smaller groups and more tables. Two rows of a hot group meet in exactly one pair of chunks.
    """
    carried = ["node", "fp", *(["sig"] if far is not None else []), *(["text", "size"] if exact else [])]
    if given:
        keyed = nodes.select(*carried, F.col(given).alias("unit"))
    else:
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        part = [sum(1 << bit for bit in range(edges[i], edges[i + 1])) for i in range(blocks)]
        masks = [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - budget)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        keyed = nodes.select(*carried, F.explode(F.array(*(F.xxhash64(F.lit(0), F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))).alias("unit"))
    parts = F.greatest(F.ceil(F.count("*") / unit_rows), F.ceil(F.sum("size") / unit_size)) if exact else F.ceil(F.count("*") / unit_rows)
    hot = stored(keyed.groupBy("unit").agg(parts.cast("int").alias("n")).where("n > 1"), "hot")
    chunks = F.coalesce("n", F.lit(1))
    dealt = keyed.join(hot, "unit", "left").withColumn("k", chunks).withColumn("c", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    unit = F.when(F.col("k") == 1, F.col("unit")).otherwise(F.xxhash64("unit", F.least("c", "j"), F.greatest("c", "j")))
    dealt = dealt.select(*carried, unit.alias("unit"), (F.col("c") > F.col("j")).cast("int").alias("side"), (F.col("c") == F.col("j")).cast("int").alias("lone"))
    sorted_units = dealt.repartition("unit").sortWithinPartitions("unit", "side", F.col("fp").bitwiseXOR(F.lit(-(1 << 63))), "node")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            unit = held.column("unit").to_numpy()
            turns = np.flatnonzero(unit[1:] != unit[:-1])
            if len(turns):
                yield from _unit_links(held.slice(0, turns[-1] + 1), budget, far, exact).to_batches()
                held = held.slice(turns[-1] + 1)
        if held is not None and held.num_rows:
            yield from _unit_links(held, budget, far, exact).to_batches()

    kind = nodes.schema["node"].dataType
    return sorted_units.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct()


# ---------------------------------------------------------------------------------------------------------------------
# components


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots: root is the smallest node that it reaches.

    Large-star and small-star rounds by aggregation and joins; each round is written to the shared folder. A hub's rows
    are met in a join, which Spark can split, and its minimum is pre-aggregated before the shuffle.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = stored(small.where("u <> v").distinct(), "links")
        now = _state(after)
        forget(edges)
        edges = after
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, budget: int = 3, blocks: int = 6, unit_rows: int = 1024) -> DataFrame:
    """(key, fingerprint, component_id) per row: component_id is the smallest key that links reach, itself included.

    With six blocks of which three may differ there are 20 tables whose units agree on about 32 bits: a fingerprint that nothing
    is near meets N / 2**32 others in each, so that the pair work stays small up to some 10**10 texts.

    Rows whose fingerprints differ in ``budget`` bits or fewer are linked, rows without words (fingerprint zero) like
    any other. Equal fingerprints are joined once, as one node. A null key has a row too and never is a component_id
    unless its component holds nothing else. Empty input gives an empty result; other columns are not read.
    """
    marked = stored(fingerprints(docs, key, text, width), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("key").alias("first")), "nodes")
    roots = components(trie_links(nodes.select(F.col("fp").alias("node"), "fp"), budget, blocks, unit_rows))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("key").alias(key), hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------------------------------------------------------------
# the pipeline's stage: similarity of five-word shingles


def _sets(column: pa.Array, width: int):
    """Every row's distinct shingle hashes, in order, and the rows' first ones."""
    hashes, at = shingle_hashes(*word_hashes(column), width)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(at)))


def _bands(hashes: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands): each a hash of ``rows`` minima over the text's shingles; sets of similarity J share one with chance J ** rows."""
    full = at[1:] > at[:-1]
    out = np.zeros((len(full), bands), np.uint64)
    for band in range(bands):
        for k in range(rows):
            least = np.zeros(len(full), np.uint64)
            if full.any():
                least[full] = np.minimum.reduceat(mix(hashes, 1000 + band * rows + k), at[:-1][full])
            out[:, band] = mix(out[:, band] ^ least, 50 + k)
    return out


def _signatures(docs: DataFrame, width: int, bands: int, rows: int, length: int) -> DataFrame:
    """(key, node, units, sig, size): candidate units and a long SimHash over distinct shingles, and how many these are."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                shingle, at = _sets(piece.column("text"), width)
                units = _bands(shingle, at, bands, rows).view(np.int64)
                sig = np.stack([vote(mix(shingle, 100 + s), at) for s in range(length)], 1)
                ends = pa.array(np.arange(0, len(units) * bands + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("node"), pa.ListArray.from_arrays(ends, pa.array(units.ravel())), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(np.diff(at))], ["key", "node", "units", "sig", "size"])

    kind = T.StructType([docs.schema["key"], T.StructField("node", T.BinaryType()), T.StructField("units", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType()), T.StructField("size", T.LongType())])
    return docs.mapInArrow(run, kind)


def bits_apart(similarity: float, length: int) -> int:
    """Differing bits, of ``length`` times 64, that sets of this Jaccard similarity and like size show on average."""
    return int(64 * length * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, margin: float = 0.3, bands: int = 20, rows: int = 4, length: int = 8, budget: int = 26, unit_rows: int = 1024) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest key stays, all columns with it.

    Equal texts are one group. Others are linked if the Jaccard similarity of their sets of ``width``-word shingles, lower-cased,
    is ``similarity`` or more. Candidates come from the same shingles: texts that share one of ``bands`` hashes of ``rows``
    minima meet, walk as a trie within ``budget`` bits of 64, and need SimHashes of 64 * length bits as close as a similarity
    of ``similarity - margin`` makes them on average. Texts that candidates connect then meet once more, with their texts, and
    each link is proved by the exact similarity before groups are formed. Of pairs at 0.8 the bands miss 1 in 38000, and the bits are 4.5 standard errors wider than the worst case
    (four shingles against five). Null texts count as empty, and blank texts are copies of each other. Of rows with equal
    keys and texts one stays; a null key comes first. ``docs`` is read three times.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    marked = stored(_signatures(docs.select(F.col(key).alias("key"), digest.alias("node"), F.col(text).alias("text")), width, bands, rows, length), "signatures")
    groups = stored(marked.groupBy("node").agg(F.min(F.struct(F.col("key").isNotNull().alias("there"), "key")).alias("low"), F.first("units").alias("units"), F.first("sig").alias("sig"), F.first("size").alias("size")), "texts")
    coded = groups.withColumn("fp", F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long"))
    far = bits_apart(similarity - margin, length)
    spread = coded.select("node", "fp", "sig", F.posexplode("units").alias("band", "unit")).withColumn("unit", F.xxhash64("band", "unit"))
    loose = stored(components(trie_links(spread, budget, unit_rows=unit_rows, far=far, given="unit")), "candidates")
    loose = loose.union(loose.select("root", "root").distinct())
    texts = docs.select(digest.alias("node"), F.col(text).alias("text")).join(loose.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    near = stored(coded.select("node", "fp", "sig", "size").join(loose, "node").join(texts, "node").withColumn("unit", F.xxhash64("root")), "near")
    roots = components(trie_links(near, budget, unit_rows=unit_rows, far=far, given="unit", exact=(width, similarity)))
    placed = groups.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = placed.groupBy("root").agg(F.min(F.struct("low", "node")).alias("kept"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    kept = kept.select(F.col("kept.node").alias("_node"), name(F.col("kept.low.key")).alias("_name"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest.alias("_node"), name(F.col(key)).alias("_name"))
    found = whole.join(kept, ["_node", "_name"], "left_semi")
    once = found.withColumn("_n", F.row_number().over(Window.partitionBy("_node", "_name").orderBy("_name")))
    return once.where("_n = 1").select("row.*")
