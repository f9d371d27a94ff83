"""Ranked lexical search by three-phase uniform thresholds (TPUT) over postings that are partitioned by term.

A posting is (term, row, c): what the term adds to the document's score. Phase 1 fetches the heads of all lists; the sums that
they give each item's documents bound its k-th score from below. Phase 2 divides that bound by the number of the item's lists:
a document below the quotient in every list can't be among the k best, so each list is fetched down to the lowest quotient
of the items that use it. The sums so far raise the lower bounds, and what a list may still hold of a document bounds its
score from above. Phase 3 looks up the exact scores of documents whose upper bound reaches the lower one.

Texts are read once. The tasks keep a term if its place in a bitmap of fixed size is set by some item's term; a term is
its 64-bit hash. Lists are cut by row, so that a frequent term's list is spread; documents meet in blocks in phase 2.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._scratch import stored
from quire.llm._text import PUNCTUATION, hash_spans, lower_ascii, raw, slices, words

_BITS = 20  # of a place in the bitmap


def _terms(column: pa.Array):
    """Hashes of all terms of all rows, and the rows' first ones."""
    data, offsets = raw(column)
    data = lower_ascii(data)
    begin, end, first = words(data, offsets, PUNCTUATION)
    return hash_spans(data, begin, end), first


def _counted(rows: DataFrame, key: str, text: str, bitmap=None) -> DataFrame:
    """(key, n, terms, tfs) per row with a text that has a term: all terms with repeats, the distinct ones that the bitmap lets pass, and how often they occur."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text):
                h, first = _terms(piece.column(text))
                row = np.repeat(np.arange(piece.num_rows), np.diff(first))
                if sent.value is not None:
                    passed = sent.value[h >> np.uint64(64 - _BITS)]
                    row, h = row[passed], h[passed]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
                at = pa.array(np.searchsorted(row[new], np.arange(piece.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (h[new].view(np.int64), np.diff(np.append(new, len(h))))]
                out = pa.RecordBatch.from_arrays([piece.column(key), pa.array(np.diff(first).astype(np.int64)), *lists], [key, "n", "terms", "tfs"])
                yield out.filter(pa.array(np.diff(first) > 0))

    return rows.select(key, text).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, n long, terms array<long>, tfs array<long>")


def _bitmap(lists: DataFrame) -> np.ndarray:
    """Which places the items' terms have: 2**_BITS at most, however many terms there are."""
    place = F.shiftrightunsigned("term", 64 - _BITS).cast("int")
    out = np.zeros(1 << _BITS, bool)
    out[lists.select(place.alias("place")).distinct().toArrow().column("place").to_numpy()] = True
    return out


def _postings(counted: DataFrame, weights: DataFrame, docs: int, length: int) -> DataFrame:
    """(term, row, c) of all terms with a weight; spread by term and slices of its rows."""
    each = counted.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("row", "n", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    norm = F.expr(f"100 - 90 + ((90L * n * {docs}L) div {length}L)")
    c = F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))")
    made = each.join(weights.select("term", "w"), "term").withColumn("m", norm).select("term", "row", c.alias("c")).where("c > 0")
    return made.repartition("term", F.pmod("row", F.lit(16))).sortWithinPartitions("term", F.desc("c"))


def _gather(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [np.zeros(0, np.int64)] for c in ("q", "row", "part", "most")}
        if left.num_rows and right.num_rows:
            rows, at = np.unique(right.column("row").to_numpy(), return_inverse=True)
            term, c = right.column("term").to_numpy(), right.column("c").to_numpy()
            order = np.argsort(term, kind="stable")
            term, c, at = term[order], c[order], at[order]
            q, wanted, rest, low = (left.column(x).to_numpy() for x in ("q", "term", "rest", "low"))
            order = np.argsort(q, kind="stable")
            q, wanted, rest, low = q[order], wanted[order], rest[order], low[order]
            begin, end = np.searchsorted(term, wanted), np.searchsorted(term, wanted, "right")
            edges = np.append(np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])), len(q)).tolist()
            for a, b in zip(edges, edges[1:], strict=False):
                part, known = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                for i in range(a, b):
                    here = at[begin[i] : end[i]]
                    part[here] += c[begin[i] : end[i]]
                    known[here] += rest[i]
                most = part + rest[a:b].sum() - known
                bound = max(int(low[a]), int(np.partition(part, len(part) - k)[len(part) - k]) if len(part) >= k else 0, 1)
                kept = np.flatnonzero(most >= bound)
                for name, x in (("q", np.full(len(kept), q[a])), ("row", rows[kept]), ("part", part[kept]), ("most", most[kept])):
                    out[name].append(x)
        return pa.table({name: np.concatenate(x) for name, x in out.items()})

    return run


def _kth(scored: DataFrame, k: int, score: str, name: str) -> DataFrame:
    """(q, name): each item's k-th highest score; no row where it has fewer."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(score), "row"))
    return scored.withColumn("_place", place).where(F.col("_place") <= k).groupBy("q").agg(F.min(score).alias(name), F.count("*").alias("_n")).where(F.col("_n") == k).drop("_n")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", head: int = 100, block_docs: int = 4096, block_items: int = 512) -> DataFrame:
    """(item, rank, key, score): each item's ``k`` highest-scoring documents with a score above 0, by the ranking function of ``_postings``.

    Equal scores go to the smaller key, null keys last. Rows of ``docs`` are documents of their own, repeated keys and null ones
    too; null and empty texts match nothing. Rows of one item id are one item with the terms of all; items without id or without
    terms have no rows. Other columns aren't read. ``head``, ``block_docs`` and ``block_items`` change the work, not the result.
    """
    item_type, key_type = dict(items.dtypes)[item], dict(docs.dtypes)[key]
    asked = _counted(items.where(F.col(item).isNotNull()), item, item_text).select(F.col(item).alias("_item"), F.explode("terms").alias("term")).distinct()
    asked = stored(asked.withColumn("q", F.xxhash64("_item")), "items")
    counted = _counted(docs, key, text, _bitmap(asked)).withColumn("row", F.monotonically_increasing_id())
    counted = stored(counted, "terms")  # from here on a document has its row number
    n, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(float(n)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = stored(found.join(asked.select("term").distinct(), "term").select("term", w.alias("w")), "weights")
    postings = stored(_postings(counted, weights, n, max(length, 1)), "postings")

    heads = postings.withColumn("_place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("c"), "row"))).where(F.col("_place") <= head)
    heads = stored(heads.drop("_place"), "heads")
    lists = asked.join(heads.groupBy("term").agg(F.max("c").alias("top")), "term")
    lower = _kth(asked.join(heads, "term").groupBy("q", "row").agg(F.sum("c").alias("part")), k, "part", "low")
    sizes = lists.groupBy("q").agg(F.count("*").alias("lists")).join(lower, "q", "left").withColumn("low", F.coalesce("low", F.lit(0)))
    uses = lists.join(sizes, "q").withColumn("least", F.expr("greatest((low + lists - 1) div lists, 1L)"))  # below it in all lists: below ``low`` in sum
    floors = uses.groupBy("term").agg(F.min("least").alias("floor"))
    uses = stored(uses.join(floors, "term").withColumn("rest", F.least(F.col("floor") - 1, "top")).select("_item", "q", "term", "floor", "rest", "low"), "uses")

    across, down = max(1, -(-n // block_docs)), max(1, -(-uses.select("q").distinct().count() // block_items))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    floors = uses.select("term", "floor").distinct()
    entries = postings.join(floors, "term").where("c >= floor").select("term", "row", "c", F.pmod(F.xxhash64("row"), F.lit(across)).cast("int").alias("col"), every(down).alias("line"))
    wanted = uses.select("q", "term", "rest", "low", F.pmod("q", F.lit(down)).cast("int").alias("line"), every(across).alias("col"))
    gathered = wanted.groupBy("line", "col").cogroup(entries.groupBy("line", "col")).applyInArrow(_gather(k), "q long, row long, part long, most long")
    gathered = stored(gathered, "gathered")

    raised = stored(gathered.join(_kth(gathered, k, "part", "kth"), "q", "left").where("most >= coalesce(kth, 1)").select("q", "row", "part"), "raised")
    below = raised.join(uses.where("rest > 0").select("q", "term", "floor"), "q").select("q", "row", "term", "floor")
    missing = postings.join(raised.select("row").distinct(), "row").join(below, ["term", "row"]).where("c < floor").select("q", "row", F.col("c").alias("part"))
    scores = raised.union(missing).groupBy("q", "row").agg(F.sum("part").alias("score")).where("score > 0")
    named = scores.join(counted.select("row", F.col(key).alias("_key")), "row")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("_key"), "row"))
    best = named.withColumn("rank", place).where(F.col("rank") <= k).join(uses.select("q", "_item").distinct(), "q")
    return best.select(F.col("_item").cast(item_type).alias(item), "rank", F.col("_key").cast(key_type).alias(key), "score")
