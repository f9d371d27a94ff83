"""Search by an index of character grams: containment of a term needs all of its grams, so stretches of pages without them aren't read.

The searchable view is laid out by book and stretch of pages; the index has a row for each gram and stretch. A query looks up
its terms' grams, and only the partitions of stretches that hold them are read and searched.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import search

WIDTH = 3  # characters of a gram
SPAN = 64  # pages of a stretch at least; the larger, the smaller the index and the more is read
STRETCHES = 512  # about how many stretches a library has at most, besides one or two a book: each is a folder of its own
KEYS = ("book_id", "stretch")
#: Stretches up to which the candidates are sent to all tasks; beyond, they are joined by a shuffle.
FEW = 100_000


def span_for(pages: int) -> int:
    """Pages of a stretch in a library of so many pages: files grow with it, and not their number."""
    return max(SPAN, -(-pages // STRETCHES))


def stretched(view: DataFrame, span: int = SPAN, laid: bool = False) -> DataFrame:
    """The view with each page's stretch, by which it is to be laid out. laid: its files are in order of book and page, so no page moves."""
    rows = view.withColumn("stretch", F.floor(F.col("physical_page") / span).cast("int"))
    return (rows if laid else rows.repartition(*KEYS)).sortWithinPartitions(*KEYS, "physical_page")


def grams_of(texts: list, width: int = WIDTH) -> np.ndarray:
    """The distinct grams of some texts, less NUL at their ends; a null text has none."""
    found = [np.zeros((0, width), np.uint32)]
    for text in texts:
        if text is not None and len(text) >= width:
            windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), width)
            if width > 3:
                found.append(np.unique(windows, axis=0))
                continue
            codes = np.unique(reduce(lambda held, k: held << np.uint64(21) | windows[:, k], range(width), np.zeros(len(windows), np.uint64)))  # a code point has 21 bits
            found.append(np.stack([codes >> np.uint64(21 * (width - 1 - k)) & np.uint64((1 << 21) - 1) for k in range(width)], 1).astype(np.uint32))
    return np.unique(np.ascontiguousarray(np.concatenate(found)).view(f"<U{width}").ravel())


def index(view: DataFrame, fields: tuple, width: int = WIDTH) -> DataFrame:
    """(gram, book_id, stretch), each once, in order of grams. view: what ``stretched`` gives."""
    kinds = dict(view.dtypes)

    def run(batches):
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in KEYS), strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                held = np.zeros(0, f"<U{width}")
                for at in range(start, end, 16):
                    few = batch.slice(at, min(16, end - at))
                    held = np.union1d(held, grams_of([t for f in fields for t in few.column(f).to_pylist()], width))
                yield pa.RecordBatch.from_arrays([pa.array(held.tolist(), pa.string()), *(pa.array([k] * len(held), batch.schema.field(n).type) for n, k in zip(KEYS, keys[start], strict=True))], ["gram", *KEYS])

    every = view.select(*KEYS, *fields).mapInArrow(run, f"gram string, book_id {kinds['book_id']}, stretch {kinds['stretch']}")
    return every.distinct().repartitionByRange("gram", *KEYS).sortWithinPartitions("gram", *KEYS)


def candidates(gram_index: DataFrame, terms: list[str], match: str, width: int = WIDTH) -> DataFrame | None:
    """The stretches that may match, or None if the terms don't narrow them: any of them is too short, or for ``all`` each one is."""
    needed = [sorted({t[i : i + width].rstrip("\0") for i in range(len(t) - width + 1)}) for t in terms]
    if not all(needed) if match != "all" else not any(needed):
        return None
    needed = [g for g in needed if g]
    held = gram_index.where(F.col("gram").isin(sorted({x for g in needed for x in g}))).groupBy(*KEYS).agg(F.collect_set("gram").alias("held"))
    full = [F.size(F.array_intersect("held", F.array(*map(F.lit, g)))) == len(g) for g in needed]
    return held.where(reduce((lambda a, b: a & b) if match == "all" else (lambda a, b: a | b), full)).select(*KEYS)


def narrowed(view: DataFrame, gram_index: DataFrame, query: str, match: str = "any") -> DataFrame:
    """The view's rows on stretches that may match the query."""
    terms = search.terms_of(query, match)
    near = candidates(gram_index, terms, match) if terms else None
    if near is None:
        return view
    few = len(near.limit(FEW + 1).take(FEW + 1)) <= FEW
    return view.join(F.broadcast(near) if few else near, list(KEYS), "left_semi")


def find(view: DataFrame, gram_index: DataFrame, books: DataFrame, query: str, match: str = "any", **options) -> DataFrame:
    """``search.search`` over the candidates alone; the same rows as over the whole view."""
    return search.search(narrowed(view, gram_index, query, match), books, query, match, **options)
