"""Text from positioned items: rows by baseline, reading order, cells, columns and painted copies.

items: page, str, x, y, w and at (the item's place in its page).
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_RTL = "[\u0590-\u08FF]"


def _begins(page: pa.Array) -> np.ndarray:
    """Where each run of one page begins; nulls are one page."""
    code = page.dictionary_encode("encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, code[1:] != code[:-1]))


_WIDE = {pa.int32(): np.int32, pa.int64(): np.int64, pa.float64(): np.int64}


def _steps(column: pa.Array, starts: np.ndarray) -> pa.Array:
    """Numbers as differences of their bits from one to the next, which are regular; each run begins anew, and nulls stay."""
    if column.type not in _WIDE:
        return column
    column = pa.concat_arrays([column, column.slice(0, 0)])
    bits = np.frombuffer(column.buffers()[1], _WIDE[column.type], len(column))
    steps = np.diff(bits, prepend=bits[:1])
    steps[starts] = bits[starts]
    return pa.Array.from_buffers(column.type, len(column), [column.buffers()[0], pa.py_buffer(steps)])


def _summed(column: pa.Array, n: np.ndarray) -> pa.Array:
    """The numbers of runs of ``n`` steps each."""
    if column.type not in _WIDE:
        return column
    steps = np.frombuffer(column.buffers()[1], _WIDE[column.type], len(column))
    upto, starts = np.cumsum(steps, dtype=steps.dtype), np.cumsum(n) - n
    return pa.Array.from_buffers(column.type, len(column), [column.buffers()[0], pa.py_buffer(upto - np.repeat(upto[starts] - steps[starts], n))])


def packed(items: DataFrame) -> DataFrame:
    """(page, n, size, b): a page's items of one batch as one compressed value; they are regular, and little moves when pages are put together."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            starts = _begins(batch.column(0))
            if len(starts) * 16 > len(batch):  # items that don't come page by page
                batch = batch.take(pc.sort_indices(batch.column(0)))
                starts = _begins(batch.column(0))
            names, n = batch.schema.names[1:], np.diff(np.append(starts, len(batch)))
            rest = pa.RecordBatch.from_arrays([_steps(batch.column(c), starts) for c in names], names)
            plain = [rest.slice(i, k).serialize() for i, k in zip(starts.tolist(), n.tolist(), strict=True)]
            sizes, b = pa.array([x.size for x in plain], pa.int32()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in plain], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), pa.array(n, pa.int32()), sizes, b], ["page", "n", "size", "b"])

    return items.mapInArrow(run, f"page {dict(items.dtypes)['page']}, n int, size int, b binary")


#: Items that a kernel works on in one go; a page is never divided.
ITEMS = 1 << 18


def _by_page(items: DataFrame, kernel, out: str) -> DataFrame:
    """What ``kernel`` makes of whole pages; out: its columns. Items are packed before they move, and meet their page's others.

    The kernel's table has a number for each page, ``p``, and its own must have it first.
    """
    kind, rest = dict(items.dtypes)["page"], items.select([c for c in items.columns if c != "page"])
    schema = to_arrow_schema(rest.schema)

    def made(parts: pa.Table) -> pa.RecordBatch:
        starts = _begins(parts.column("page").combine_chunks())
        runs = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(parts))))
        held = pa.Table.from_batches([pa.ipc.read_record_batch(pa.decompress(b, n, "zstd"), schema) for b, n in zip(parts.column("b").to_pylist(), parts.column("size").to_pylist(), strict=True)], schema).combine_chunks()
        n = parts.column("n").to_numpy()
        held = pa.table([_summed(pa.concat_arrays(c.chunks), n) for c in held.columns], schema=schema)
        done = kernel(held.append_column("p", pa.array(np.repeat(runs, n), pa.int64())).combine_chunks())
        page = parts.column("page").take(pa.array(starts[done.column("p").to_numpy()]))
        return done.remove_column(0).add_column(0, "page", page)

    def run(batches):
        left = None
        for batch in batches:
            left = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            while int(pc.sum(left.column("n")).as_py() or 0) > ITEMS:
                starts = _begins(left.column("page").combine_chunks())[1:]
                if not len(starts):
                    break
                upto = np.append(0, np.cumsum(left.column("n").to_numpy()))[starts]
                cut = int(starts[max(0, int(np.searchsorted(upto, ITEMS, "right")) - 1)])  # the last page may go on in the next batch
                yield from made(left.slice(0, cut)).to_batches()
                left = left.slice(cut)
        if left is not None and len(left):
            yield from made(left).to_batches()

    return packed(items.select("page", *rest.columns)).repartition("page").sortWithinPartitions("page").mapInArrow(run, f"page {kind}, {out}")


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)


def _spot(grid: float) -> list:
    return [F.round(F.col(c) / grid).alias(f"_{c}") for c in ("x", "y")]


def _first(table: pa.Table) -> pa.Table:
    table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("p", "at", "x", "y", "w")], null_placement="at_start"))
    code = table.column("p").to_numpy()
    for c in ("str", "_x", "_y"):
        code = np.unique(code * len(table) + _codes(table.column(c)), return_inverse=True)[1]
    return table.take(pa.array(np.sort(np.unique(code, return_index=True)[1])))


def deduplicated(items: DataFrame, grid: float = 1.0) -> DataFrame:
    """The first of the items that show the same text at the same spot; an item's row, if it has one, stays with it."""
    kinds = dict(items.dtypes)
    kept = [c for c in ("str", "at", "x", "y", "w", "row") if c in kinds]
    return _by_page(items.select("page", *kept, *_spot(grid)), lambda t: _first(t).select(["p", *kept]), ", ".join(f"{c} {kinds[c]}" for c in kept))


def _lined(table: pa.Table, gap: float, cell: float) -> pa.Table:
    table = table.append_column("odd", pc.is_nan(table.column("x"))).append_column("back", pc.match_substring_regex(table.column("str"), _RTL))
    table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("p", "row", "odd", "x", "at", "w", "str")], null_placement="at_start"))
    page, row = table.column("p").to_numpy(), _codes(table.column("row"))
    starts = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (row[1:] != row[:-1]))) if len(page) else np.zeros(0, int)
    back = np.add.reduceat(np.where(table.column("back").to_numpy(), 1, -1), starts) > 0 if len(page) else starts
    xs, ws, strs = (table.column(c).to_pylist() for c in ("x", "w", "str"))
    said, cells = [], []
    for start, stop, flip in zip(starts.tolist(), np.append(starts, len(page))[1:].tolist(), back.tolist(), strict=True):
        parts, begin, end, n = [], 0.0, 0.0, 1
        for i in range(stop - 1, start - 1, -1) if flip else range(start, stop):
            x, w = xs[i], ws[i]
            if parts:
                left = x - end if None not in (x, end) and end <= x else None if None in (begin, x, w) else begin - x - w
                if left is not None and (left > cell or left != left):
                    parts.append(" | ")
                    n += 1
                elif left is not None and left >= gap:
                    parts.append(" ")
            parts.append(strs[i])
            begin, end = x, None if x is None or w is None else x + w
        said.append("".join(parts))
        cells.append(n)
    at = pa.array(starts)
    return pa.table({"p": table.column("p").take(at), "row": table.column("row").take(at), "line": pa.array(said, pa.string()), "cells": pa.array(cells, pa.int32())})


def rows(items: DataFrame, height: float = 2.0, gap: float = 6.0, cell: float = 28.0) -> DataFrame:
    """(page, row, line, cells): one line per row from the top down; the rows of ``baselines``, or else buckets of ``height``.

    Items lie in order of x, in rows that are mostly of a right-to-left script in the other order. A gap of ``gap`` is a
    blank, one of ``cell`` a new cell.
    """
    real = items.where(F.trim("str") != "")
    real = real if "row" in items.columns else real.withColumn("row", F.round(F.col("y") / height).cast("int"))

    return _by_page(real.select("page", "row", "x", "at", "w", "str"), lambda t: _lined(t, gap, cell), f"row {dict(real.dtypes)['row']}, line string, cells int")


def baselines(items: DataFrame, tolerance: float = 0.34, least: float = 0.9) -> DataFrame:
    """Items with their row: a new one begins where the next lower baseline is farther than ``tolerance`` of the item's height.

    Unlike fixed buckets this has no edges that tear a line; items of one page lie in one window. items: also h, the height.
    """
    down = Window.partitionBy("page").orderBy(F.desc("y"), "x", "at")
    apart = (F.lag("y").over(down) - F.col("y")) > F.greatest(F.lit(least), F.greatest("h", F.lag("h").over(down)) * tolerance)
    return items.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("row", -F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _based(table: pa.Table, tolerance: float, least: float) -> pa.Table:
    """``baselines`` of many pages' items, which come out in order of page and row; as there, nulls are no number and NaN is above all others."""
    y, x, h = (pc.cast(table.column(c), pa.float64()) for c in ("y", "x", "h"))
    none = {c: pc.is_null(v).to_numpy() for c, v in (("y", y), ("x", x), ("at", table.column("at")))}
    y, x, at = (pc.fill_null(v, 0).to_numpy() for v in (y, x, table.column("at")))
    h, p, odd = pc.fill_null(h, -np.inf).to_numpy(), table.column("p").to_numpy(), np.isnan(y)
    order = np.lexsort((h, at, ~none["at"], x, ~none["x"], np.where(odd, 0, -y), ~odd, none["y"], p))
    p, y, h, gone = p[order], y[order], h[order], none["y"][order]
    with np.errstate(invalid="ignore"):
        off, reach = y[:-1] - y[1:], np.maximum(least, np.maximum(h[1:], h[:-1]) * tolerance)
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | gone[1:] | gone[:-1] | (off > reach) | (np.isnan(off) & ~np.isnan(reach))
    upto = np.cumsum(new)
    first = np.searchsorted(p, p)
    return table.take(pa.array(order)).append_column("row", pa.array(upto[first] - upto - 1, pa.int64()))


def tables(lines: DataFrame, least: int = 2) -> DataFrame:
    """(page, first, last, columns, rows): runs of consecutive rows with ``least`` cells or more, as tables: rows of cells from the top down.

    A line's cells are what `` | `` divides.
    """
    order = Window.partitionBy("page").orderBy(F.desc("row"))
    ranked = lines.withColumn("at", F.row_number().over(order)).where(F.col("cells") >= least)
    runs = ranked.withColumn("run", F.col("at") - F.row_number().over(order)).groupBy("page", "run")
    rows = runs.agg(F.max("row").alias("first"), F.min("row").alias("last"), F.max("cells").alias("columns"), F.array_sort(F.collect_list(F.struct("at", F.split("line", " \\| ").alias("c")))).alias("r"))
    return rows.where(F.size("r") >= 2).select("page", "first", "last", "columns", F.transform("r", lambda x: x["c"]).alias("rows"))


def columns(lines: DataFrame, most: int = 3) -> DataFrame:
    """(page, columns): how many columns a page has, by the cells of its widest row."""
    return lines.groupBy("page").agg(F.least(F.greatest(F.max("cells"), F.lit(1)), F.lit(most)).alias("columns"))


def page_text(lines: DataFrame) -> DataFrame:
    """(page, text): a page's rows from the top (the greatest y) down."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("row")).alias("r"), "line")))
    return lines.groupBy("page").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def _texts(lines: pa.Table) -> pa.Table:
    order = np.lexsort((-lines.column("row").to_numpy(), lines.column("p").to_numpy()))
    page, line = lines.column("p").to_numpy()[order], lines.column("line").combine_chunks().take(pa.array(order))
    starts = np.unique(page, return_index=True)[1]
    said = pa.ListArray.from_arrays(pa.array(np.append(starts, len(page)), pa.int32()), line)
    return pa.table({"p": pa.array(page[starts], pa.int64()), "text": pc.binary_join(said, "\n")})


def page_texts(items: DataFrame, grid: float = 1.0, tolerance: float = 0.34, least: float = 0.9, gap: float = 6.0, cell: float = 28.0) -> DataFrame:
    """(page, text): ``page_text`` of the ``rows`` of the ``deduplicated`` items on their ``baselines``, with one move of the items. items: also h."""

    def run(table: pa.Table) -> pa.Table:
        once = _first(_based(table, tolerance, least))
        said = pc.not_equal(pc.utf8_trim(once.column("str"), " "), "")
        return _texts(_lined(once.filter(said).select(["p", "row", "x", "at", "w", "str"]), gap, cell))

    return _by_page(items.select("page", "str", "at", "x", "y", "w", "h", *_spot(grid)), run, "text string")


def without_repeated_blocks(words: DataFrame, width: int = 6) -> DataFrame:
    """Words (page, at, word) less those that lie in a run of ``width`` words which an earlier place of the page has."""
    order = Window.partitionBy("page").orderBy("at")
    gram = F.concat_ws(" ", *(F.lead("word", k).over(order) for k in range(width)))
    full = F.lead("word", width - 1).over(order).isNotNull()
    grams = words.withColumn("gram", F.when(full, gram)).withColumn("seen", F.min("at").over(Window.partitionBy("page", "gram")))
    later = F.col("gram").isNotNull() & (F.col("seen") < F.col("at"))
    covered = F.max(later.cast("int")).over(order.rowsBetween(-(width - 1), 0))
    return grams.withColumn("covered", F.coalesce(covered, F.lit(0))).where("covered = 0").select("page", "at", "word")
