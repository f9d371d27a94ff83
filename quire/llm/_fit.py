"""Bounded samples of labelled rows, models fitted on them in one task, and small numpy helpers for sparse rows."""

import pickle
import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold`` when divided by ``folds``; a null key never does."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str, label: str, out: Column, bound: int) -> DataFrame:
    """Columns of ``docs`` and ``_y`` for at most ``bound`` labelled keys of ``docs`` that ``out`` doesn't hold out, the same at each run.

    Labels of keys that ``docs`` doesn't have take no place in the sample. Of a key with several labels the highest counts, of a key with several rows the one whose columns have the smallest hash.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).where(~out).groupBy(key).agg(F.max(label).alias("_y"))
    known = known.join(docs.select(key), key, "left_semi")
    chosen = known.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(5)), key).limit(bound).select(F.col(key).alias("_k"), "_y")
    rows = docs.join(F.broadcast(chosen), docs[key] == F.col("_k"))  # bound rows at most
    held = [c for c in docs.columns if c != key]
    first = F.min(F.struct(F.xxhash64(*held).alias("_h"), F.struct(*held, "_y").alias("row"))).alias("first")
    return rows.groupBy(key).agg(first).select(key, "first.row.*")


def fitted(rows: DataFrame, fit, text: str, most_bytes: int = 256 << 20):
    """What ``fit`` makes of the bounded ``rows`` (an Arrow table), in one task; None if there are no rows.

    The task takes the rows in order of a hash of their ``text`` while their texts fit into ``most_bytes``; a text that doesn't
    fit any more is left out, as the sample is bounded in bytes as well.
    """

    def run(batches):
        kept, room = [], most_bytes
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            take = []
            for i, n in enumerate(size.tolist()):
                if n <= room:
                    room -= n
                    take.append(i)
            if take:
                kept.append(pa.Table.from_batches([batch.take(pa.array(take))]))
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.concat_tables(kept)))])], ["model"])

    got = rows.repartition(1).sortWithinPartitions(F.xxhash64(text), *rows.columns).mapInArrow(run, "model binary").collect()  # one model of fixed size
    if not got:
        warnings.warn("no labelled rows: there is no model", stacklevel=2)
    return pickle.loads(got[0][0]) if got else None


def distinct(codes: np.ndarray, at: np.ndarray, width: int):
    """Each row's distinct codes (below ``width``) in order, how often they occur, and the rows' new places."""
    row = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    joined = np.sort(row * np.uint64(width) + codes.astype(np.uint64))
    new = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]])) if len(joined) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(joined)))
    kept = joined[new]
    return (kept % np.uint64(width)).astype(np.int64), count, np.searchsorted(kept, np.arange(len(at), dtype=np.uint64) * np.uint64(width))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def scale_and_shift(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Platt scaling: a and b so that sigmoid(a * z + b) fits y, by Newton steps with a little ridge."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum()])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)
