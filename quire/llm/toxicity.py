"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased code points, white space made one blank, hashed. Each is
scaled by r = log((p + 1) / |p + 1|) - log((q + 1) / |q + 1|), where p and q count the toxic and the other labelled texts that
hold it; logistic regression is fitted on the scaled features. A task holds one text's n-grams at a time, or those of several
that make up a quarter of a megabyte: about 100 bytes for each character of the longest text.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._fit import fitted, held_out, sample, sigmoid
from quire.llm._text import by_row, mix, slices

_BITS = 20
_ORDERS = (3, 4, 5, 6, 7)
_PIECE = 1 << 18  # bytes of texts whose n-grams are held at a time


def features(column: pa.Array, used: np.ndarray | None = None):
    """Distinct hashed n-grams of every text, those that ``used`` marks, and the rows' places in them."""
    texts = pc.utf8_lower(pc.fill_null(column, "")).to_pylist()
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    keep = ~(blank & np.concatenate([[False], blank[:-1] & (row[1:] == row[:-1])]))
    points, row = np.where(blank, 32, points)[keep].astype(np.uint64), row[keep]
    h, found = np.zeros(len(points) + 1, np.uint64), []
    for n in range(1, max(_ORDERS) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
        if not len(h):
            break
        if n in _ORDERS:
            code = mix(h, n) >> np.uint64(64 - _BITS)
            inside = row[: len(h)] == row[n - 1 :]
            if used is not None:
                inside &= used[code]
            at = np.flatnonzero(inside)
            found.append(row[at].astype(np.uint64) << np.uint64(_BITS) | code[at])
    joined = np.sort(np.concatenate(found or [np.zeros(0, np.uint64)]))
    if len(joined):
        joined = joined[np.concatenate([[True], joined[1:] != joined[:-1]])]
    return (joined & np.uint64((1 << _BITS) - 1)).astype(np.int64), np.searchsorted(joined, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(_BITS))


def fit(column: pa.Array, y: np.ndarray, steps: int = 150, errors: float = 3.0, least: int = 3, rate: float = 0.1, ridge: float = 1e-5) -> dict:
    """Weights per hashed n-gram and a shift.

    N-grams in fewer than ``least`` texts, and those whose log-count ratio is less than ``errors`` standard errors from
    none, are left out. The regression is fitted by ``steps`` AdaGrad steps over all texts of the bounded sample.
    """
    width = 1 << _BITS
    p, q = np.zeros(width, np.int64), np.zeros(width, np.int64)
    pieces = lambda: slices(pa.RecordBatch.from_arrays([column, pa.array(y)], ["text", "y"]), "text", _PIECE)
    for piece in pieces():
        code, at = features(piece.column("text"))
        toxic = np.repeat(piece.column("y").to_numpy() == 1, np.diff(at))
        p += np.bincount(code[toxic], minlength=width)
        q += np.bincount(code[~toxic], minlength=width)
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    raw = np.log((p + 0.5) / max(p.sum(), 1)) - np.log((q + 0.5) / max(q.sum(), 1))
    used = (abs(raw) >= errors * np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))) & (p + q >= least)
    found = [features(piece.column("text"), used) for piece in pieces()]  # only what is used is held for all texts
    row = np.repeat(np.arange(len(y)), np.concatenate([np.diff(a) for _, a in found]))
    ids, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    x = ratio[ids][at]
    w, b, seen, seen_b = np.zeros(len(ids)), 0.0, np.full(len(ids), 1e-8), 1e-8
    for _ in range(steps):
        g = (sigmoid(np.bincount(row, w[at] * x, minlength=len(y)) + b) - y) / len(y)
        slope = np.bincount(at, g[row] * x, minlength=len(ids)) + ridge * w
        seen += slope**2
        w -= rate * slope / np.sqrt(seen)
        seen_b += g.sum() ** 2
        b -= rate * g.sum() / np.sqrt(seen_b)
    weight = np.zeros(width, np.float32)
    weight[ids] = w * ratio[ids]
    return {"weight": weight, "used": used, "shift": b}


def scores(column: pa.Array, model: dict | None) -> np.ndarray:
    """The probability that each text is toxic; 0 without a model."""
    if model is None:
        return np.zeros(len(column))
    code, at = features(column, model["used"])
    return sigmoid(by_row(model["weight"][code].astype(np.float64), at) + model["shift"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, fold: int = 0, bound: int = 6000) -> dict | None:
    """A model of at most ``bound`` labelled rows, none of them held out; None if no row of ``docs`` is labelled."""
    rows = sample(docs.select(F.col(key), F.col(text).alias("text")), labels, key, label, held_out(key, folds, fold), bound)
    return fitted(rows.select("text", F.col("_y").cast("int").alias("y"), key), lambda t: _fit_table(t.sort_by(key)), "text")


def _fit_table(table: pa.Table) -> dict:
    return fit(table.column("text").combine_chunks(), table.column("y").to_numpy())


def score(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 0) -> DataFrame:
    """(key, held_out, score, predicted) per row. Null and empty texts get the score of a text without n-grams; null keys aren't held out."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", _PIECE):
                yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("out"), pa.array(scores(piece.column("text"), sent.value))], [key, "held_out", "score"])

    rows = docs.select(F.col(key).alias("key"), held_out(key, folds, fold).alias("out"), F.col(text).alias("text"))
    kind = T.StructType([T.StructField(key, rows.schema["key"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, kind).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on the labelled rows of ``docs`` that aren't held out and score every row."""
    return score(docs, train(docs, labels, **options), **{k: v for k, v in options.items() if k in ("key", "text", "folds", "fold")})


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text=text, **options))

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text, _PIECE):
                yield piece.filter(pa.array(scores(piece.column(text), sent.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
