"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Score of a text x: w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), the pairwise interactions of
all features in time linear in their number. Hashed words carry x = sqrt(count), scaled to length 1 per text; the
statistics are measured on the whole text and standardised on the sample.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._fit import distinct, fitted, held_out, sample, scale_and_shift, sigmoid
from quire.llm._text import PUNCTUATION, by_row, hash_spans, mix, raw, shingle_hashes, slices, words

_BITS = 16
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_PLAIN = np.array([chr(c) in " .,;:'\"()-?\n\t" for c in range(256)])
_LINE = np.array([c == 10 for c in range(256)])


def _distinct_share(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    _, _, ends = distinct(mix(hashes, 9) >> np.uint64(24), at, 1 << 40)
    return np.diff(ends) / np.maximum(np.diff(at), 1)


def statistics(data, offsets, begin, end, first, hashes) -> np.ndarray:
    """Structure of each text, one row each: counts as logarithms, and shares."""
    size, count = np.maximum(np.diff(offsets), 1), np.diff(first)
    share = lambda table: by_row(table[data].astype(np.int64), offsets) / size
    length = by_row(end - begin, first) / np.maximum(count, 1)
    again = np.concatenate([[0], (hashes[1:] == hashes[:-1]).astype(np.int64)]) if len(hashes) else np.zeros(0, np.int64)
    if len(hashes):
        again[first[:-1][first[:-1] < len(hashes)]] = 0
    sign = PUNCTUATION[data[np.maximum(end - 1, 0)]] & ~_PLAIN[data[np.maximum(end - 1, 0)]] if len(data) else np.zeros(0, bool)
    head, tail, lines = words(data, offsets, _LINE)
    line = hash_spans(data, head, tail)
    five, at = shingle_hashes(hashes, first, 5)
    columns = [
        np.log1p(count), np.log1p(size), np.log1p(np.diff(lines)), length, share(_UPPER), share(_DIGIT), share(PUNCTUATION & ~_PLAIN), share(np.array([c == 124 for c in range(256)])), share(np.array([c == 33 for c in range(256)])),
        by_row(again, first) / np.maximum(count, 1), by_row(sign.astype(np.int64), first) / np.maximum(count, 1), _distinct_share(hashes, first), _distinct_share(five, at), _distinct_share(line, lines), (count == 0).astype(float),
    ]
    return np.stack(columns, 1).astype(np.float64)


def features(column: pa.Array):
    """Hashed words (codes, values, places of the rows) and the statistics of every text."""
    data, offsets = raw(pc.fill_null(column, ""))
    begin, end, first = words(data, offsets)
    hashes = hash_spans(data, begin, end)
    code, count, at = distinct(mix(hashes, 3) >> np.uint64(64 - _BITS), first, 1 << _BITS)
    value = np.sqrt(count)
    value /= np.sqrt(np.maximum(by_row(value**2, at), 1))[np.repeat(np.arange(len(at) - 1), np.diff(at))]
    return code, value, at, statistics(data, offsets, begin, end, first, hashes)


def _rows(column: pa.Array, meta: np.ndarray, centre, spread):
    code, value, at, stats = features(column)
    return code, value, at, np.clip((np.concatenate([stats, meta], 1) - centre) / spread, -4, 4)


def margins(code, value, at, dense, model) -> np.ndarray:
    """The machine's margin for each row, by the sum-of-squares identity."""
    v, u = model["v"], model["u"]
    x = value[:, None].astype(np.float32)
    single = by_row(model["w"][code] * value, at) + dense @ model["wd"]
    sums = by_row(v[code] * x, at) + dense @ u
    squares = by_row((v[code] * x) ** 2, at) + dense**2 @ u**2
    return model["w0"] + single + 0.5 * (sums**2 - squares).sum(1)


def fit(column: pa.Array, meta: np.ndarray, y: np.ndarray, factors: int = 8, epochs: int = 10, batch: int = 64, rate: float = 0.05, ridge: float = 1e-4) -> dict:
    """AdaGrad on the logistic loss; a fifth of the rows calibrates the margin."""
    parts = [features(column.slice(i, 256)) for i in range(0, len(column), 256)]
    code, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    dense = np.concatenate([np.concatenate([p[3] for p in parts]), meta], 1)
    centre, spread = dense.mean(0), dense.std(0) + 1e-6
    dense = np.clip((dense - centre) / spread, -4, 4)
    rng = np.random.default_rng(0)
    size, width = dense.shape[1], 1 << _BITS
    m = {"w0": 0.0, "w": np.zeros(width), "v": rng.normal(0, 0.02, (width, factors)), "wd": np.zeros(size), "u": rng.normal(0, 0.02, (size, factors))}
    seen = {k: np.full(np.shape(x), 1e-8) for k, x in m.items()}
    check = np.arange(len(y)) % 5 == 4
    if len(set(y[check].tolist())) < 2 or len(set(y[~check].tolist())) < 2:
        check[:] = False
    train = np.flatnonzero(~check)
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), batch):
            rows = np.sort(train[i : i + batch])
            ends = np.concatenate([[0], np.cumsum(at[rows + 1] - at[rows])])
            pick = np.repeat(at[rows] - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
            c, x, d = code[pick], value[pick], dense[rows]
            g = (sigmoid(margins(c, x, ends, d, m)) - y[rows]) / len(rows)
            sums = by_row(m["v"][c] * x[:, None], ends) + d @ m["u"]
            ids, back = np.unique(c, return_inverse=True)
            gx = np.repeat(g, np.diff(ends)) * x
            each = gx[:, None] * (np.repeat(sums, np.diff(ends), 0) - m["v"][c] * x[:, None])
            order = np.argsort(back, kind="stable")
            slope = {"w0": g.sum(), "w": np.bincount(back, gx, minlength=len(ids)) + ridge * m["w"][ids], "v": by_row(each[order], np.searchsorted(back[order], np.arange(len(ids) + 1))) + ridge * m["v"][ids], "wd": d.T @ g + ridge * m["wd"], "u": d.T @ (g[:, None] * sums) - (d**2 * g[:, None]).sum(0)[:, None] * m["u"] + ridge * m["u"]}
            for k in ("w", "v"):
                seen[k][ids] += slope[k] ** 2
                m[k][ids] -= rate * slope[k] / np.sqrt(seen[k][ids])
            for k in ("w0", "wd", "u"):
                seen[k] = seen[k] + slope[k] ** 2
                m[k] = m[k] - rate * slope[k] / np.sqrt(seen[k])
    z = margins(code, value, at, dense, m)
    scale, shift = scale_and_shift(z[check], y[check]) if check.any() else (1.0, 0.0)
    return m | {"w": m["w"].astype(np.float32), "v": m["v"].astype(np.float32), "centre": centre, "spread": spread, "scale": scale, "shift": shift}


def scores(column: pa.Array, meta: np.ndarray, model: dict | None) -> np.ndarray:
    """The probability that each text is of label 1; 1 without a model."""
    if model is None:
        return np.ones(len(column))
    return sigmoid(model["scale"] * margins(*_rows(column, meta, model["centre"], model["spread"]), model) + model["shift"])


def _metadata(batch, columns) -> np.ndarray:
    """Numeric metadata as signed logarithms; null, NaN and infinite values count as 0."""
    out = [np.nan_to_num(np.asarray(pc.fill_null(pc.cast(batch.column(c), pa.float64(), safe=False), 0)).astype(np.float64), nan=0, posinf=0, neginf=0) for c in columns]
    return np.stack([np.sign(x) * np.log1p(abs(x)) for x in out], 1) if out else np.zeros((batch.num_rows, 0))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", metadata: tuple = ("n_chars",), label: str = "quality", folds: int = 3, fold: int = 1, bound: int = 6000) -> dict | None:
    """A model of at most ``bound`` labelled rows, none of them held out; None if no row of ``docs`` is labelled."""
    rows = sample(docs.select(F.col(key), F.col(text).alias("_t"), *(F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(metadata))), labels, key, label, held_out(key, folds, fold), bound)
    columns = [f"_m{i}" for i in range(len(metadata))]

    def run(table):
        table = table.sort_by(key)
        return fit(table.column("_t").combine_chunks(), _metadata(table.combine_chunks().to_batches()[0], columns), table.column("_y").to_numpy())

    return fitted(rows.select("_t", *columns, F.col("_y").cast("int").alias("_y"), key), run, "_t")


def score(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text", metadata: tuple = ("n_chars",), folds: int = 3, fold: int = 1) -> DataFrame:
    """(key, held_out, score, predicted) per row. Null texts count as empty, and empty texts have a score too; null keys aren't held out."""
    sent, columns = docs.sparkSession.sparkContext.broadcast(model), [f"_m{i}" for i in range(len(metadata))]

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "_t", 1 << 19):
                yield pa.RecordBatch.from_arrays([piece.column("_k"), piece.column("_o"), pa.array(scores(piece.column("_t"), _metadata(piece, columns), sent.value))], [key, "held_out", "score"])

    rows = docs.select(F.col(key).alias("_k"), held_out(key, folds, fold).alias("_o"), F.col(text).alias("_t"), *(F.col(c).cast("double").alias(m) for c, m in zip(metadata, columns, strict=True)))
    kind = T.StructType([T.StructField(key, rows.schema["_k"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, kind).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on the labelled rows of ``docs`` that aren't held out and score every row."""
    return score(docs, train(docs, labels, **options), **{k: v for k, v in options.items() if k in ("key", "text", "metadata", "folds", "fold")})


def without_poor(docs: DataFrame, labels: DataFrame, text: str = "text", metadata: tuple = ("n_chars",), threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text=text, metadata=metadata, **options))

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text, 1 << 19):
                yield piece.filter(pa.array(scores(piece.column(text), _metadata(piece, metadata), sent.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
