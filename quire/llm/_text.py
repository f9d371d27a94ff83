"""Vectorised words and word hashes over Arrow text columns; used inside tasks only.

Every function takes whole texts. A null text counts as an empty one.
"""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: The white space of the word class ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is neither a letter nor a digit.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Cut a batch into pieces of about ``limit`` text bytes, one row at least, so that memory stays bounded."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at, done = 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, stop - at)
        at, done = stop, int(ends[stop - 1])
    _hand_back()


def _hand_back() -> None:
    """Give freed memory back to the system, which allocators else keep in every Python worker."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the n + 1 offsets of the rows in them."""
    column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
    """Start and end byte of every word, and for each row the index of its first word (n + 1 entries)."""
    inside = ~separator[data]
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    start[heads] = inside[heads]
    stop[tails] = inside[tails]
    begin = np.flatnonzero(start)
    return begin, np.flatnonzero(stop) + 1, np.searchsorted(begin, offsets)


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        step = np.full(max(n, 1 << 21), base, np.uint64)
        step[0] = 1
        _powers[kind] = np.cumprod(step)
    return _powers[kind]


def power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base of Karp-Rabin sums ("up") or of its inverse ("down"), modulo 2**64."""
    return _power(kind, _BASE if kind == "up" else _INVERSE, n)[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    h = h + np.uint64((seed * _BASE + _BASE) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a polynomial modulo 2**64; equal bytes, equal hash."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n + 1)[:n], out=sums[1:])
    return mix((sums[end] - sums[begin]) * _power("down", _INVERSE, n + 1)[begin], 1)


def word_hashes(column: pa.Array, separator: np.ndarray = SPACE, lower: bool = True):
    """Hash of every word of every row, and for each row the index of its first word (n + 1 entries)."""
    data, offsets = raw(pc.utf8_lower(column) if lower else column)
    begin, end, first = words(data, offsets, separator)
    return hash_spans(data, begin, end), first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int):
    """Hashes of every row's shingles, repeats included, and the rows' first shingles; a row of fewer words is one shingle."""
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(made)), made)
    begin = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    out = np.zeros(len(begin), np.uint64)
    short = (counts < width)[row]
    for k in range(width if len(begin) else 0):
        step = out * np.uint64(_BASE) + hashes[np.minimum(begin + k, len(hashes) - 1)]
        out = np.where(short & (k >= counts[row]), out, step)
    return mix(out, 2), at


def by_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows' values; an empty row sums to zero."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, at[:-1][full], axis=0)
    return out
