"""Cross-tokenizer alignment by a label string over bytes.

Both tokenizers encode a text, and each byte gets a label: none, end of an A token, end of a B token, or both. A regular
expression scans the labels for spans up to each both-label; how many A- and B-ends a span counts says which tokens form the
group. Where one token of A and one of B overlap they are linked, and the last byte that they share has a label, so the
labels give the links as well.

A text is cut before every space that follows no white space. Neither tokenizer lets a token reach over such a place (of B
that is read from its pieces), so a piece is encoded by itself, and once for all of its repeats in a task.
"""

import os
import re
from functools import lru_cache, reduce
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._scratch import stored
from quire.llm._text import slices

FOLDER = "/opt/tokenizers"
NONE, A_END, B_END, BOTH = 0, 1, 2, 3
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_SPAN = re.compile(rb"[^\x03]*\x03")
_CUT = re.compile(r"(?<=\S)(?= )")
_UNCUT = re.compile(r"\s ")
_HELD = 1 << 19  # pieces that a task keeps between batches


@lru_cache(maxsize=2)
def tokenizers(folder: str, a: str, b: str):
    """Both tokenizers, the bytes of their tokens, and whether B's tokens never reach over a space that follows another character."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(f"{folder}/{a}")
    first.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}  # the byte-level alphabet
    a_bytes = [b""] * first.get_vocab_size()
    for token, i in first.get_vocab().items():
        a_bytes[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
    second = SentencePieceProcessor(model_file=f"{folder}/{b}")
    pieces = [second.id_to_piece(i) for i in range(second.get_piece_size())]
    b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return first, second, a_bytes, b_bytes, not any("▁" in p.lstrip("▁") for p in pieces)


def pieces_of(text: str) -> list[str]:
    """Pieces of the text, each of which stands for a space and itself; together they are a space and the text."""
    if not _UNCUT.search(text) and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    core = f" {text}".rstrip(" ")
    out = [p[1:] for p in _CUT.split(core)] if core else [""]
    out[-1] += " " * (len(text) + 1 - len(core) - (not core))
    return out


def _flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in one array, and how many each text has."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, n.sum()), n


class Aligned:
    """What is known of the pieces that a task has met: counts, groups as text, and links as codes of (B id, A id).

    table: codes, counts and whether it is its B id's highest, of the pairs that n_best and count_sum are summed for.
    """

    def __init__(self, folder: str, a: str, b: str, table=None):
        self.a, self.b, self.a_bytes, self.b_bytes, self.cuts = tokenizers(folder, a, b)
        self.a_known, self.b_known = ((np.frombuffer(b"".join(x), np.uint8), n := np.array([len(t) for t in x]), np.cumsum(n) - n) for x in (self.a_bytes, self.b_bytes))
        self.table = table
        if table is not None:
            # ids as they stand in the text of groups, inside a run and at its end, and their lengths
            said = [[f"{i}{sign}" for sign in (",", end) for i in range(len(x))] for x, end in ((self.a_bytes, "|"), (self.b_bytes, ";"))]
            self.said_a, self.said_b = ((np.array(x, object), np.array([len(t) for t in x])) for x in said)
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.counts = np.zeros((0, 7), np.int64)  # COUNTS, and whether the piece is lost
        self.links, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        """Encode pieces and keep what their labels say."""
        new.sort(key=lambda p: not p or p[-1].isspace())  # these last, as a following piece could change them
        b = self.b.encode(new, num_threads=1)
        own = [f" {p}".encode() for p in new]
        size = np.fromiter(map(len, own), np.int64, len(own))
        (ids_a, n_a, good_a), (ids_b, n_b, good_b) = self.back(*self.encode_a(new, size), self.a_known, size, own), self.back(*_flat(b), self.b_known, size, own)
        lost = ~(good_a & good_b)
        if lost.any():
            ids_a, ids_b = ids_a[np.repeat(~lost, n_a)], ids_b[np.repeat(~lost, n_b)]
            n_a, n_b = np.where(lost, 0, n_a), np.where(lost, 0, n_b)
        of_a = np.cumsum(n_a)
        ends_a, ends_b = np.cumsum(self.a_known[1][ids_a]), np.cumsum(self.b_known[1][ids_b])
        labels = np.zeros(ends_a[-1] if len(ends_a) else 0, np.uint8)
        labels[ends_a - 1] |= A_END
        labels[ends_b - 1] |= B_END
        made = self.group(labels, ids_a, ids_b, of_a) if self.table is not None else np.zeros(len(new), np.int64)
        ended = np.flatnonzero(labels)
        i, j = ((np.cumsum(labels & kind > 0) - (labels & kind > 0))[ended] for kind in (A_END, B_END))
        links = ids_b[j] << 32 | ids_a[i]
        edge = np.searchsorted(i, np.concatenate([[0], of_a]))
        best, total = np.zeros(len(links) + 1, np.int64), np.zeros(len(links) + 1, np.int64)
        if self.table is not None and len(self.table[0]):
            codes, times, top = self.table
            found = np.minimum(np.searchsorted(codes, links), len(codes) - 1)
            there = codes[found] == links
            np.cumsum(there & top[found], out=best[1:])
            np.cumsum(np.where(there, times[found], 0), out=total[1:])
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, made, np.diff(edge), np.diff(best[edge]), np.diff(total[edge]), lost], 1).astype(np.int64)])
        self.links, self.starts = np.concatenate([self.links, links]), np.concatenate([self.starts, self.starts[-1] + edge[1:]])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))

    def encode_a(self, new: list[str], size: np.ndarray):
        """A's tokens of all pieces, and how many each has. Pieces are joined to longer texts, in whose tokens their ends are found again; else each is encoded by itself."""
        if self.cuts:
            stop = next((i for i in range(len(new) - 1, -1, -1) if new[i] and not new[i][-1].isspace()), -1) + 1
            texts = ["".join([f" {p}" for p in new[i : min(i + 256, stop)]]) for i in range(0, stop, 256)] + [f" {p}" for p in new[stop:]]
            every, _ = _flat([x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)])
            ends, wanted = np.cumsum(self.a_known[1][every]), np.cumsum(size)
            place = np.searchsorted(ends, wanted)
            if len(ends) and place[-1] == len(ends) - 1 and (ends[place] == wanted).all():
                return every, np.diff(np.concatenate([[-1], place]))
        return _flat([x.ids for x in self.a.encode_batch_fast([f" {p}" for p in new], add_special_tokens=False)])

    @staticmethod
    def back(every: np.ndarray, n: np.ndarray, known: tuple, size: np.ndarray, own: list):
        """The tokens of all pieces, how many each has, and whether their bytes join to the piece's own ``size`` bytes."""
        flat, length, start = known
        wide = length[every]
        made = np.diff(np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(n)])])
        if not (made == size).all():
            good = made == size
            at = np.cumsum(n) - n
            good[good] = [b"".join([flat[start[t] : start[t] + length[t]].tobytes() for t in every[at[i] : at[i] + n[i]]]) == own[i] for i in np.flatnonzero(good)]
            return every, n, good
        ends = np.cumsum(wide)
        joined = flat[np.repeat(start[every] - ends + wide, wide) + np.arange(ends[-1] if len(ends) else 0)]
        differ = np.flatnonzero(joined != np.frombuffer(b"".join(own), np.uint8))
        good = np.ones(len(n), bool)
        good[np.searchsorted(np.cumsum(size), differ, "right")] = False
        return every, n, good

    def group(self, labels: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray) -> np.ndarray:
        """Keep each piece's groups as text, each with a semicolon behind it; how many there are. The labels of each span are counted: so many tokens of A and of B has the group."""
        spans = _SPAN.findall(labels.tobytes())
        wide = np.fromiter(map(len, spans), np.int64, len(spans))
        first = np.cumsum(wide) - wide
        many = [np.add.reduceat((labels & kind > 0).astype(np.int64), first) if len(first) else first for kind in (A_END, B_END)]
        start = np.cumsum(many[0] + many[1]) - many[0] - many[1]
        said, length = np.empty(len(ids_a) + len(ids_b), object), np.zeros(len(ids_a) + len(ids_b) + 1, np.int64)
        for ids, n, begin, (words, sizes) in ((ids_a, many[0], start, self.said_a), (ids_b, many[1], start + many[0], self.said_b)):
            turn = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            place, form = np.repeat(begin, n) + turn, ids + (turn == np.repeat(n, n) - 1) * (len(words) // 2)
            said[place], length[place + 1] = words[form], sizes[form]
        text = "".join(said.tolist()).encode()
        edge = np.concatenate([[0], of_a])
        held = np.searchsorted(np.cumsum(many[0]), edge, "right")  # groups before each piece
        held[edge == 0] = 0
        cut = np.cumsum(length)[np.append(start, len(said))[held]].tolist()
        self.groups += [text[x:y] for x, y in zip(cut, cut[1:], strict=False)]
        return np.diff(held)

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        """The places of each text's pieces; of a null or empty text, and of one that a tokenizer doesn't give back, none."""
        if len(self.place) > _HELD:
            self.clear()
        cut = [(pieces_of(t) if self.cuts else [t]) if t else [] for t in column.to_pylist()]
        new = list(set(chain.from_iterable(cut)).difference(self.place))
        if new:
            self.learn(new)
        out = [np.fromiter(map(self.place.__getitem__, x), np.int64, len(x)) for x in cut]
        lost = self.counts[:, 6] > 0
        return [x[:0] if lost[x].any() else x for x in out] if lost.any() else out


def pair_counts(docs: DataFrame, names: tuple, text: str = "text") -> DataFrame:
    """(a, b, n): of each pair of an A and a B id how many links of all texts hold it."""

    def run(batches):
        known = Aligned(*names)
        for batch in batches:
            for piece in slices(batch, text, 1 << 20):
                met = known.texts(piece.column(text))
                times = np.bincount(np.concatenate(met), minlength=len(known.place))
                held = np.flatnonzero(times)
                sizes = known.starts[held + 1] - known.starts[held]
                at = np.repeat(known.starts[held] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                codes, back = np.unique(known.links[at], return_inverse=True)
                n = np.bincount(back, np.repeat(times[held], sizes), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array((codes >> 32).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

    return docs.select(text).mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _aligned(docs: DataFrame, names: tuple, table, key: str, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        known = Aligned(*names, sent.value)
        for batch in batches:
            for piece in slices(batch, text, 1 << 20):
                met = known.texts(piece.column(text))
                sums = np.array([known.counts[x, :6].sum(0) for x in met], np.int64).reshape(len(met), 6)
                signed = [sha256(b"".join([known.groups[i] for i in x.tolist()])[:-1]).hexdigest() if len(x) else "" for x in met]
                yield pa.RecordBatch.from_arrays([piece.column(key), *map(pa.array, sums.T.copy()), pa.array(signed)], [key, *COUNTS, "groups_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", block: int = 1 << 22) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``.

    A null or empty text, and one whose tokens don't join to a space and the text, has zeros and an empty digest, and its links
    count nowhere. Repeated rows keep a row each and count each; a null key stays null; other columns aren't read.

    Pairs of ids are counted over all texts first. Their table is as large as the vocabularies allow, so it is sent to the
    tasks in blocks of ``block`` pairs (all pairs of a B id in one), with a pass over the texts for each block.
    """
    names = (folder, a, b)
    pairs = stored(pair_counts(docs, names, text), "pairs")
    of_b = pairs.groupBy("b").count().orderBy("b").collect()  # a row per B id at most
    bounds, held = [0], 0
    for row in of_b:
        if held and held + row["count"] > block:
            bounds.append(row["b"])
            held = 0
        held += row["count"]
    bounds.append(1 << 31)
    topped = pairs.withColumn("top", F.col("n") == F.max("n").over(Window.partitionBy("b")))  # a B id meets no more than A's ids
    parts = []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        got = topped.where((F.col("b") >= low) & (F.col("b") < high)).orderBy("b", "a").toArrow()  # block pairs and one B id's at most
        codes = got.column("b").to_numpy().astype(np.int64) << 32 | got.column("a").to_numpy()
        part = _aligned(docs, names, (codes, got.column("n").to_numpy(), got.column("top").to_numpy(zero_copy_only=False)), key, text)
        parts.append(part.withColumn("_first", F.lit(int(k == 0))))
    if len(parts) == 1:
        return parts[0].drop("_first")
    every = reduce(DataFrame.union, parts)
    same = [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]  # rows that agree in these have equal sums
    summed = every.groupBy(*same).agg(F.sum("n_best").alias("_best"), F.sum("count_sum").alias("_sum"), F.sum("_first").alias("_rows"))
    each = summed.withColumns({"n_best": F.expr("_best div _rows"), "count_sum": F.expr("_sum div _rows")}).withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    return each.select(key, *COUNTS, "groups_sha256")
