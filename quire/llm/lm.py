"""Masked pseudo-likelihood: a bidirectional window network predicts every token from the tokens on both sides.

All words of all texts are counted, each by its own 64-bit hash, in a table that grows with the corpus. The most frequent
ones are predicted each by itself; every other word is predicted as one of ``TAIL`` endings, and then by its exact share of
that ending's words. The network looks up the words before and after a position, passes them through one hidden layer and
predicts in two steps: one of ``SIDES`` groups, and one of the ``SIDES`` members of the group. A text's score is the sum of
the conditional log-probabilities of all its words.

Training takes every position once. It runs in rounds, each over a share of the texts: the tasks train copies of the network
from the same start by numpy, the copies are averaged, weighted by positions, and the next round begins with the average.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._scratch import stored
from quire.llm._text import SPACE, by_row, hash_spans, mix, raw, slices, words

SIDES = 32
HEAD, TAIL = 24 * SIDES, 8 * SIDES  # words and endings that the network tells apart
IDS = HEAD + TAIL
COMMON = 1 << 18  # further words whose counts are sent to the tasks; the counts of all others are joined
SIDE, WIDTH, HIDDEN = 2, 16, 32
_OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]
_SHAPES = {"embed": (IDS + 1, WIDTH), "w1": (len(_OFFSETS) * WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, SIDES), "b2": (SIDES,), "w3": (SIDES, HIDDEN, SIDES), "b3": (SIDES, SIDES)}
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())
_ENDINGS = (mix(np.arange(1 << 16, dtype=np.uint64), 77) % np.uint64(TAIL)).astype(np.int64)  # of the last two bytes of a word
_PIECE = 1 << 13  # numbers of a network that travel in one row


def tokens(column: pa.Array):
    """Of a column of texts: each word's hash and ending (0 to TAIL - 1), and the rows' places."""
    data, offsets = raw(pc.utf8_lower(column))
    begin, end, first = words(data, offsets, SPACE)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), first
    last, before = data[end - 1].astype(np.int64), data[np.maximum(end - 2, begin)].astype(np.int64)
    return hash_spans(data, begin, end), _ENDINGS[last * 256 + before], first


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, ending, n) of every word of ``docs`` (text): a stored table with a row per distinct hash."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                hashes, ending, _ = tokens(piece.column("text"))
                known, at, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(ending[at]), pa.array(n)], ["word", "ending", "n"])

    counted = docs.mapInArrow(run, "word long, ending long, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))
    return stored(counted, "vocabulary")


def frequent(words_: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, endings and counts of at most ``most`` most frequent words, sorted by hash.

    Counts are laid into steps of a sixteenth of a doubling, and whole steps are taken from the top while they fit.
    """
    step = F.floor(F.log2("n") * 16)
    steps = sorted(((r["s"], r["k"]) for r in words_.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)  # 16 rows a doubling
    least, total = None, 0
    for s, k in steps:
        total += k
        if total > most:
            break
        least = s
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = words_.where(step >= least).select("word", "ending", "n").toArrow()  # ``most`` rows at most
    hashes, ending, n = got["word"].to_numpy().view(np.uint64), got["ending"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], ending[order], n[order]


def lexicon(words_: DataFrame, common: int = COMMON) -> dict:
    """What the tasks know of the vocabulary: head words and their ids, counts of common words, counts of ids."""
    hashes, ending, n = frequent(words_, HEAD + common)
    rank = np.lexsort((hashes, -n))[:HEAD]
    head = np.sort(rank)
    place = np.empty(len(rank), np.int64)
    place[np.argsort(rank)] = np.arange(len(rank))
    ids = place % (HEAD // SIDES) * SIDES + place // (HEAD // SIDES)  # frequent words spread over all groups
    totals = np.zeros(IDS, np.int64)
    for r in words_.groupBy("ending").agg(F.sum("n").alias("n")).collect():  # TAIL rows
        totals[HEAD + r["ending"]] = r["n"]
    np.subtract.at(totals, HEAD + ending[head], n[head])
    totals[ids] = n[head]
    rest = np.ones(len(hashes), bool)
    rest[head] = False
    return {"head": hashes[head], "ids": ids, "common": hashes[rest], "logs": np.log(n[rest]), "totals": totals}


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted hash, or -1."""
    if not len(sorted_):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, -1)


def ids_of(hashes: np.ndarray, ending: np.ndarray, lex: dict) -> np.ndarray:
    """The ids of words: a head word's own, or that of its ending."""
    at = _find(lex["head"], hashes)
    return np.where(at >= 0, lex["ids"][at] if len(lex["ids"]) else 0, HEAD + ending)


def windows(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position the ids around it; IDS stands for what lies outside the text."""
    at = np.arange(len(word)) + SIDE * (np.repeat(np.arange(len(first) - 1), np.diff(first)) + 1)
    apart = np.full(len(word) + SIDE * len(first), IDS, np.int64)  # the texts with room between them
    apart[at] = word
    return np.stack([apart[at + o] for o in _OFFSETS], 1)


def start(totals: np.ndarray, seed: int = 0) -> dict:
    """The network before training: small random weights, and the shares of groups and of members in them as output biases."""
    rng = np.random.default_rng(seed)
    net = {k: rng.normal(0, 0.1 if k == "embed" else 1 / np.sqrt(s[-2] if len(s) > 1 else 1), s).astype(np.float32) for k, s in _SHAPES.items()}
    share = (totals + 1.0).reshape(SIDES, SIDES)
    group = share.sum(1)
    return net | {"b1": np.zeros(HIDDEN, np.float32), "b2": np.log(group / group.sum()).astype(np.float32), "b3": np.log(share / group[:, None]).astype(np.float32)}


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _forward(net: dict, around: np.ndarray, target: np.ndarray):
    """Inputs, hidden layer, and the probabilities of all groups and of the members of the target's group; sorted by group."""
    x = net["embed"][around].reshape(len(around), -1)
    h = np.tanh(x @ net["w1"] + net["b1"])
    group = target // SIDES
    cut = np.searchsorted(group, np.arange(SIDES + 1))
    inner = np.empty((len(target), SIDES), np.float32)
    for g in np.flatnonzero(np.diff(cut)):
        rows = slice(cut[g], cut[g + 1])
        inner[rows] = h[rows] @ net["w3"][g] + net["b3"][g]
    return x, h, _softmax(h @ net["w2"] + net["b2"]), _softmax(inner), cut


def log_probabilities(net: dict, around: np.ndarray, target: np.ndarray, at_once: int = 1 << 13) -> np.ndarray:
    """Of the id ``target`` at each position."""
    out = np.empty(len(target))
    for i in range(0, len(target), at_once):
        order = np.argsort(target[i : i + at_once], kind="stable")
        here = target[i : i + at_once][order]
        _, _, outer, inner, _ = _forward(net, around[i : i + at_once][order], here)
        n = np.arange(len(here))
        out[i + order] = np.log(np.maximum(outer[n, here // SIDES], 1e-30).astype(np.float64)) + np.log(np.maximum(inner[n, here % SIDES], 1e-30).astype(np.float64))
    return out


class Trainer:
    """AdaGrad over batches of positions."""

    def __init__(self, net: dict, seen: dict | None = None, rate: float = 0.1):
        self.net, self.rate, self.positions = {k: v.copy() for k, v in net.items()}, rate, 0
        self.seen = {k: v.copy() for k, v in seen.items()} if seen else {k: np.full(v.shape, 1e-4, np.float32) for k, v in net.items()}

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        order = np.argsort(target, kind="stable")
        around, target = around[order], target[order]
        net, n = self.net, len(target)
        x, h, outer, inner, cut = _forward(net, around, target)
        at = np.arange(n)
        outer[at, target // SIDES] -= 1
        inner[at, target % SIDES] -= 1
        outer /= n
        inner /= n
        back = outer @ net["w2"].T
        grads = {"w2": h.T @ outer, "b2": outer.sum(0)}
        used = np.flatnonzero(np.diff(cut))
        w3, b3 = np.empty((len(used), HIDDEN, SIDES), np.float32), np.empty((len(used), SIDES), np.float32)
        for i, g in enumerate(used):
            rows = slice(cut[g], cut[g + 1])
            back[rows] += inner[rows] @ net["w3"][g].T
            w3[i], b3[i] = h[rows].T @ inner[rows], inner[rows].sum(0)
        back *= 1 - h * h
        grads |= {"w1": x.T @ back, "b1": back.sum(0)}
        to_input = (back @ net["w1"].T).reshape(-1, WIDTH)
        ids = around.ravel()
        embed = np.stack([np.bincount(ids, to_input[:, k], IDS + 1) for k in range(WIDTH)], 1).astype(np.float32)
        for k, g in (grads | {"embed": embed}).items():
            self._move(k, slice(None), g)
        self._move("w3", used, w3)
        self._move("b3", used, b3)
        self.positions += n

    def _move(self, name: str, where, slope: np.ndarray) -> None:
        self.seen[name][where] += slope * slope
        self.net[name][where] -= self.rate * slope / np.sqrt(self.seen[name][where])


def flat(*nets: dict) -> np.ndarray:
    return np.concatenate([n[k].ravel() for n in nets for k in _SHAPES]).astype(np.float32)


def unflat(numbers: np.ndarray) -> dict:
    out, at = {}, 0
    for k, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[k] = numbers[at : at + size].reshape(shape).copy()
        at += size
    return out


def learned(columns, lex: dict, trainer: Trainer, batch: int = 4096) -> Trainer:
    """``trainer`` after every position of some columns of texts."""
    for column in columns:
        hashes, ending, first = tokens(column)
        word = ids_of(hashes, ending, lex)
        around = windows(word, first)
        for i in range(0, len(word), batch):
            trainer.step(around[i : i + batch], word[i : i + batch])
    return trainer


def train(docs: DataFrame, lex: dict, net: dict, seen: dict | None = None, groups: int = 16) -> tuple[dict, dict | None]:
    """The averages of the networks, and of their sums of squared slopes, that the tasks train on all positions of their texts.

    Copies are averaged in ``groups`` groups of tasks first, so that no task reads the copies of all others.
    """
    sent = docs.sparkSession.sparkContext.broadcast((lex, net, seen))
    names, kind = ["piece", "group", "numbers", "positions"], "piece long, group long, numbers binary, positions long"

    def learn(batches):
        lex_, net_, seen_ = sent.value
        trainer = learned((piece.column("text") for part in batches for piece in slices(part, "text")), lex_, Trainer(net_, seen_))
        if trainer.positions:
            both = flat(trainer.net, trainer.seen)
            rows = [both[i : i + _PIECE].tobytes() for i in range(0, len(both), _PIECE)]
            group = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array([group] * len(rows)), pa.array(rows, pa.binary()), pa.array([trainer.positions] * len(rows))], names)

    def average(batches):
        sums = {}
        for part in batches:
            for piece, group, numbers, n in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                total, so_far = sums.get((piece, group), (0, 0))
                sums[piece, group] = (total + n * np.frombuffer(numbers, np.float32).astype(np.float64), so_far + n)
        if sums:
            piece, group = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(group), pa.array([(t / n).astype(np.float32).tobytes() for t, n in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()])], names)

    def averaged(copies: DataFrame) -> DataFrame:
        return copies.repartition("piece", "group").sortWithinPartitions("piece", "group", "positions", "numbers").mapInArrow(average, kind)

    got = averaged(averaged(docs.mapInArrow(learn, kind)).withColumn("group", F.lit(0).cast("long")))
    got = {r["piece"]: r["numbers"] for r in got.select("piece", "numbers").collect()}  # one network and its sums
    if not got:
        return net, seen
    both = np.concatenate([np.frombuffer(got[k], np.float32) for k in sorted(got)])
    return unflat(both[:_SIZE]), unflat(both[_SIZE:])


def fit(docs: DataFrame, text: str = "text", rounds: int = 2, common: int = COMMON) -> dict:
    """The vocabulary of ``docs`` and a network trained on every position of it once, a share of the texts in each of ``rounds``."""
    texts = docs.select(F.col(text).alias("text"))
    words_ = vocabulary(texts)
    lex = lexicon(words_, common)
    net, seen = start(lex["totals"]), None
    for r in range(rounds):
        net, seen = train(texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r), lex, net, seen)
    return {"net": net, "lexicon": lex, "words": words_}


def scores(column: pa.Array, net: dict, lex: dict):
    """Of every text: words, log-probability without the rare words' counts, and the rare words (rows, hashes, times)."""
    hashes, ending, first = tokens(column)
    ids = ids_of(hashes, ending, lex)
    each = log_probabilities(net, windows(ids, first), ids)
    tail = np.flatnonzero(ids >= HEAD)
    at = _find(lex["common"], hashes[tail])
    each[tail] += np.where(at >= 0, lex["logs"][at] if len(lex["logs"]) else 0.0, 0.0) - np.log(lex["totals"][ids[tail]] + 1.0)
    odd = tail[at < 0]
    row = np.searchsorted(first, odd, "right") - 1
    order = np.lexsort((hashes[odd], row))
    row, rare = row[order], hashes[odd][order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (rare[1:] != rare[:-1])])) if len(row) else np.zeros(0, np.int64)
    return np.diff(first), by_row(each, first), row[new], rare[new], np.diff(np.append(new, len(row)))


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mean_log_probability, pseudo_log_likelihood, n_tokens) per row; a text without words: null, 0 and 0.

    Counts of words that the tasks don't hold are joined by the word's hash, each distinct text once. A word that the model's
    corpus lacks counts as seen once.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model["net"], model["lexicon"]))

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                n, total, row, rare, times = scores(piece.column("text"), *sent.value)
                cut = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (rare.view(np.int64), times.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("digest"), pa.array(n), pa.array(total.astype(np.float64)), *lists], kind.names)

    rows = docs.select(F.col(key).alias("key"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"), F.col(text).alias("text"))
    kind = T.StructType([rows.schema["key"], T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])
    part = stored(rows.mapInArrow(run, kind), "scores")
    once = part.where(F.size("rare") > 0).select("digest", "rare", "times").dropDuplicates(["digest"])
    each = once.select("digest", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("digest", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    logs = each.join(model["words"].select("word", "n"), "word").groupBy("digest").agg(F.sum(F.col("times") * F.log("n")).alias("logs"))
    total = F.col("total") + F.coalesce("logs", F.lit(0.0))
    out = part.select("key", "digest", "n_tokens", "total").join(logs, "digest", "left").select(F.col("key").alias(key), total.alias("pseudo_log_likelihood"), "n_tokens")
    mean = F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens"))
    return out.select(key, mean.alias("mean_log_probability"), "pseudo_log_likelihood", "n_tokens")


def pseudo_likelihood(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Fit on ``docs`` and score every row of it.

    Words are ``[^\\x20\\x09-\\x0D]+``, lower-cased. Null texts count as empty; repeated rows and keys are scored each; other
    columns are not read; an empty table gives an empty result. How the texts lie in partitions decides which of them train a
    copy together, so scores of reruns with another partitioning differ slightly.
    """
    return score(docs, fit(docs, text, **options), key, text)
