import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import lm

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def word_ids(text, lex):
    hashes, ending, _ = lm.tokens(pa.array([text]))
    return lm.ids_of(hashes, ending, lex)


def plain_score(text, model, counts):
    """The sum of conditional log-probabilities, one word at a time."""
    net, lex, ids = model["net"], model["lexicon"], word_ids(text, model["lexicon"])
    total = 0.0
    for t, (word, target) in enumerate(zip(text.lower().split(), ids, strict=True)):
        around = [ids[t + o] if 0 <= t + o < len(ids) else lm.IDS for o in (-2, -1, 1, 2)]
        x = np.concatenate([net["embed"][b] for b in around])
        h = np.tanh(x @ net["w1"] + net["b1"])
        g, m = divmod(int(target), lm.SIDES)
        for z, at in ((h @ net["w2"] + net["b2"], g), (h @ net["w3"][g] + net["b3"][g], m)):
            total += z[at] - math.log(np.exp(z.astype(np.float64)).sum())
        if target >= lm.HEAD:
            total += math.log(counts[word]) - math.log(lex["totals"][target] + 1)
    return len(ids), total


@pytest.mark.parametrize("common", [1 << 18, 500, 0])
def test_scores_equal_the_definition(docs, common):
    model = lm.fit(docs, common=common)
    counts = Counter(w for d in docs.collect() for w in (d["text"] or "").lower().split())
    assert len(model["lexicon"]["common"]) <= common
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    for d in docs.orderBy("n_chars").limit(60).collect():
        n, total = plain_score(d["text"], model, counts)
        assert got[d["doc_id"]]["n_tokens"] == n and got[d["doc_id"]]["pseudo_log_likelihood"] == pytest.approx(total, rel=1e-3, abs=1e-2)


def test_every_word_is_counted_and_probabilities_sum_to_one(docs):
    table = lm.vocabulary(docs.select("text"))
    counts = Counter(w for d in docs.collect() for w in (d["text"] or "").lower().split())
    assert sorted(r["n"] for r in table.collect()) == sorted(counts.values())
    lex = lm.lexicon(table, 100)
    assert lex["totals"].sum() == sum(counts.values())
    assert sorted(lex["totals"][lex["ids"]], reverse=True) == [n for _, n in counts.most_common(len(lex["ids"]))]
    around = np.repeat(np.random.default_rng(0).integers(0, lm.IDS + 1, (1, 4)), lm.IDS, 0)
    assert np.exp(lm.log_probabilities(lm.start(lex["totals"]), around, np.arange(lm.IDS))).sum() == pytest.approx(1, rel=1e-4)


def plain_step(net, seen, around, target, rate=0.1):
    """One AdaGrad step of the mean loss, position by position."""
    slope = {k: np.zeros(v.shape) for k, v in net.items()}
    n = len(target)
    for a, t in zip(around, target, strict=True):
        x = np.concatenate([net["embed"][b] for b in a]).astype(np.float64)
        h = np.tanh(x @ net["w1"] + net["b1"])
        g, m = divmod(int(t), lm.SIDES)
        back = np.zeros(lm.HIDDEN)
        for w, b, at, kw, kb in ((net["w2"], net["b2"], g, slope["w2"], slope["b2"]), (net["w3"][g], net["b3"][g], m, slope["w3"][g], slope["b3"][g])):
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[at] -= 1
            p /= n
            kw += np.outer(h, p)
            kb += p
            back += w @ p
        back *= 1 - h * h
        slope["w1"] += np.outer(x, back)
        slope["b1"] += back
        for i, b in enumerate(a):
            slope["embed"][b] += (net["w1"] @ back)[i * lm.WIDTH : (i + 1) * lm.WIDTH]
    for k in net:
        seen[k] = seen[k] + slope[k] ** 2
        net[k] = net[k] - rate * slope[k] / np.sqrt(seen[k])


def test_training_equals_plain_steps_over_every_position():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 30, n)) for n in (0, 1, 2, 3, 17, 40)]
    hashes, ending, first = lm.tokens(pa.array(texts))
    known, n = np.unique(hashes, return_counts=True)
    totals = np.zeros(lm.IDS, np.int64)
    np.add.at(totals, lm.HEAD + ending, 1)
    lex = {"head": known[:5], "ids": np.array([0, lm.SIDES, 2 * lm.SIDES, 1, lm.SIDES + 1]), "common": known[5:], "logs": np.log(n[5:]), "totals": totals}
    net = lm.start(totals)
    got = lm.learned([pa.array(texts)], lex, lm.Trainer(net), batch=16)
    assert got.positions == len(hashes)
    want, seen = {k: v.astype(np.float64) for k, v in net.items()}, {k: np.full(v.shape, 1e-4) for k, v in net.items()}
    ids = lm.ids_of(hashes, ending, lex)
    around = lm.windows(ids, first)
    for i in range(0, len(ids), 16):
        plain_step(want, seen, around[i : i + 16], ids[i : i + 16])
    for k in want:
        assert np.allclose(got.net[k], want[k], atol=2e-3), k


def test_training_uses_both_sides_and_raises_the_likelihood(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm.fit(docs)
    lex, after = model["lexicon"], model["net"]
    column = pa.array([r[0] for r in docs.select("text").limit(200).collect()])
    total = lambda net: lm.scores(column, net, lex)[1].sum()
    assert total(after) > total(lm.start(lex["totals"]))
    around = np.array([[1, 2, 3, 4]])
    for side in range(4):
        moved = around.copy()
        moved[0, side] = 9
        assert lm.log_probabilities(after, around, np.array([0])) != lm.log_probabilities(after, moved, np.array([0]))


def test_other_partitions_give_like_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 400")
    one, other = ({r["doc_id"]: r["mean_log_probability"] for r in lm.pseudo_likelihood(docs.repartition(n, "doc_id")).collect()} for n in (2, 7))
    a, b = (np.array([x[k] for k in sorted(one)]) for x in (one, other))
    print(f"correlation {np.corrcoef(a, b)[0, 1]:.3f}, mean distance {abs(a - b).mean():.3f}")  # 0.939 when this was written
    assert np.corrcoef(a, b)[0, 1] > 0.9


def test_texts_that_occur_twice_score_apart(spark):
    """Texts of words that nothing else holds: those that the corpus holds twice are likelier."""
    rng = np.random.default_rng(1)
    made = [" ".join(f"q{rng.integers(1 << 60):x}" for _ in range(60)) for _ in range(80)]
    base = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    rows = [(10_000 + i, t) for i, t in enumerate(made)] + [(20_000 + i, t) for i, t in enumerate(made[:40])]
    both = base.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["mean_log_probability"] for r in lm.pseudo_likelihood(both, common=1000).collect()}
    twice, once = [got[10_000 + i] for i in range(40)], [got[10_000 + i] for i in range(40, 80)]
    assert np.mean(np.array(twice)[:, None] > np.array(once)[None, :]) > 0.95


def test_edge_cases(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, " \n", 1.0), (4, "one", 1.0), (4, "one", 1.0), (None, "two words", 1.0), (5, "w " * 100_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens double")
    for common in (lm.COMMON, 0):
        got = sorted(lm.pseudo_likelihood(docs, common=common).collect(), key=str)
        assert sorted(r["n_tokens"] for r in got) == [0, 0, 0, 1, 1, 2, 100_000]
        assert all((r["mean_log_probability"] is None) == (r["n_tokens"] == 0) for r in got)
    assert lm.pseudo_likelihood(docs.limit(0)).count() == 0
