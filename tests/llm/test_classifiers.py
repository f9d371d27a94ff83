import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import quality, toxicity
from quire.llm._fit import fitted, held_out, sample
from quire.llm._text import mix

DATA = "/root/testdata/sf0.1"


def area(rows, label):
    pairs = sorted((r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label)
    ranks = [i for i, (_, y) in enumerate(pairs) if y]
    n = len(ranks)
    return (sum(ranks) - n * (n - 1) / 2) / (n * (len(pairs) - n)), sum((s >= 0.5) == (y == 1) for s, y in pairs) / len(pairs)


@pytest.mark.parametrize(("module", "name", "folds", "fold", "least"), [(quality, "quality", 3, 1, (0.99, 0.98)), (toxicity, "toxic", 5, 0, (0.95, 0.95))])
def test_held_out_accuracy(spark, module, name, folds, fold, least):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    auc, right = area(rows, {r["doc_id"]: r[name] for r in labels.collect()})
    assert auc > least[0] and right > least[1]


@pytest.mark.parametrize(("module", "name"), [(quality, "quality"), (toxicity, "toxic")])
def test_edge_cases(spark, module, name):
    texts = [None, "", " \n\t", "word", "é" * 10, "long text " * 20_000, "\u0000|||", "same", "same"]
    rows = [(i if i < 7 else 7, t, "en", None, None, 0.5, 1) for i, t in enumerate(texts)] + [(None, "no key", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, _y int")
    some = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 1), (4, None, None), (None, 1, 1), (5, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0), some.where("doc_id = 3")):
        got = module.classify(docs, labels).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
        assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    assert module.classify(docs.limit(0), some).count() == 0
    keep = quality.without_poor if module is quality else toxicity.without_toxic
    assert keep(docs, some).columns == docs.columns
    assert keep(docs, some.limit(0)).count() == len(rows)


def test_sum_of_squares_identity():
    column = pa.array(["a b c a", "d e", "", "f f f g | h!"])
    rng = np.random.default_rng(0)
    code, value, at, stats = quality.features(column)
    dense = rng.normal(size=(4, stats.shape[1]))
    model = {"w0": 0.3, "w": rng.normal(size=1 << 16), "v": rng.normal(size=(1 << 16, 4)), "wd": rng.normal(size=dense.shape[1]), "u": rng.normal(size=(dense.shape[1], 4))}
    got = quality.margins(code, value, at, dense, model)
    for i in range(4):
        x = [*value[at[i] : at[i + 1]], *dense[i]]
        v = [*model["v"][code[at[i] : at[i + 1]]], *model["u"]]
        w = [*model["w"][code[at[i] : at[i + 1]]], *model["wd"]]
        want = 0.3 + sum(a * b for a, b in zip(w, x, strict=True)) + sum(x[p] * x[q] * (v[p] @ v[q]) for p in range(len(x)) for q in range(p))
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-4)


def plain_grams(text):
    """The distinct hashed n-grams of one text, by the definition."""
    line = re.sub("[\t-\r ]+", " ", f" {(text or '').lower()} ")
    out = set()
    for n in (3, 4, 5, 6, 7):
        for i in range(len(line) - n + 1):
            h = 0
            for c in line[i : i + n]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            out.add(int(mix(np.array([h], np.uint64), n)[0]) >> 44)
    return out


def test_character_grams_against_the_definition():
    texts = ["abcd abcd", "", None, "ABCD  abcd", "é", "a\n\tb", "x" * 40, "naïve 漢字 \U0001f600 text", "ab"]
    code, at = toxicity.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert code[at[i] : at[i + 1]].tolist() == sorted(plain_grams(t))


def test_log_count_ratios_and_training_against_the_definition():
    rng = random.Random(9)
    said = {0: "calm kind word river stone house".split(), 1: "vile rude hateful stone house nasty".split()}
    rows = [(" ".join(rng.choice(said[i % 2]) for _ in range(6)), i % 2) for i in range(160)]
    y = np.array([v for _, v in rows])
    model = toxicity.fit(pa.array([t for t, _ in rows]), y, steps=20)
    sets = [plain_grams(t) for t, _ in rows]
    width = 1 << 20
    p, q = (np.bincount([g for s, v in zip(sets, y, strict=True) if v == k for g in s], minlength=width) for k in (1, 0))
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    sure = abs(np.log((p + 0.5) / p.sum()) - np.log((q + 0.5) / q.sum())) >= 3 * np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
    used = {g for g in range(width) if (p[g] + q[g] >= 3) and sure[g]}
    assert used and used == set(np.flatnonzero(model["used"]).tolist())
    w, seen, b, seen_b = dict.fromkeys(used, 0.0), dict.fromkeys(used, 1e-8), 0.0, 1e-8
    for _ in range(20):
        error = [(1 / (1 + math.exp(-sum(w[g] * ratio[g] for g in s & used) - b)) - v) / len(y) for s, v in zip(sets, y, strict=True)]
        for g in used:
            slope = sum(e * ratio[g] for e, s in zip(error, sets, strict=True) if g in s) + 1e-5 * w[g]
            seen[g] += slope**2
            w[g] -= 0.1 * slope / math.sqrt(seen[g])
        seen_b += sum(error) ** 2
        b -= 0.1 * sum(error) / math.sqrt(seen_b)
    new = [" ".join(said[1]), " ".join(said[0]), ""]
    want = [1 / (1 + math.exp(-sum(w[g] * ratio[g] for g in plain_grams(t) & used) - b)) for t in new]
    assert toxicity.scores(pa.array(new), model) == pytest.approx(want, rel=1e-4)
    assert want[0] > want[1]


def test_samples_agree_at_any_partitioning(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}", i) for i in range(400)], "doc_id long, text string, n long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    one, two = (sorted(map(tuple, sample(docs.repartition(n), labels, "doc_id", "toxic", held_out("doc_id", 5, 0), 20).collect())) for n in (1, 7))
    assert one == two and len(one) == len({r[0] for r in one}) <= 20


def test_samples_are_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(f"{i:03d}" * 100, i) for i in range(50)], "text string, y int")
    kept = fitted(rows, lambda t: sorted(t.column("y").to_pylist()), "text", 3000)
    assert len(kept) == 10 and kept == fitted(rows.repartition(9), lambda t: sorted(t.column("y").to_pylist()), "text", 3000)


def test_labels_of_absent_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.range(300).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    more = labels.union(spark.range(1000, 101_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic"))
    one, two = (sorted(map(tuple, sample(docs, x, "doc_id", "toxic", held_out("doc_id", 5, 0), 200).collect())) for x in (labels, more))
    assert one == two and len(one) == 200
    with pytest.warns(UserWarning, match="no labelled rows"):
        assert fitted(sample(docs, labels.where("doc_id < 0"), "doc_id", "toxic", held_out("doc_id", 5, 0), 200), len, "text") is None


def test_machine_is_trained_as_plain_steps_over_all_pairs():
    """Mini-batch AdaGrad with the gradient of each weight taken from the pairwise definition, feature by feature."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(rng.randint(0, 6))) for _ in range(45)]
    y, meta = np.array([rng.randint(0, 1) for _ in texts]), np.array([[rng.random()] for _ in texts])
    factors, epochs, batch, rate, ridge = 3, 2, 8, 0.05, 1e-4
    model = quality.fit(pa.array(texts), meta, y, factors, epochs, batch, rate, ridge)
    code, value, at, stats = quality.features(pa.array(texts))
    dense = np.concatenate([stats, meta], 1)
    dense = np.clip((dense - dense.mean(0)) / (dense.std(0) + 1e-6), -4, 4)
    draw, width, n = np.random.default_rng(0), 1 << 16, dense.shape[1]
    v, u = draw.normal(0, 0.02, (width, factors)), draw.normal(0, 0.02, (n, factors))
    words = sorted(set(code.tolist()))
    names = [("w", c) for c in words] + [("d", j) for j in range(n)]
    single, inner = dict.fromkeys(names, 0.0), {k: (v if k[0] == "w" else u)[k[1]].copy() for k in names}
    shift, seen_shift, seen_single, seen_inner = 0.0, 1e-8, dict.fromkeys(names, 1e-8), {k: np.full(factors, 1e-8) for k in names}
    rows = [{**{("w", int(c)): float(x) for c, x in zip(code[at[i] : at[i + 1]], value[at[i] : at[i + 1]], strict=True)}, **{("d", j): dense[i, j] for j in range(n)}} for i in range(len(texts))]

    def margin(x):
        keys = list(x)
        return shift + sum(single[k] * x[k] for k in keys) + sum(x[p] * x[q] * (inner[p] @ inner[q]) for i, p in enumerate(keys) for q in keys[:i])

    train = np.flatnonzero(np.arange(len(y)) % 5 != 4)
    for _ in range(epochs):
        draw.shuffle(train)
        for i in range(0, len(train), batch):
            chosen = sorted(train[i : i + batch].tolist())
            errors = {r: (1 / (1 + math.exp(-margin(rows[r]))) - y[r]) / len(chosen) for r in chosen}
            met = {k for r in chosen for k in rows[r]}
            slopes = {k: (sum(errors[r] * rows[r].get(k, 0) for r in chosen) + ridge * single[k], sum(errors[r] * rows[r][k] * sum(inner[q] * x for q, x in rows[r].items() if q != k) for r in chosen if k in rows[r]) + ridge * inner[k]) for k in met}
            for k, (one, many) in slopes.items():
                seen_single[k] += one**2
                seen_inner[k] = seen_inner[k] + many**2
                single[k] -= rate * one / math.sqrt(seen_single[k])
                inner[k] = inner[k] - rate * many / np.sqrt(seen_inner[k])
            seen_shift += sum(errors.values()) ** 2
            shift -= rate * sum(errors.values()) / math.sqrt(seen_shift)
    assert model["w0"] == pytest.approx(shift, rel=1e-3, abs=1e-4)
    assert [model["w"][c] for c in words] == pytest.approx([single["w", c] for c in words], rel=1e-3, abs=1e-4)
    assert model["wd"].tolist() == pytest.approx([single["d", j] for j in range(n)], rel=1e-3, abs=1e-4)
    assert np.allclose([model["v"][c] for c in words], [inner["w", c] for c in words], rtol=1e-3, atol=1e-4)
    assert np.allclose(model["u"], [inner["d", j] for j in range(n)], rtol=1e-3, atol=1e-4)
