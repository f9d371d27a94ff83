"""Pairs near a Jaccard similarity of 0.8 of five-word shingles, by kind of edit."""

import random

import pytest

from quire.llm import simhash


def jaccard(a, b, width=5):
    a, b = ({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} for w in (a, b))
    return len(a & b) / len(a | b)


def edited(kind, words, new):
    n = len(words)
    if kind == "appended":
        return words + [new() for _ in range(n * 15 // 64)]
    if kind == "cut":
        return words[: n - n * 18 // 100]
    if kind == "replaced":
        out, k = list(words), n * 10 // 100 - 4
        out[n // 2 : n // 2 + k] = [new() for _ in range(k)]
        return out
    out = list(words)
    for i in range(n // 50):
        out[25 + 50 * i] = new()
    return out


@pytest.mark.parametrize("kind", ["appended", "cut", "replaced", "scattered"])
def test_recall_of_edited_pairs(spark, kind):
    rng, rows, pairs = random.Random(11), [], 150
    new = lambda: f"w{rng.randrange(1 << 40)}"
    for n in range(pairs):
        words = [new() for _ in range((100, 300)[n % 2])]
        other = edited(kind, words, new)
        assert 0.8 <= jaccard(words, other) < 0.9
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= {2 * n for n in range(pairs)}
    found = pairs - len(kept - {2 * n for n in range(pairs)})
    print(f"{kind}: {found} of {pairs} pairs found")
    assert found == pairs


def test_recall_of_the_smallest_texts_at_the_threshold(spark):
    rows = []
    for n in range(300):  # four shingles of five
        words = [f"w{n}x{i}" for i in range(9)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[:8]))]
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * n for n in range(300)}


def test_pairs_below_the_threshold_stay(spark):
    rows = []
    for n in range(100):
        words = [f"w{n}x{i}" for i in range(30)]
        rows += [(10 * n, " ".join(words)), (10 * n + 1, " ".join(words[:15] + ["other"] + words[16:]))]  # 21 of 31
        rows += [(10 * n + 2, " ".join(f"s{n}x{i}" for i in range(8))), (10 * n + 3, " ".join(f"s{n}x{i}" for i in range(7)) + " other")]  # 3 of 5
        base = [f"v{n}x{i}" for i in range(100)]
        rows += [(10 * n + 4, " ".join(base)), (10 * n + 5, " ".join(base + [f"u{n}x{i}" for i in range(25)]))]  # 96 of 121
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {k for k, _ in rows}


@pytest.mark.parametrize("unit_rows", [1024, 8])
def test_against_exact_components(spark, unit_rows):
    rng, rows = random.Random(5), []
    base = [f"w{i}" for i in range(60)]
    for n in range(60):  # chains and near misses in one hot group
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"x{rng.randrange(6)}"
        rows.append((n, " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for _, t in rows]
    root = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), unit_rows=unit_rows).collect()}
    assert 1 < len(set(root)) < 60 and kept == set(root)
