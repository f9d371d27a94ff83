import random
import re
import time

import numpy as np

from quire.llm import decontaminate


def naive(item, doc, seed):
    """Greedy string tiling by its definition: all longest matches of unmarked words, again and again."""
    used_a, used_b, total = set(), set(), 0
    while True:
        best = []
        most = seed
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in used_a and b + n not in used_b:
                    n += 1
                if n > most:
                    most, best = n, [(a, b)]
                elif n == most:
                    best.append((a, b))
        if not best:
            return total
        for a, b in best:
            if not used_a & set(range(a, a + most)) and not used_b & set(range(b, b + most)):
                used_a |= set(range(a, a + most))
                used_b |= set(range(b, b + most))
                total += most


def test_tiles_against_the_definition():
    rng = random.Random(7)
    for _ in range(150):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(30))]
        doc = [rng.randrange(1, 5) for _ in range(rng.randrange(60))]
        tiles = decontaminate.tile(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        assert all(item[a : a + n] == doc[b : b + n] for a, b, n in tiles)
        for k in (0, 1):
            marked = [i for t in tiles for i in range(t[k], t[k] + t[2])]
            assert len(marked) == len(set(marked))
        assert sum(n for _, _, n in tiles) == naive(item, doc, 3)


def test_repeated_words_are_tiled_in_time():
    item, doc = np.full(100, 7, np.uint64), np.full(20_000, 7, np.uint64)
    began = time.time()
    assert decontaminate.tile(item, doc, 5) == [(0, 0, 100)]
    assert sum(n for _, _, n in decontaminate.tile(np.full(1000, 7, np.uint64), np.tile(np.array([7] * 50 + [8], np.uint64), 400), 5)) == 1000
    assert time.time() - began < 5


def test_marks_beyond_ascii_divide_words(spark):
    bench = spark.createDataFrame([(1, "“one two” — three… four ¿five? «six»")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "one\u00a0two three\u2014four (five) six"), (3, "one twö three four five")], "doc_id long, text string")
    got = decontaminate.contamination(docs, bench)
    assert got.columns == ["doc_id", "item_id", "covered", "words", "tiles", "coverage"]
    assert sorted((r["doc_id"], r["covered"]) for r in got.collect()) == [(1, 6), (2, 6)]


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def test_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = set()
    items = [(b["item_id"], words(b["text"])) for b in bench.collect()]
    for d in docs.collect():
        text = words(d["text"])
        seen = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for i, w in items:
            if len(w) >= 5 and any(tuple(w[k : k + 5]) in seen for k in range(len(w) - 4)):
                covered = naive(w, text, 5)
                if covered >= 0.8 * len(w):
                    want.add((d["doc_id"], i, covered))
    for block in (1 << 24, 300):
        got = decontaminate.contamination(docs, bench, block_chars=block).collect()
        assert want and {(r["doc_id"], r["item_id"], r["covered"]) for r in got} == want and len(got) == len(want)


def test_reordered_passages_and_edge_cases(spark):
    item = "one two three four five. Six seven eight nine ten! Eleven twelve thirteen fourteen fifteen"
    moved = "Eleven twelve, thirteen fourteen fifteen x y z six seven eight nine ten filler ONE two three four five"
    part = "one two three four five and nothing else of it"
    bench = spark.createDataFrame([(1, item, "a"), (2, None, "b"), (3, "", "c"), (4, "too short", "d"), (1, item, "e"), (None, "alpha beta gamma delta epsilon", "f")], "item_id long, text string, words string")
    docs = spark.createDataFrame([(1, moved), (2, part), (3, None), (4, ""), (5, "too short"), (None, moved), (6, "z " * 40_000 + moved), (7, "alpha beta gamma delta epsilon"), (1, "clean")], "doc_id long, text string")
    got = decontaminate.contamination(docs, bench)
    assert sorted((str(r["doc_id"]), str(r["item_id"]), r["coverage"]) for r in got.collect()) == sorted([("1", "1", 1.0), ("1", "1", 1.0), ("6", "1", 1.0), ("6", "1", 1.0), ("None", "1", 1.0), ("None", "1", 1.0), ("5", "4", 1.0), ("7", "None", 1.0)])
    assert sorted(r["text"] or "" for r in decontaminate.clean(docs, bench).collect()) == ["", "", part]  # document 1 goes with all its rows
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_few_words_and_common_openings_lose_nothing(spark):
    rng = random.Random(3)
    opening = "choose the right answer to this question"
    items, docs = [], []
    for i in range(60):
        body = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 40))]
        items.append((i, " ".join([*(opening.split() if i % 3 else []), *body])))
    for d in range(120):
        parts = [items[rng.randrange(60)][1].split() for _ in range(2)]
        parts = [w[rng.randrange(3) : len(w) - rng.randrange(4)] for w in parts]
        half = len(parts[0]) // 2
        docs.append((d, " ".join([*parts[0][half:], *rng.choices("abcxyz", k=5), *parts[0][:half], *opening.split(), *parts[1]])))
    want = set()
    for i, item in items:
        for d, doc in docs:
            covered = naive(item.split(), doc.split(), min(5, len(item.split())))
            if covered >= 0.8 * len(item.split()):
                want.add((d, i, covered))
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 60 and {(r["doc_id"], r["item_id"], r["covered"]) for r in got.collect()} == want


def test_a_common_opening_is_not_indexed():
    opening = "choose the right answer to this question"
    texts = [f"{opening} " + " ".join(f"w{i}x{k}" for k in range(40)) for i in range(500)]
    block = decontaminate._Block(list(range(500)), texts, 5, 0.8)
    _, items = np.unique(block.seeds, return_counts=True)
    assert items.max() == 1
    hashes, first = decontaminate.hashed_words(decontaminate.pa.array([opening, f"{opening} {texts[7]}"]))
    assert [x.tolist() for x in decontaminate._candidates(*decontaminate.shingle_hashes(hashes, first, 5), block)] == [[1], [7]]


def test_items_shorter_than_a_seed_match_whole(spark):
    bench = spark.createDataFrame([(1, "Red fox"), (2, "red, FOX!"), (3, "owl"), (4, "..."), (5, "one two three four"), (6, None), (7, "fox ran far away today")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a red fox ran far away today"), (2, "red. fox. red fox owl"), (3, "fox red"), (4, "one two three"), (5, ""), (6, None), (7, "owl"), (8, "x one two three four")], "doc_id long, text string")
    for chars in (1 << 24, 10):
        got = decontaminate.contamination(docs, bench, block_chars=chars).collect()
        found = sorted((r["doc_id"], r["item_id"], r["covered"], r["words"], r["coverage"]) for r in got)
        assert found == [(1, 1, 2, 2, 1.0), (1, 2, 2, 2, 1.0), (1, 7, 5, 5, 1.0), (2, 1, 2, 2, 1.0), (2, 2, 2, 2, 1.0), (2, 3, 1, 1, 1.0), (7, 3, 1, 1, 1.0), (8, 5, 4, 4, 1.0)]
        assert [t["doc_word"] for r in got if (r["doc_id"], r["item_id"]) == (2, 3) for t in r["tiles"]] == [4]


def test_long_items_are_tiled_in_time():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 2**63, 10_000).astype(np.uint64)
    decontaminate.tile(text[:100], text[:100], 5)
    began = time.time()
    assert decontaminate.tile(text, text.copy(), 5) == [(0, 0, 10_000)]
    assert time.time() - began < 0.3
    moved = np.concatenate([text[5000:], text[:5000]])
    assert sorted(decontaminate.tile(text, moved, 5)) == [(0, 5000, 5000), (5000, 0, 5000)]
