import random
import re
from collections import defaultdict

import pytest
import xxhash

from quire.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    fps = {i: fingerprint(t) for i, t in enumerate(t for _, t in rows)}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    smallest = {r: min((k for k in keys if k is not None), default=None) for r, keys in least.items()}
    return sorted(((k, f"{fps[i]:016x}", smallest[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("unit_rows", [1024, 8])
def test_against_brute_force(spark, unit_rows):
    rng = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(d["doc_id"], d["text"]) for d in docs]
    base = [f"w{rng.randrange(400)}" for _ in range(400)]
    for n in range(60):  # a hot group of near copies, whose fingerprints differ
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(400)] = f"x{n}{rng.random()}"
        rows.append((10_000 + n, " ".join(copy)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \t\n"), (20_003, "one"), (20_004, "ONE\x0btwo"), (20_005, "one  two"), (5, "one two"), (None, "one two"), (None, None), (20_006, "long " * 50_000)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, fp string, node int")
    got = simhash.near_duplicates(df, unit_rows=unit_rows)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_finds_every_pair_and_no_other():
    import numpy as np

    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 62, 20, dtype=np.uint64)
    codes = np.sort(np.concatenate([seeds ^ (np.uint64(1) << rng.integers(0, 62, 20).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 62, 20).astype(np.uint64)) for _ in range(15)]))
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 3}
    got = [p for a, b in simhash.trie_pairs(codes, np.array([[0, len(codes), 0, len(codes)]]), 3, small=1) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


def test_one_of_each_group_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r[0] for r in simhash.one_of_each(docs).select("doc_id").collect()}
    shingles, holders = {}, defaultdict(list)
    for d in docs.collect():
        w = WORD.findall(d["text"].lower())
        shingles[d["doc_id"]] = {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
        for s in shingles[d["doc_id"]]:
            holders[s].append(d["doc_id"])
    near = defaultdict(set)
    for ids in holders.values():
        for a in ids[:40]:
            for b in ids[:40]:
                if a != b and len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.6:
                    near[a].add(b)
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert not [(a, b) for a in kept for b in near[a] & kept if alike(a, b) >= 0.8]
    assert all(near[a] for a in shingles if a not in kept)  # nothing but near copies went


def test_one_of_each_edge_cases(spark):
    rows = [(3, "Same text here", 1), (2, "same  text here", 2), (2, "same  text here", 3), (9, None, 4), (8, "", 5), (7, " \n", 6), (None, "alone", 7), (4, "alone", 8)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _n int"))
    assert got.columns == ["doc_id", "text", "_n"]
    found = got.collect()
    assert sorted((r["doc_id"], r["text"]) for r in found if r["doc_id"] is not None) == [(2, "same  text here"), (7, " \n")]
    assert [r["text"] for r in found if r["doc_id"] is None] == ["alone"]
