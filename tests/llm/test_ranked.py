import math
import random
import re
from collections import Counter

import pytest

from quire.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score double, q string", "item_id long, text string, row int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [x for x in counted if x[1]]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, math.inf if d is None else d))
        out += [(i, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def made(seed, docs=300, items=12):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "straße", "日本", "I", "i", "x1"]
    draw = lambda n: " ".join(vocabulary[min(int(pick.expovariate(0.03)), len(vocabulary) - 1)] + pick.choice(["", ",", ".", "_"]) for _ in range(n))
    rows = [(i, draw(pick.choice([0, 1, 3, 20, 60, 400]))) for i in range(docs)]
    rows += [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "w1 w2 w3 w150"), (1000, None), (1001, ""), (1002, "... !"), (1003, rows[5][1]), (1004, "w0 " * 20_000)]
    asked = [(i, draw(pick.choice([1, 2, 8, 30]))) for i in range(items)]
    return rows, asked + [(50, ""), (51, None), (52, "no such words"), (53, "w0"), (None, "w1"), (54, "w5 w6"), (54, "w7"), (55, "w1 W1 w1")]


@pytest.mark.parametrize("head, block_docs, block_items, k", [(100, 4096, 512, 10), (2, 16, 3, 10), (1, 50, 512, 1), (3, 64, 2, 4)])
def test_equals_brute_force(spark, head, block_docs, block_items, k):
    for name, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "7")):  # groups of one key must meet by their hash
        spark.conf.set(name, value)
    rows, asked = made(head)
    docs = spark.createDataFrame([(*r, 0.5, "q") for r in rows], DOCS).repartition(3)
    got = ranked.rank(docs, spark.createDataFrame([(*r, 1) for r in asked], ITEMS), k, head=head, block_docs=block_docs, block_items=block_items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == plain(rows, asked, k)


def test_no_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b", 0.5, "q")], DOCS), spark.createDataFrame([(1, "a", 1)], ITEMS)
    assert ranked.rank(docs.limit(0), items).count() == 0
    assert ranked.rank(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in ranked.rank(docs, items).collect()] == plain([(1, "a b")], [(1, "a")])
