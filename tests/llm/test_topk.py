import math
import random

from pyspark.sql import functions as F

from quire.llm import topk


def brute(rows, every, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, a in asked.items():
        found = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i) for i, v in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.choice([-1, -0.5, 0, 0, 0, 0.3, 1])) for _ in range(12)]) for i in range(300)]
    rows += [(i, [1.0] * 12) for i in range(300, 360)]  # ties
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (404, []), (405, [1.0]), (None, [1.0] * 12), (7, [1.0] * 12), (10, [0.5] * 12), (10, [0.25] * 12), (406, [1e12] * 12), (407, [-1e12] * 12)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    asked = df.withColumn("vector", topk.whole_numbers(F.col("embedding")))
    for blocks in ({}, {"query_rows": 3, "block_rows": 40}):
        got = topk.top_k(asked, F.col("vec_id") % 10 == 0, 5, **blocks)
        assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, 10, 5)


def test_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", topk.whole_numbers(F.col("embedding")))
    assert topk.top_k(make([]), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(make([(0, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    assert [tuple(r) for r in topk.top_k(make([(0, [1.0]), (1, [-0.001])]), F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, -256)]


def test_a_repeated_id_is_spread(spark):
    rows = [(1, [float(i % 7)]) for i in range(3000)] + [(1, [9.0])] * 3000 + [(i, [1.0]) for i in range(2, 3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", topk.whole_numbers(F.col("embedding")))
    got = topk.top_k(df, F.col("vec_id") == 2, 5, block_rows=1000)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(n, 1, 9 * 256 * 256) for n in range(1, 6)]
    sizes = [r["count"] for r in topk.dealt(df.select(F.col("vec_id").alias("id"), F.col("vector").alias("v")), 9).groupBy("col").count().collect()]
    assert len(sizes) == 9 and max(sizes) < 1.3 * len(rows) / 9
