import random

import duckdb
import pytest

from quire.llm import mixing
from quire.llm.oracles import SQL


def shares(sizes, weights, total, most=3.0):
    """Share by weight, stop what is above its limit, share the excess anew until none is above."""
    out, left = dict.fromkeys(sizes, 0.0), set(sizes)
    while left:
        rest = total - sum(out[s] for s in sizes if s not in left)
        level = rest / sum(weights[s] for s in left)
        over = {s for s in left if level * weights[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weights[s] for s in left}
        out |= {s: most * sizes[s] for s in over}
        left -= over
    return out


def test_against_sql_and_the_iterative_rule(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), rng.choice(["a", "b", "hot", "hot", "hot", "", None, "Z", "é"]), "k") for i in range(600)]
    rows += [(800, "x y", "a", "k"), (800, "x y", "a", "k"), (None, "some words", "b", "k"), (700, None, "c", "k"), (701, "", None, "k"), (702, "\x0b\t x", "only", "k"), (703, "a" * 500_000, "b", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = sorted(map(tuple, mixing.mix(df).collect()), key=str)
    duckdb.register("documents", df.toArrow())
    want = duckdb.sql(SQL["op10_mixing"]).fetchall()
    duckdb.unregister("documents")
    assert len(got) == len(rows)
    exact = lambda found: sorted((str(x[0]), x[1], x[2], x[4]) for x in found)
    assert exact(got) == exact(want)
    sizes, of = {}, {r[0]: r[2] for r in rows}
    for (key, _, source, _), size in ((r, len([w for w in (r[1] or "").replace("\x0b", " ").replace("\t", " ").split(" ") if w])) for r in rows):
        sizes[source] = sizes.get(source, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = shares(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for key, size, source_size, target, n in got:
        assert n <= 3 * size
        if key is not None:
            assert source_size == sizes[of[key]] and target == pytest.approx(targets[of[key]])
    for key, *_, n in got:
        taken[of[key]] += n
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_reruns_agree_and_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(mixing.mix(docs).collect()) == sorted(mixing.mix(docs.repartition(7)).collect())
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [tuple(r) for r in mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()] == [(1, 0, 0, 0.0, 0)]
