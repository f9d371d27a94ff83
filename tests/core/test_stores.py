"""The incremental index against full rebuilds, and pages behind shard pointers."""

import os

import pytest
from pyspark.sql import functions as F

from quire.operators import incremental
from quire.sources import shards



def terms():
    return F.split("text", " ")

DOCS = "book_id string, doc_id long, text string"


def _state(spark, path):
    return sorted(map(tuple, incremental.offsets(spark, path).collect())), sorted(map(tuple, incremental.postings(spark, path).select("book_id", "term", "doc_id").collect()))


def _files(path, name):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/{name}") for f in fs if f.startswith("part-")}


BEFORE = [("a", 1, "red fox"), ("a", 2, "red owl"), ("b", 3, "red"), ("b", 4, "zebra fox"), ("c", 5, "quiet sea"), ("d d", 6, "élan vital"), (None, 7, "lost")]
AFTER = [("a", 1, "red fox ran"), ("b", 3, "blue"), ("c", 5, "quiet sea"), ("e", 8, "fox 中文"), (None, 7, "lost")]


def test_refresh_equals_a_full_rebuild(spark, tmp_path):
    path, whole = f"{tmp_path}/one", f"{tmp_path}/two"
    incremental.build(spark.createDataFrame(BEFORE, DOCS), terms(), path)
    kept, leads = _files(path, "postings/book_id=c"), _files(path, "terms/lead=115")
    now = spark.createDataFrame(AFTER, DOCS)
    incremental.build(now, terms(), whole)
    stale = spark.createDataFrame([("a",), ("b",), ("d d",), ("e",), (None,), ("never",)], "book_id string")
    incremental.refresh(now, stale, terms(), path)
    assert _state(spark, path) == _state(spark, whole)
    assert kept and leads and _files(path, "postings/book_id=c") == kept and _files(path, "terms/lead=115") == leads
    assert not os.path.exists(f"{path}/pending") and not os.path.exists(f"{path}/terms/lead=122")
    incremental.refresh(now, stale, terms(), path)
    incremental.refresh(now, stale.limit(0), terms(), path)
    assert _state(spark, path) == _state(spark, whole)


@pytest.mark.parametrize("cut", ["before", "between", "after"])
def test_an_interrupted_refresh_is_finished_or_dropped(spark, tmp_path, monkeypatch, cut):
    path, whole = f"{tmp_path}/one", f"{tmp_path}/two"
    incremental.build(spark.createDataFrame(BEFORE, DOCS), terms(), path)
    now = spark.createDataFrame(AFTER, DOCS)
    incremental.build(now, terms(), whole)
    stale = spark.createDataFrame([("a",), ("b",), ("d d",), ("e",)], "book_id string")
    write, leads = incremental._write, incremental._write_leads

    def fails(rows, where, by, dynamic=False):
        if cut == "before" and where.endswith("pending/terms") or cut == "between" and dynamic and where.endswith("/terms"):
            raise RuntimeError
        write(rows, where, by, dynamic)

    monkeypatch.setattr(incremental, "_write", fails)
    if cut == "after":
        monkeypatch.setattr(incremental, "_write_leads", lambda *a: (_ for _ in ()).throw(RuntimeError))
    with pytest.raises(RuntimeError):
        incremental.refresh(now, stale, terms(), path)
    monkeypatch.setattr(incremental, "_write", write)
    monkeypatch.setattr(incremental, "_write_leads", leads)
    if cut == "before":
        incremental.finish(spark, path)
        assert _state(spark, path)[1] == sorted((b, t, d) for b, d, x in BEFORE if b for t in x.split())
        incremental.refresh(now, stale, terms(), path)
    incremental.finish(spark, path)
    assert _state(spark, path) == _state(spark, whole)


def test_an_empty_library_and_its_first_books(spark, tmp_path):
    path = f"{tmp_path}/index"
    incremental.build(spark.createDataFrame([("a", 1, "x")], DOCS), terms(), path)
    none = spark.createDataFrame([], DOCS)
    incremental.refresh(none, spark.createDataFrame([("a",)], "book_id string"), terms(), path)
    assert _state(spark, path) == ([], [])
    incremental.refresh(spark.createDataFrame([("b", 2, "x y")], DOCS), spark.createDataFrame([("b",)], "book_id string"), terms(), path)
    assert _state(spark, path) == ([("x", 1, 0), ("y", 1, 1)], [("b", "x", 2), ("b", "y", 2)])


def _metric(df, name):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, seen = [plan.executedPlan() if "Adaptive" in plan.getClass().getName() else plan], {}
    while todo:
        node = todo.pop()
        if node.metrics().contains(name) and "text" in [node.output().apply(i).name() for i in range(node.output().size())]:
            seen[node.toString()] = node.metrics().apply(name).value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "QueryStage" in node.getClass().getName():
            todo.append(node.plan())
    return sum(seen.values())


def test_a_point_read_opens_one_shard(spark, tmp_path):
    path = f"{tmp_path}/shards"
    rows = [(f"b{b}", n, f"title {n}", f"text {b} {n}") for b in range(5) for n in range(1, 41)] + [("b1", 7, "again", "twice")]
    docs = spark.createDataFrame(rows, "book_id string, physical_page int, title string, text string")
    shards.write(docs, path, ["title"], 10)
    got = shards.page(spark, path, "b3", 15)
    assert [r["text"] for r in got.collect()] == ["text 3 15"]
    assert "dynamicpruning" in got._jdf.queryExecution().optimizedPlan().toString()
    assert _metric(shards.page(spark, path, "b3", 15), "numPartitions") == 1
    pointers = shards.pointers(spark, path, "b3")
    assert "PartitionFilters: [isnotnull(bucket" in pointers._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["text"] for r in shards.page(spark, path, "b1", 7).collect()) == ["text 1 7", "twice"]
    assert shards.page(spark, path, "b9", 1).count() == 0
    assert shards.read(spark, path, shards.pointers(spark, path)).count() == len(rows)
    sizes = [r["count"] for r in spark.read.parquet(f"{path}/docs").groupBy("shard").count().collect()]
    assert max(sizes) <= 11 and len(sizes) == 21
    docs.write.parquet(f"{tmp_path}/whole")
    assert shards.page(spark, f"{tmp_path}/none", "b3", 15, f"{tmp_path}/whole").count() == 1
    with pytest.raises(ValueError, match="nothing to write"):
        shards.write(docs.limit(0), path, ["title"])


def test_derived_tables_follow_their_sources(spark, tmp_path):
    from quire.sources import tables

    made = []

    def make():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/in").withColumn("twice", F.col("id") * 2)

    spark.range(3).write.parquet(f"{tmp_path}/in")
    read = lambda: sorted(r["twice"] for r in tables.derived(spark, "test", [f"{tmp_path}/in"], make).collect())
    assert read() == read() == [0, 2, 4] and len(made) == 1
    spark.range(3, 5).write.mode("append").parquet(f"{tmp_path}/in")
    assert read() == [0, 2, 4, 6, 8] and len(made) == 2
    path = next(p for (_, name, _), (_, p) in tables._made.items() if name == "test").removeprefix("file:").replace("//", "/")
    os.rename(path, f"{path}-gone")
    assert read() == [0, 2, 4, 6, 8] and len(made) == 3
