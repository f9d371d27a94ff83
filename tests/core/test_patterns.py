"""Many patterns at once, and search by grams, against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import grams, patterns, quality, search
from quire.plans import corpus


@pytest.mark.parametrize("most", [patterns.BLOCK, 20_000, 5])
def test_ten_thousand_patterns_equal_containment(spark, most):
    pick = random.Random(5)
    many = 10_000 if most > 5 else 12
    word = lambda n: "".join(pick.choice("abé ") for _ in range(n))
    asked = [*(word(pick.randint(1, 9)) for _ in range(many)), "", None, "é", "a b", "a b"]
    texts = [*(word(pick.choice([0, 3, 50, 400])) for _ in range(60)), None, "", "abab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string").withColumn("p", F.lit("clash"))
    got = patterns.contained(rows.drop("p"), spark.createDataFrame([(a, 1) for a in asked], "p string, id int"), "body", "p", most)
    assert got.columns == ["id", "p"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == {(i, a) for i, t in enumerate(texts) if t is not None for a in set(asked) if a is not None and a in t}


def test_batches_need_no_nested_loop(spark):
    pages = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "two"), (11, "two th"), (12, ""), (13, None), (14, "two")], "item_id long, text string")
    got = search.batch(pages, asked, "item_id", "text")
    assert {tuple(r) for r in got.collect()} == {(1, 10), (2, 10), (1, 14), (2, 14), (1, 11), (1, 12), (2, 12), (4, 12)}
    long = search.batch(pages, asked.where("length(text) > 0"), "item_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Contains" not in long and "CartesianProduct" not in long
    assert search.batch(pages, asked.limit(0), "item_id", "text").count() == 0


def test_claims_of_several_words(spark):
    names = spark.createDataFrame([("a", "Physics Two"), ("b", "chemistry"), ("c", "  "), ("d", None)], "book_id string, name string")
    rows = [("a", 1, "from كتاب chemistry"), ("a", 2, "ملف الchemistry!"), ("a", 3, "كتاب chemistry, not Physics two"), ("b", 1, "كتاب physics  TWO."), ("b", 2, "physics two"), ("b", 3, "كتاب physics twofold"), ("b", 4, None), ("a", 5, "كتاب physics two")]
    pages = spark.createDataFrame(rows, "book_id string, physical_page int, summary string")
    assert sorted(map(tuple, quality.claims(pages, names, ["summary"]).collect())) == [("a", 1, "summary", "b"), ("a", 2, "summary", "b"), ("b", 1, "summary", "a")]


def _files(df):
    """Files that the scans of a plan have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    seen, todo = {}, [plan]
    while todo:
        node = todo.pop()
        if node.metrics().contains("numFiles"):
            seen[node.toString()[:60] + str(len(seen))] = node.metrics().apply("numFiles").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getName():
            todo.append(node.plan())
    return list(seen.values())


def test_grams_narrow_what_is_read(spark, tmp_path):
    pick = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta"]
    rows = [(f"b{b}", n, " ".join(pick.choice(words) for _ in range(5)) + (" rarest word" if (b, n) == (3, 70) else ""), "t") for b in range(6) for n in range(1, 200)]
    view = search.view(spark.createDataFrame(rows, "book_id string, physical_page int, text string, title string"))
    grams.stretched(view).write.partitionBy(*grams.KEYS).parquet(f"{tmp_path}/view")
    view = spark.read.parquet(f"{tmp_path}/view")
    held = grams.index(view, ("text", "title"))
    held.write.parquet(f"{tmp_path}/grams")
    held = spark.read.parquet(f"{tmp_path}/grams")
    for query, match in [("rarest", "any"), ("alpha rarest", "all"), ("rarest word", "phrase"), ("zz rarest", "any"), ("none of", "all"), ("alpha", "any"), ("t", "any"), ("", "any"), ("épsilon É", "all")]:
        one, two = (sorted(map(str, x.collect())) for x in (search.search(view, None, query, match), grams.find(view, held, None, query, match)))
        assert one == two
    near = grams.narrowed(view, held, "rarest word", "phrase")
    assert near.count() <= grams.SPAN and 1 in _files(near)
    assert "dynamicpruning" in near._jdf.queryExecution().executedPlan().toString()


def test_no_text_moves_in_book_queries(spark):
    """With broadcasts off, no exchange of these queries has a text among its columns."""
    corpus.folded(spark, "/root/testdata/sf0.001")
    from quire.plans.library import R

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("search_any", "search_all", "search_page_offset", "read_page_point", "book_page_map"):
            seen, ready = 0, R.queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
            todo = [ready.inputPlan() if "AdaptiveSparkPlan" in ready.getClass().getName() else ready]
            while todo:
                node = todo.pop()
                seen += 1
                if node.nodeName().startswith("Exchange"):
                    columns = [node.output().apply(i).name() for i in range(node.output().size())]
                    assert not {"text", "title", "summary"} & set(columns), (name, columns)
                todo += [node.children().apply(i) for i in range(node.children().size())]
            assert seen > 1
            assert "nfkc" not in ready.toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
