import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest

from quire.llm import oracles, quality, toxicity

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's name, input rows and output rows."""
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(f"{top}/{name}")
        after = spark.read.parquet(f"{top}/{name}")
        out[name] = docs, after, f"{top}/{name}"
        docs = after
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_stay_and_rows_are_whole(stages):
    for name, (before, after, _) in stages.items():
        if name != "mixing":
            assert after.columns == before.columns
            assert Counter(map(tuple, after.collect())) <= Counter(map(tuple, before.collect()))


def test_run_equals_the_stages(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == Counter(map(tuple, stages["mixing"][1].collect()))


@pytest.mark.parametrize(("name", "module", "rejects"), [("toxicity", toxicity, 1), ("quality", quality, 0)])
def test_classifiers_decide(spark, stages, name, module, rejects):
    before, after, _ = stages[name]
    bad = ids(module.classify(before, spark.read.parquet(f"{DIR}/labels.parquet")).where(f"predicted = {rejects}"))
    assert bad and ids(after) == ids(before) - bad


def test_near_duplicates_against_all_pairs(stages):
    """Pairs that share a shingle of five words, by exact Jaccard similarity; one of each component stays."""
    before, after, _ = stages["near duplicates"]
    sets, holders = {}, defaultdict(list)
    for r in before.collect():
        words = re.findall("[^\\x20\\x09-\\x0D]+", (r["text"] or "").lower())
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
        for s in sets[r["doc_id"]]:
            holders[s].append(r["doc_id"])
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    links = 0
    for a, s in sets.items():
        shared = Counter(b for x in s for b in holders[x] if b > a)
        for b, n in shared.items():
            if n / (len(s) + len(sets[b]) - n) >= 0.8:
                links += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert links > 20 and ids(after) == {find(d) for d in sets}


def tiled(item, doc, seed=5):
    """Words of ``item`` that greedy string tiling covers, by its definition."""
    used_a, used_b, total = set(), set(), 0
    while True:
        most, best = seed, []
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in used_a and b + n not in used_b:
                    n += 1
                if n >= most:
                    best = [*(best if n == most else []), (a, b)]
                    most = n
        if not best:
            return total
        for a, b in best:
            if not used_a & set(range(a, a + most)) and not used_b & set(range(b, b + most)):
                used_a |= set(range(a, a + most))
                used_b |= set(range(b, b + most))
                total += most


def test_decontamination_against_the_definition(spark, stages):
    before, after, _ = stages["decontamination"]
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [words(b["text"]) for b in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    bad = set()
    for d in before.collect():
        text = words(d["text"])
        seen = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for w in items:
            if sum(tuple(w[k : k + 5]) in seen for k in range(len(w) - 4)) and tiled(w, text) >= 0.8 * len(w):
                bad.add(d["doc_id"])
                break
    assert bad and ids(after) == ids(before) - bad


def test_mixing_equals_its_sql(stages):
    _, after, _ = stages["mixing"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{stages['decontamination'][2]}/*.parquet'")
    want = con.sql(oracles.SQL["op10_mixing"])
    assert Counter(tuple(r[c] for c in want.columns) for r in after.collect()) == Counter(want.fetchall())


def test_edge_cases_through_run(spark, tmp_path):
    """Nulls, empty texts, copies, repeated rows and columns with names that the stages use; then no rows at all."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    text = lambda n: " ".join(words[(n * 7 + i * (n + 1)) % len(words)] + str(n % 5) for i in range(30))
    leak = "this very passage of the benchmark has nine words"
    rows = [(i, text(i), "en", "s" if i % 2 else None) for i in range(12)] + [(50, text(3), "en", "s"), (51, text(3) + " more", None, "s"), (60, f"before {leak} after it all", "en", "t"), (None, text(4) + " unlike", "en", "t"), (70, None, "en", "s"), (71, "", "en", "s"), (1, text(1), "en", "s")]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    clash = "score double, size int, held_out string, predicted int, _k int, _y int, key string, keep int, _bad int, taken string"
    docs = spark.createDataFrame([(*r, None if r[0] == 5 else len(r[1] or ""), 0.5, 1, "x", 1, 1, 1, "k", 1, 1, "t") for r in rows], f"{names}, {clash}")
    bench = spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)] + [(None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    for name, made in (("full", docs), ("none", docs.limit(0))):
        made.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        labels.where("doc_id < 0").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/full")
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    kept = sorted((r["doc_id"] for r in got.collect()), key=str)
    assert 60 not in kept and 50 not in kept and 51 not in kept and {3, 5, 7} <= set(kept) and None in kept
    assert kept.count(1) <= 2 and len({70, 71} & set(kept)) >= 1
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    labels.write.mode("overwrite").parquet(f"{tmp_path}/full/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/full").count() <= len(kept)
