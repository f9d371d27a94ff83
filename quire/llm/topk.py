"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates and queries are dealt into blocks, and each pair of blocks is one unit of work. A unit turns its candidates into
postings (term: rows and weights); each query's terms scatter their weighted postings into one dense array of scores, from
which partition selection takes the k best. The units' short lists are merged by a window that Spark limits before the shuffle.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null if the vector is null or holds a null, NaN or infinite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def postings(vectors: list) -> list:
    """For each term the rows that hold it and their weights; a term that most rows hold has weights for all, rows None."""
    width = max((len(v) for v in vectors), default=0)
    table = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        table[i, : len(v)] = v
    out = []
    for t in range(width):
        column = table[:, t]
        rows = np.flatnonzero(column)
        out.append((None, np.ascontiguousarray(column)) if 4 * len(rows) > len(column) else (rows, column[rows]))
    return out


def accumulate(query: np.ndarray, lists: list, rows: int) -> np.ndarray:
    """Inner products with all rows; Python's whole numbers where 64 bits might not hold them."""
    most = max((int(abs(w).max()) for _, w in lists if len(w)), default=0) * int(abs(query).max() if len(query) else 0)
    exact = most * max(len(query), 1) < 1 << 62
    scores = np.zeros(rows, np.int64 if exact else object)
    for t in np.flatnonzero(query[: len(lists)]):
        at, weights = lists[t]
        step = (weights if exact else weights.astype(object)) * (query[t] if exact else int(query[t]))
        if at is None:
            scores += step
        else:
            scores[at] += step
    return scores if exact else np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in scores], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= edge)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place] if len(scores) else scores))[:k]]


def dealt(rows: DataFrame, parts: int, across: str = "col") -> DataFrame:
    """Candidates with their block; rows that repeat an id, or are equal, are spread too."""
    return rows.withColumn(across, F.pmod(F.xxhash64("id", "v", F.rand(seed=2)), F.lit(parts)).cast("int"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "vector", query_rows: int = 1024, block_rows: int = 16384) -> DataFrame:
    """(query_id, rank, key, score): for each query its ``k`` highest integer inner products with all rows of other keys.

    vector: array<bigint>; rows with a null vector or key take no part, and of vectors of unlike length the common part
    counts. Ties go to the smaller key. Rows with a query's key are never its candidates. Of several query rows with one
    key the smallest vector is asked; repeated candidates take a rank each. Scores beyond 64 bits are cut to the nearest.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), is_query.alias("ask"))
    n, asked = rows.agg(F.count("*"), F.count_if("ask")).first()
    across = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block_rows))
    down = max(1, -(-asked // query_rows))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = rows.where("ask").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(down)).cast("int").alias("row"), every(across).alias("col"))
    candidates = dealt(rows.select("id", "v"), across).withColumn("row", every(down))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [np.zeros(0, np.int64)] for c in ("query_id", "id", "score")}
        if left.num_rows and right.num_rows:
            ids = right.column("id").to_numpy()
            lists = postings(right.column("v").to_pylist())
            for query, terms in zip(left.column("id").to_pylist(), left.column("v").to_pylist(), strict=True):
                other = np.flatnonzero(ids != query)
                scores = accumulate(np.array(terms, np.int64), lists, len(ids))[other]
                place = best(scores, ids[other], k)
                out["query_id"].append(np.full(len(place), query, np.int64))
                out["id"].append(ids[other][place])
                out["score"].append(scores[place])
        return pa.table({c: np.concatenate(x) for c, x in out.items()})

    short = queries.groupBy("row", "col").cogroup(candidates.groupBy("row", "col")).applyInArrow(run, "query_id long, id long, score long")
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
