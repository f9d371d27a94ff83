"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within its source the keys are range-sorted: the leading hex digits of the key
are a range bucket, buckets are summed, and a running sum over the few bucket rows gives each bucket its offset; inside a
bucket a window adds the rest. So a source with a third of all rows is spread over all its buckets. A source takes the
documents in key order up to its budget, the last one in part, and begins again where the budget exceeds its size.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) for one row per source: the sources by code point, null last, weigh ``weights`` in turn.

    All targets add up to all sizes. A target stops at ``most`` times its source's size and the excess is shared anew by
    weight: with the sources ordered by most * size / weight, those that stop are the first ones, and the rest share what
    is left. One row per source, so these windows are small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    stops = weighed.withColumn("stop", most * F.col("source_size") / F.col("w"))
    before = Window.orderBy("stop", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    found = stops.withColumn("level", level).withColumn("share", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(every))
    target = F.least(F.col("w") * F.coalesce(F.col("share.level"), F.lit(0.0)), most * F.col("source_size"))
    return found.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (5, 2, 1), most: float = 3.0, digits: int = 3) -> DataFrame:
    """(key, size, source_size, target, taken) per row of ``docs``; taken counts the words that the mix holds, repeats included.

    The order within a source is that of md5(key), so reruns agree. Its budget is the floor of the target: whole passes
    over the source, then documents in order, of which the last is cut. Rows with equal keys follow each other by size;
    equal rows share what falls to them in any order. A null key counts as empty, a null text as size 0, a null source is
    a source of its own. A source without words takes nothing. digits: hex digits of the range buckets, 16 ** digits of
    them in each source.
    """
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), order.alias("order"))
    rows = rows.withColumn("bucket", F.substring("order", 1, digits))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"))
    placed = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "bucket", "offset", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("order", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    both = summed.alias("r").join(placed.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - passes * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return both.select(F.col("r.key").alias(key), "size", "source_size", "target", taken.cast("long").alias("taken"))
