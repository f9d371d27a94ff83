"""Row numbers and medians of groups that may hold a third of all rows: no window ever spans a whole group."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges up to which their counts are sent to all tasks, so that numbered rows move once; more are joined by a shuffle.
FEW = 200_000


def numbered(rows: DataFrame, group: str, order: str, width: int = 4096, name: str = "number", laid: bool = False) -> DataFrame:
    """``rows`` with each row's number in its group from 1 on, in order of a whole number.

    Rows are ranked inside ranges of ``width`` values and the ranges' counts are summed up, so a large group is spread over
    its ranges. Equal values are numbered in any order. laid: the rows come in order of group and number over all partitions,
    for which whole rows move once.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    few = laid and starts.limit(FEW + 1).count() <= FEW
    ranged = ranged.repartitionByRange(group, "_range") if few else ranged
    inside = ranged.withColumn("_i", F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)))
    both = inside.join(F.broadcast(starts) if few else starts, F.col(group).eqNullSafe(F.col("_g")) & F.col("_range").eqNullSafe(F.col("_r")))
    out = both.withColumn(name, (F.col("_start") + F.col("_i")).cast("int")).drop("_range", "_g", "_r", "_start", "_i")
    return out.repartitionByRange(group, name).sortWithinPartitions(group, name) if laid and not few else out


def upper_medians(rows: DataFrame, group: str, value: Column, bucket: Column) -> DataFrame:
    """(group, median): the middle value of each group, the upper one of two; null values don't count.

    bucket: a coarser value in the same order. Only the rows of the bucket in which the middle lies are ranked.
    """
    held = rows.select(F.col(group).alias("g"), value.alias("v"), bucket.alias("b")).where("v is not null").groupBy("g", "b", "v").agg(F.count("*").alias("k"))
    buckets = held.groupBy("g", "b").agg(F.sum("k").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("b"))
    total = F.sum("n").over(Window.partitionBy("g"))
    middle = buckets.select("g", "b", "n", upto.alias("upto"), F.floor(total / 2).alias("at")).where("upto > at and upto - n <= at").select("g", "b", (F.col("at") - F.col("upto") + F.col("n")).alias("rank"))
    inside = held.join(middle, ["g", "b"]).withColumn("upto", F.sum("k").over(Window.partitionBy("g").orderBy("v")))
    return inside.where("upto > rank").groupBy("g").agg(F.min("v").alias("median")).select(F.col("g").alias(group), "median")
