"""Order over a whole table without a task that holds it: ranges, running totals and exact quantiles by group.

A table is dealt out by ranges of its order and written once in the shared folder, so that every later step sees the same
ranges.  What is summed up for each range is one row for each of Spark's shuffle partitions, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonality.session import materialize


def ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` dealt out by ranges of ``order``, with the number of its range, ascending in that order, in ``_range``."""
    return materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def running(df: DataFrame, order: Sequence[Column | str], values: dict[str, Column]) -> DataFrame:
    """``df`` with, under each name of ``values``, the sum of that value over all rows before a row in ``order`` (0 for the
    first; a NULL value counts as 0).

    Rows that are equal in ``order`` lie in one range, one before the other.
    """
    rows = ranged(df.withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in values.items()}), order)
    sums = rows.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = sums.select("_range", *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in values])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # at most as many rows as there are shuffle partitions
    placed = rows.join(F.broadcast(sums), "_range")
    return placed.withColumns({k: F.col(f"_b_{k}") + F.coalesce(F.sum(f"_v_{k}").over(within), F.lit(0)) for k in values}).drop(
        "_range", *[f"_{x}_{k}" for k in values for x in "vb"])


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """``by, out``: for each group the exact quantiles of ``value`` (array of doubles in the order of ``probs``), linear
    between neighbouring ranks.  NULL values are left out; a group without values has no row; NULL is a group.

    Equal values are counted first.  The distinct values of all groups are dealt out by ranges of (group, value); from
    the sums of the ranges it is known which range holds a wanted rank, and only those ranges are looked into.  A group
    with many values is spread over many ranges, so no task holds it.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*by).alias("_g"), F.col(value).cast("double").alias("_x"))
    counts = rows.groupBy("_g", "_x").agg(F.count(F.lit(1)).alias("_n"))
    spread = ranged(counts, ["_g", "_x"])
    of_group = Window.partitionBy("_g")
    sums = spread.groupBy("_g", "_range").agg(F.sum("_n").alias("_n")).select(
        "_g", "_range", "_n", F.sum("_n").over(of_group).alias("_total"),
        (F.sum("_n").over(of_group.orderBy("_range")) - F.col("_n")).alias("_before"))
    places = [F.lit(p) * (F.col("_total") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[r.cast("long") for x in places for r in (F.floor(x), F.ceil(x))]))
    wanted = sums.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))))
    wanted = wanted.where(F.size("_ranks") > 0).select("_g", "_range", "_total", "_before", "_ranks")
    upto = Window.partitionBy("_g", "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    looked = spread.join(wanted, ["_g", "_range"]).withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    found = looked.select("_g", "_total", "_x", F.explode(F.filter(
        "_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_n")))).alias("_rank"))
    # at most two ranks for each quantile
    at = found.groupBy("_g").agg(F.first("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))

    def between(x: Column) -> Column:
        low, high = F.col("_at")[F.floor(x).cast("long")], F.col("_at")[F.ceil(x).cast("long")]
        return F.when(low == high, low).otherwise(low + (high - low) * (x - F.floor(x)))

    return at.select(*[F.col(f"_g.{c}").alias(c) for c in by], F.array(*[between(x) for x in places]).alias(out))
