"""Ranges, running totals and exact quantiles against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from tonality.operators.ranges import quantiles, ranged, running


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, rng.randrange(50)])) for i in range(2000)]
    rng.shuffle(rows)
    got = running(spark.createDataFrame(rows, "k long, v long"), ["k"], {"before": F.col("v"), "place": F.lit(1)}).collect()
    total = 0
    for i, r in enumerate(sorted(got, key=lambda r: r["k"])):
        assert (r["before"], r["place"]) == (total, i)
        total += r["v"] or 0
    assert running(spark.createDataFrame([], "k long, v long"), ["k"], {"before": F.col("v")}).count() == 0


def test_quantiles_of_groups(spark):
    rng = random.Random(2)
    rows = [(g, None if rng.random() < 0.1 else rng.choice([rng.random(), 0.5, 1e9 + rng.randrange(9)]))
            for g in ("a", "b", None, "c") for _ in range({"a": 900, "b": 7, None: 50, "c": 1}[g])]
    rows.append(("empty", None))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", probs).collect()}
    for g in ("a", "b", None, "c"):
        own = [x for k, x in rows if k == g and x is not None]
        if own:
            np.testing.assert_allclose(got[g], np.quantile(own, probs), rtol=1e-12)
    assert "empty" not in got


def test_no_task_holds_a_group_of_distinct_values(spark):
    df = spark.range(20_000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 20_000).cast("double").alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put into one range
    try:
        spread = ranged(df.select(F.struct("g").alias("_g"), F.col("x").alias("_x")), ["_g", "_x"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spread.groupBy("_range").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 20_000 / 4
    assert quantiles(df, ["g"], "x", [0.25, 0.5]).first()["q"] == [4999.75, 9999.5]
    # the plan looks into ranges, with a group's range as the window's key, and has no percentile over a group
    plan = quantiles(df, ["g"], "x", [0.5])._jdf.queryExecution().toString()
    assert "percentile" not in plan
