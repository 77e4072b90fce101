"""Helpers the operators share: cutting lineage in the shared folder, connected components, row packing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only in local mode with none set."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tonality-llm-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from files in the shared folder, which survive a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges ``(a, b)``: rows ``(node, component)``.

    ``component`` is the smallest node reachable.  Alternates the large-star and
    small-star steps; every step groups by node with partial minima, so a hub's
    edges meet in no single task before they are reduced.  Nodes without an edge
    are not returned; null ends and loops are ignored.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
              .distinct())
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: the smaller neighbours of a node, and the node, point to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = cut(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


_memo: dict[Hashable, Any] = {}


def worker_memo(key: Hashable, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps under ``key`` (a tokenizer, a model with its memo), made when first asked for.

    Workers serve one stage after another; a worker keeps one entry, so that a stage does not carry the last one's memory.
    """
    if key not in _memo:
        _memo.clear()
        _memo[key] = make()
    return _memo[key]


def drop_memo() -> None:
    """Free what earlier stages left in this worker."""
    _memo.clear()
