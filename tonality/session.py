"""Session helpers: building a session, a shared folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table that may be shipped to every executor.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 << 20


def get_session(master: str | None = None, app: str = "tonality",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Session for local runs and tests; on a cluster the caller's session is used as is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the whole cluster
            builder = builder.config("spark.driver.memory",
                                     os.environ.get("TONALITY_DRIVER_MEMORY", "8g"))
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only in local mode with none set (tests) a fresh folder is created; elsewhere that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="tonality-ckpt-")
    sc.setCheckpointDir(conf)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tonality-out/{name}-{uuid.uuid4().hex}"


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether ``df`` is proven to have few rows and few bytes (reads at most ``max_rows`` + 1 rows)."""
    width = F.length(F.to_json(F.struct(*df.columns)))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def sized_broadcast(df: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast only when its size is proven to be small.

    Beyond the bounds the table is returned unchanged, so the planner picks a
    shuffle join (with AQE skew-join handling) instead.
    """
    return F.broadcast(df) if is_small(df) else df


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
