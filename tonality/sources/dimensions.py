"""Small in-memory dimensions (bounded by construction: a handful of rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonality.resources import CHARACTERS, EPISODES
from tonality.schema import CHARACTER_DIM, EPISODE_DIM


def characters_df(spark: SparkSession, rows=None) -> DataFrame:
    """Character dimension ``(code, name)``; dimension order is kept in ``ord``."""
    rows = rows if rows is not None else CHARACTERS
    df = spark.createDataFrame(list(rows), CHARACTER_DIM)
    return df


def episodes_df(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(list(rows if rows is not None else EPISODES), EPISODE_DIM)
