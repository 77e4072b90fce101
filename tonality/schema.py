"""Declared schemas (never inferred) and the required-column check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Utterance file as written by the subtitle tooling: one row per line of dialogue.
UTTERANCE = T.StructType([
    T.StructField("SentenceIndex", T.LongType(), False),
    T.StructField("Character", T.DoubleType(), True),
    T.StructField("Text", T.StringType(), True),
])

UTTERANCE_KEYS = ("Episode", "SentenceIndex")

WORDLIST = T.StructType([T.StructField("word", T.StringType(), False)])

LEXICON = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("valence", T.DoubleType(), False),
])

BOOSTER = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("delta", T.DoubleType(), False),
])

CHARACTER_DIM = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
])

EPISODE_DIM = T.StructType([
    T.StructField("Episode", T.StringType(), False),
    T.StructField("Description", T.StringType(), True),
    T.StructField("Duration", T.StringType(), True),
])


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; have {df.columns}")
