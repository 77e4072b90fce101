"""Sinks: lossless CSV, JSON Lines, and the per-episode statistics document.

Output layout: one directory per episode (``partitionBy("Episode")``), replaced
on rerun (``mode("overwrite")``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Options that make a CSV round trip lossless (quotes, separators and line
# breaks inside text; blanks kept; empty string kept apart from NULL).
CSV_WRITE_OPTIONS = {
    "header": "true",
    "escape": '"',
    "quote": '"',
    "quoteAll": "true",
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
    "lineSep": "\n",
}


def write_csv(df: DataFrame, path: str, partition_by: str | None = "Episode",
              mode: str = "overwrite") -> None:
    w = df.write.mode(mode).options(**CSV_WRITE_OPTIONS)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def write_json(df: DataFrame, path: str, partition_by: str | None = "Episode",
               mode: str = "overwrite") -> None:
    """JSON Lines (splittable), one object per row."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def write_document(doc: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per episode (column ``document`` of ``statistics_document``)."""
    doc.select("Episode", F.col("document").alias("value")).write.mode(mode) \
        .partitionBy("Episode").text(path)
