"""Utterance sources: CSV / Parquet files with an explicit schema, and bindings
of the driver's tables (``documents``, ``conversations``) to the utterance shape.

Utterance shape: ``Episode STRING, SentenceIndex BIGINT, Character DOUBLE (nullable
code), Text STRING`` plus any pass-through columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonality.schema import UTTERANCE, require_columns
from tonality.sources.csv_records import read_csv

# Options that read back exactly what ``sources.sinks.write_csv`` writes
# (quoted fields with commas / line breaks, empty string kept apart from NULL).
CSV_READ_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "escape": '"',
    "quote": '"',
    "nullValue": "\\N",
    "lineSep": "\n",
    "encoding": "UTF-8",
    "mode": "FAILFAST",
}

# The episode's number in the name of its file, or of its folder of part files.
DEFAULT_EPISODE_PATTERN = r"(?:^|/)HPE(\d+)\.[^./]+(?:/part-[^/]*)?$"


def episode_from_path(pattern: str = DEFAULT_EPISODE_PATTERN, path: Column | None = None) -> Column:
    """The episode in the path of a row's file (by default that of its scan); a path without one fails the job."""
    path = F.col("_metadata.file_path") if path is None else path
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no episode in the path "), path)))


def _csv_schema(spark: SparkSession, path: str | list[str], options: dict) -> tuple[T.StructType, list[str]]:
    """The file's own columns in their order, utterance columns with their types and all others as strings, and the names of the
    partition folders."""
    folders = [c for c in spark.read.text(path).columns if c != "value"]
    named = [c for c in spark.read.options(**options).csv(path).columns if c not in folders]
    known = {f.name: f.dataType for f in UTTERANCE} | {"Episode": T.StringType()}
    missing = [f.name for f in UTTERANCE if f.name not in named]
    if missing:
        raise ValueError(f"missing required columns {missing}; have {named}")
    return T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in named]), folders


def read_utterances(spark: SparkSession, path: str | list[str], fmt: str = "csv",
                    episode_pattern: str | None = DEFAULT_EPISODE_PATTERN, **options) -> DataFrame:
    """Read one or many utterance files in one scan.

    CSV columns are found by the header, in any order; further columns pass through as strings.  All files of one scan
    must have the same header (a file with another one fails the job).  ``Episode`` comes from a
    column or partition folder ``Episode=<n>`` as the string it is there, else from the file name by
    ``episode_pattern`` (``HPE3.csv`` -> ``3``).  Quoted fields may hold line breaks; a file is still read by as many tasks as it
    has splits (``csv_records``).
    """
    if fmt == "csv":
        options = {**CSV_READ_OPTIONS, "enforceSchema": "false", **options}
        schema, folders = _csv_schema(spark, path, options)
        df = read_csv(spark, path, schema, folders, **options)
    else:
        df = spark.read.options(**options).format(fmt).load(path).withColumn("_file", F.col("_metadata.file_path"))
    require_columns(df, "SentenceIndex", "Character", "Text")
    if "Episode" not in df.columns:
        if episode_pattern is None:
            raise ValueError("no Episode column and no episode_pattern")
        df = df.withColumn("Episode", episode_from_path(episode_pattern, F.col("_file")))
    return df.select(F.col("Episode").cast("string").alias("Episode"), *[c for c in df.columns if c not in ("Episode", "_file")])


def bind_documents(documents: DataFrame) -> DataFrame:
    """``documents`` -> utterances (3 episodes, codes 0..5 from the source id; 0 = no main speaker)."""
    return documents.select(
        (F.lit(1) + F.col("doc_id") % 3).cast("string").alias("Episode"),
        F.col("doc_id").alias("SentenceIndex"),
        F.nullif(F.expr("substring(source, 4)").cast("int") % 6, F.lit(0))
         .cast("double").alias("Character"),
        F.col("text").alias("Text"),
    )


def bind_conversations(conversations: DataFrame) -> DataFrame:
    """``conversations`` -> utterances (episode = conversation, 1 = user, 2 = assistant)."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("Episode"),
        F.col("turn").alias("SentenceIndex"),
        F.when(F.col("role") == "user", F.lit(1.0))
         .when(F.col("role") == "assistant", F.lit(2.0)).alias("Character"),
        F.col("text").alias("Text"),
    )


#: Rows of a task that are not worth a shuffle of their texts.
TASK_ROWS = 4096


def dealt_out(df: DataFrame) -> DataFrame:
    """The rows dealt out over all cores where single tasks of the scan would get most of them: a file of one row group is read by one
    task, whatever its size.  Looks at the rows by task first (of Parquet: at the footers)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    by_task = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    most, rows = by_task.agg(F.max("n"), F.sum("n")).first()
    if most is None or most <= TASK_ROWS or most * cores <= 2 * rows:
        return df
    return df.repartition(max(2 * cores, -(-rows // TASK_ROWS)))


def utterances_from_table(spark: SparkSession, sf_dir: str, table: str = "documents",
                          partitions: int | None = None) -> DataFrame:
    """A table as utterances; ``partitions`` deals it out anew by the caller's choice, else large uneven splits are (``dealt_out``)."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "documents":
        out = bind_documents(df)
    elif table == "conversations":
        out = bind_conversations(df)
    else:
        raise ValueError(f"no utterance binding for table {table!r}")
    return out.repartition(partitions) if partitions else dealt_out(out)
