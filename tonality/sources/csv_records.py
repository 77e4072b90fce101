"""Quoted CSV whose fields may hold line breaks, read by many tasks from one file.

Whether a line starts inside a quoted field follows from the number of quotes before it (a doubled quote counts twice and
changes nothing), so two passes suffice:

1. each split of a file counts its quotes; a running sum over the splits tells which of them start inside a field;
2. each split puts its lines together to records.  Where a record goes over the end of a split, its parts are brought
   together: at most two parts for each split.

A quote inside a field that is not quoted is not valid CSV; a file with an odd number of quotes fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonality.session import is_small, materialize

#: Two numbers name a split; so many may be shipped to every executor.
MAX_SPLITS = 1_000_000


class _Assembler:
    """The records and parts of records of one split after the other, from its lines in order."""

    def __init__(self, odd: bool, first: bool) -> None:
        self.odd = odd              # inside a quoted field
        self.kind = "head" if odd else None
        self.first = first
        self.lines: list[str] = []

    def _take(self, out: list, kind: str | None) -> None:
        if self.kind is not None:
            out.append((kind, self.first and self.kind != "head", "\n".join(self.lines)))
            self.first = self.first and self.kind == "head"
        self.lines = []

    def add(self, lines: list[str], quotes: np.ndarray, out: list) -> None:
        inside = (int(self.odd) + np.concatenate([[0], np.cumsum(quotes)])) % 2
        starts = np.flatnonzero(inside[:-1] == 0)
        at = 0
        for s in starts.tolist():
            self.lines += lines[at:s]
            self._take(out, self.kind)
            self.kind, at = "record", s
        self.lines += lines[at:]
        self.odd = bool(inside[-1])

    def end(self, out: list) -> None:
        """What is open at the end of a split goes on in the next one."""
        self._take(out, "tail" if self.odd and self.kind == "record" else self.kind)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, own, out = None, None, []

    def batch(key: tuple) -> pa.RecordBatch:
        file, block, folders = key
        n = len(out)
        kinds, firsts, records = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([
            pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([folders] * n, pa.list_(pa.string())),
            pa.array(kinds, pa.string()), pa.array(firsts, pa.bool_()), pa.array(records, pa.string())],
            ["file", "block", "folders", "kind", "first", "record"])

    for b in batches:
        col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
        files, blocks = col["file"], col["block"].to_numpy(zero_copy_only=False)
        quotes = pc.count_substring(col["value"], '"').to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1 if len(b) else []
        if pc.count_distinct(files).as_py() > 1:  # neighbouring files may start at the same place
            changes = [i for i in range(1, len(b)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]]
        for i, j in zip([0, *changes], [*changes, len(b)], strict=True):
            if i == j:
                continue
            key = (files[i].as_py(), int(blocks[i]), col["folders"][i].as_py())
            if key != now:
                if own is not None:
                    own.end(out)
                    if out:
                        yield batch(now)
                now, own = key, _Assembler(col["odd"][i].as_py(), key[1] == 0)
            own.add(col["value"].slice(i, j - i).to_pylist(), quotes[i:j], out)
            if out:
                yield batch(now)
    if own is not None:
        own.end(out)
        if out:
            yield batch(now)


def csv_records(spark: SparkSession, path: str | list[str], folders: Sequence[str] = ()) -> DataFrame:
    """``file, first, record`` and the values of the partition ``folders`` (strings): the records of CSV files as text, ``first``
    marking a file's first."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("value", *folders)])
    lines = spark.read.schema(schema).option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.array(*[F.col(c) for c in folders]).cast("array<string>").alias("folders"))
    split = [F.xxhash64("file").alias("f"), F.col("block").alias("b")]
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sums = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))  # a row for each split
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("n").over(Window.partitionBy("file"))
    fail = F.raise_error(F.concat(F.lit("a quoted field is not closed in "), F.col("file"))).cast("long")
    inside = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) + F.when(whole % 2 == 1, fail).otherwise(0))
    odd = materialize(inside.where(F.col("before") % 2 == 1).select(*split, F.lit(True).alias("odd")))
    keyed = lines.withColumns({"f": F.xxhash64("file"), "b": F.col("block"), "id": F.monotonically_increasing_id()})
    if is_small(odd, MAX_SPLITS):
        marked = keyed.join(F.broadcast(odd), ["f", "b"], "left")  # rows stay in the order of the scan
    else:
        marked = keyed.join(odd, ["f", "b"], "left").repartition("f", "b").sortWithinPartitions("f", "b", "id")
    marked = marked.select("value", "file", "block", "folders", F.coalesce("odd", F.lit(False)).alias("odd"))
    parts = marked.mapInArrow(_assemble, "file string, block long, folders array<string>, kind string, first boolean, record string")
    names = [F.col("folders")[i].alias(c) for i, c in enumerate(folders)]
    complete = parts.where("kind = 'record'").select("file", "first", "record", *names)
    # a record that goes over the end of a split: its tail, and the heads of the splits after it
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == "tail")
    pieces = parts.where("kind <> 'record'").withColumn("nth", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    joined = pieces.groupBy("file", "nth").agg(
        F.first("folders").alias("folders"), F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "record"))).alias("p"))
    return complete.unionByName(joined.select(
        "file", "first", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"), *names))


#: Options of the reader that concern a file and not a record.
_OF_FILES = ("header", "enforceSchema", "lineSep", "encoding", "inferSchema")


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, folders: Sequence[str] = (), **options) -> DataFrame:
    """The rows of CSV files under ``schema`` (the files' columns in their order), the values of the partition ``folders`` and the
    path of each row's file in ``_file``.  A file whose header has other names fails the job; empty lines are passed over."""
    records = csv_records(spark, path, folders).where(F.col("record").rlike(r"[^\r]"))
    own = {k: v for k, v in options.items() if k not in _OF_FILES}
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    header = F.from_csv("record", _ddl(text), own)
    names = F.array(*[header[f.name] for f in schema.fields])
    same = F.coalesce(names == F.lit([f.name for f in schema.fields]), F.lit(False))
    fail = F.raise_error(F.concat(F.lit("another header in "), F.col("file"), F.lit(": "), F.col("record"))).cast("boolean")
    rows = records.where(F.when(F.col("first"), F.when(same, F.lit(False)).otherwise(fail)).otherwise(F.lit(True)))
    parsed = rows.select(F.from_csv("record", _ddl(schema), own).alias("_r"), *folders, F.col("file").alias("_file"))
    return parsed.select(*[F.col("_r")[f.name].alias(f.name) for f in schema.fields], *folders, "_file")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
