"""Sharding by fixed virtual slots, with a versioned slot-to-shard map.

Every record hashes into one of ``n_slots`` virtual slots (thousands; fixed for the life of the data
set).  The bytes of each slot are summed; the map gives each slot a shard and is all that changes when
shards are added: ``grown`` moves whole slots from the old shards to the new one and nothing else.

Everything is Spark expressions.  The only tables gathered in one task are the slot totals and the map,
which hold ``n_slots`` rows at any input size.

Defined results: a null text has size 1 and checksum 0; an empty table gives no rows; rows equal in id and
text share a slot (they are interchangeable); a null id is hashed as such; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 4096
N_SHARDS = 8


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot`` of each document."""
    thin = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    return thin.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int"))


def slot_totals(recs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``vslot, bytes, n_rows`` for each of the ``n_slots`` slots, empty ones included."""
    sums = recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    every = recs.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(sums, "vslot", "left").na.fill(0, ["bytes", "n_rows"])


def first_map(totals: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1 of the map: the largest slots first, each to the shard with the fewest bytes so far."""
    def place(acc: Column, slot: Column) -> Column:
        loads = acc["loads"]
        to = F.array_position(loads, F.array_min(loads)).cast("int")
        return F.struct(
            F.transform(loads, lambda v, i: F.when(i + 1 == to, v + slot["bytes"]).otherwise(v)).alias("loads"),
            F.array_append(acc["picks"], to - 1).alias("picks"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"),
                     F.array().cast("array<int>").alias("picks"))
    # one row per slot: n_slots rows whatever the input's size
    one = totals.agg(F.sort_array(F.collect_list(F.struct("bytes", "vslot", "n_rows")), asc=False).alias("slots"))
    placed = one.select("slots", F.aggregate("slots", start, place)["picks"].alias("picks"))
    return placed.select(F.explode(F.arrays_zip("slots", "picks")).alias("p")).select(
        F.lit(1).alias("version"), F.col("p.slots.vslot").alias("vslot"), F.col("p.picks").alias("shard"),
        F.col("p.slots.bytes").alias("bytes"), F.col("p.slots.n_rows").alias("n_rows"))


def grown(slot_map: DataFrame) -> DataFrame:
    """The next version with one more shard, which takes slots from the others until all hold near equal bytes.

    A slot either stays or moves to the new shard.
    """
    by_shard = Window.partitionBy("shard")
    whole = Window.partitionBy()  # n_slots rows
    n_new = F.max("shard").over(whole) + 2
    spare = F.sum("bytes").over(by_shard) - F.sum("bytes").over(whole) / n_new
    given = F.sum("bytes").over(by_shard.orderBy(F.xxhash64("vslot", "version"), "vslot"))
    moves = (F.col("bytes") > 0) & (given - F.col("bytes") / 2 <= spare)  # to the nearest slot
    return slot_map.select(
        (F.col("version") + 1).alias("version"), "vslot",
        F.when(moves, n_new - 1).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "n_rows")


def store(slot_map: DataFrame, path: str) -> None:
    """Add a version of the map to the table at ``path``; a version once written is never changed."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the newest by default."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def assign(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's ``shard`` and its place ``slot`` there, gapless from 0.

    The place is the number of rows in the shard's earlier virtual slots plus the rank in the record's own
    slot, so no task sees a whole shard.  The map (``n_slots`` rows) is broadcast.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.select("vslot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (recs.withColumn("rank", F.row_number().over(within) - 1)
            .join(F.broadcast(placed), "vslot")
            .withColumn("slot", (F.col("base") + F.col("rank")).cast("long"))
            .drop("base", "rank"))
