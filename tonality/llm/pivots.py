"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its ``NEAREST`` reference points (pivots) out of ``PIVOTS``; vectors close to each other
share most of them.  Each vector is posted in one inverted list for every combination of ``SHARED`` of its nearest
pivots, so that two vectors meet if and only if their shared-pivot count is at least ``SHARED``.  Lists are
kept per label and cut into blocks; each pair of blocks is a task that verifies its pairs by cosine in double
precision.  A pair that meets in several lists counts in the one of its smallest shared pivots.  Tasks return a
vector's number of links and links enough to connect it, never all pairs.

Pivots are taken from a sample of at most ``SAMPLE`` vectors, each unlike (cosine below ``APART``) the pivots before it, so
that a crowd of near-equal vectors yields one pivot.  Every vector is indexed; no list is capped.  Equal vectors of a label
are one class with a multiplicity.  Recall is that of the index; see the tests and the README.

Defined results: a vector that is null, zero, empty, or holds null or non-finite numbers, or whose label is null, links
with nothing; vectors of different lengths are never compared; a null id takes part but names no component; repeated rows
count as different vectors with equal values; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import components, cut

PIVOTS = 128
NEAREST = 6
SHARED = 3
SAMPLE = 4096
APART = 0.6
BLOCK = 256


def _valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: list) -> np.ndarray:
    """The vectors in double precision, scaled to length 1."""
    x = np.asarray([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for each length of vector, from a sample of bounded size on the driver."""
    sample = (classes.select("dim", "vec", F.xxhash64("class", "label").alias("h")).orderBy("h").limit(SAMPLE)
              .select("dim", "vec").toPandas())
    found = {}
    for dim, own in sample.groupby("dim"):
        picked: list[np.ndarray] = []
        for v in unit(own["vec"].tolist()):
            if len(picked) < PIVOTS and (not picked or np.max(np.array(picked) @ v) < APART):
                picked.append(v)
        found[int(dim)] = np.array(picked)
    return found


def _descriptions(frame: pd.DataFrame, pivots: dict[int, np.ndarray]) -> tuple[list, list]:
    """The list keys and the pivot set (as two longs) of each vector."""
    keys: list = [None] * len(frame)
    sets: list = [None] * len(frame)
    for dim, rows in frame.groupby("dim", sort=False).indices.items():
        pv = pivots.get(int(dim))
        if pv is None or len(pv) < NEAREST:  # too few to tell vectors apart: one list, verified in full
            for i in rows:
                keys[i], sets[i] = [0], [0, 0]
            continue
        near = np.sort(np.argsort(-(unit(frame["vec"].iloc[rows].tolist()) @ pv.T), axis=1, kind="stable")[:, :NEAREST], 1)
        combos = np.array(list(combinations(range(NEAREST), SHARED)))
        packed = np.zeros((len(rows), len(combos)), np.int64)
        for c in range(SHARED):
            packed = packed * PIVOTS + near[:, combos[:, c]]
        bits = np.zeros((len(rows), PIVOTS), np.uint8)
        np.put_along_axis(bits, near, 1, 1)
        longs = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        for i, k, s in zip(rows.tolist(), packed, longs, strict=True):
            keys[i], sets[i] = k, s
    return keys, sets


def _first_shared(shared: np.ndarray, key: int) -> np.ndarray:
    """Whether ``key`` names the smallest ``SHARED`` bits of each row of shared pivot sets."""
    own = []
    for _ in range(SHARED):
        own.append(key % PIVOTS)
        key //= PIVOTS
    upto = np.zeros(PIVOTS, np.uint8)
    upto[:max(own) + 1] = 1
    mask = np.packbits(upto, bitorder="little").view(np.uint64)
    return np.bitwise_count(shared & mask).sum(-1) == SHARED


def _verify(key: int, side: np.ndarray, vecs: list, sets: np.ndarray, copies: np.ndarray, least: float
            ) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Number of links found for each row, and pairs of rows that connect them."""
    x = unit(vecs)
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    if side[0] >= 0:
        linked &= side[:, None] != side[None]
    counted = linked
    if sets.any():
        i, j = np.nonzero(linked)
        counted = np.zeros_like(linked)
        ok = _first_shared(sets[i] & sets[j], key)
        counted[i[ok], j[ok]] = True
    n = counted @ copies
    pairs, left = [], linked.any(1)
    while left.any():
        root = int(np.argmax(left))
        reach = np.zeros(len(x), bool)
        reach[root] = True
        front = reach.copy()
        while front.any():
            front = linked[front].any(0) & ~reach
            reach |= front
        pairs += [(root, int(k)) for k in np.flatnonzero(reach) if k != root]
        left &= ~reach
    return n, pairs


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vec_id, embedding, label``."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    label = vectors.schema["label"].dataType.simpleString()
    ok = F.col("label").isNotNull() & _valid(F.col("embedding"))
    rows = vectors.select("vec_id", "label", F.when(ok, F.col("embedding")).alias("vec"))
    # two hashes stand for a vector's value
    rows = rows.withColumns({"h1": F.xxhash64(F.lit(1), "vec"), "h2": F.xxhash64(F.lit(2), "vec"), "dim": F.size("vec")})
    keys = ["label", "dim", "h1", "h2"]
    classes = cut(rows.where("vec is not null").groupBy(*keys).agg(
        F.min("vec_id").alias("class"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
        .where("class is not null"))
    pivots = choose_pivots(classes)

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own, sets = _descriptions(frame, pivots)
            yield frame[["class", "label", "dim"]].assign(keys=own, pivots=sets)

    described = cut(classes.select("class", "label", "dim", "vec").mapInPandas(
        describe, f"class {kind}, label {label}, dim int, keys array<long>, pivots array<long>"))
    posts = described.select("class", "label", "dim", F.explode("keys").alias("key"))
    of = ["label", "dim", "key"]
    lists = posts.groupBy(*of).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn(
        "blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    listed = posts.join(lists, of).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = listed.select(*of, "class", "block", other.alias("other")).select(
        *of, "class", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    full = paired.join(described.select("class", "label", "dim", "pivots"), ["class", "label", "dim"]).join(
        classes.select("class", "label", "dim", "vec", "copies"), ["class", "label", "dim"])
    task = [*of, "low", "high"]
    dealt = full.repartition(*task).sortWithinPartitions(*task, "class")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of_task(g: pd.DataFrame) -> list[tuple]:
            ids, one = g["class"].tolist(), g["low"].iloc[0] == g["high"].iloc[0]
            side = np.full(len(g), -1) if one else (g["block"] == g["high"]).to_numpy().astype(int)
            if len(g) < 2 or not one and (side.all() or not side.any()):
                return []
            sets = np.array(g["pivots"].tolist(), np.int64).view(np.uint64)
            n, pairs = _verify(int(g["key"].iloc[0]), side, g["vec"].tolist(), sets, g["copies"].to_numpy(), least)
            return [(ids[i], None, int(n[i])) for i in np.flatnonzero(n)] + [(ids[i], ids[j], 0) for i, j in pairs]

        rest = None
        for frame in frames:
            if rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            marks = frame[task].to_numpy()
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist()]
            out = [x for i, j in zip(edges, edges[1:], strict=False) for x in of_task(frame.iloc[i:j])]
            rest = frame.iloc[edges[-1]:]  # may go on in the next frame
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "n"], dtype=object)
        if rest is not None and len(rest) and (out := of_task(rest)):
            yield pd.DataFrame(out, columns=["a", "b", "n"], dtype=object)

    found = cut(dealt.mapInPandas(work, f"a {kind}, b {kind}, n long"))
    counts = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    joined = components(found.where("b is not null").select("a", "b"))
    named = (classes.drop("vec").join(counts, "class", "left").join(joined.withColumnRenamed("node", "class"), "class", "left")
             .select(*keys, (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "class").alias("component_id")))
    result = rows.drop("vec").join(named, keys, "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.cast("long").alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
