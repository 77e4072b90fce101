"""Mixing against a plain-Python version: water levels by rounds, seats by a heap, blocks word by word."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tonality.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int, taken string, shard string"


def frame(spark, rows):
    """Documents with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, s, "x", 1, "y", "z") for i, t, s in rows], SCHEMA)


def water(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full, out = share * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return out
        level = left / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * level > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in rest}
        for s in over:
            full.add(s)
            out[s] = float(most * sizes[s])
            left -= out[s]


def seats(votes, n, most, order):
    """Highest quotients one after the other."""
    got = dict.fromkeys(votes, 0)
    heap = [(-votes[p], i, p) for i, p in enumerate(order) if votes[p] > 0 and most[p] > 0]
    heapq.heapify(heap)
    for _ in range(n):
        if not heap:
            break
        _, i, p = heapq.heappop(heap)
        got[p] += 1
        if got[p] < most[p]:
            heapq.heappush(heap, (-votes[p] / (2 * got[p] + 1), i, p))
    return got


def check(spark, docs, **parameters):
    recs = mixing.records(docs)
    dealt, quotas = mixing.plan(recs, **parameters)
    sizes = {r["source"]: r["s"] for r in recs.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    want = water(sizes)
    total = sum(sizes.values())
    block = max(1, min(parameters.get("block_words", mixing.BLOCK_WORDS), total // parameters.get("blocks", mixing.BLOCKS)))
    by = {}
    for r in dealt.collect():
        by.setdefault((r["source"], r["shard"]), []).append(r)
    words = {k: sum(r["size"] for r in v) for k, v in by.items()}
    n_blocks = {k: max(1, int(w / block + 0.5)) if w else 0 for k, w in words.items()}
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    most = {s: 2 * sum(n for k, n in n_blocks.items() if k[0] == s) for s in names}
    of_source = seats({s: want[s] for s in names}, round(1.5 * total / block), most, names)
    quota = {}
    for s in names:
        own = sorted(k for k in words if k[0] == s)
        quota |= seats({k: words[k] for k in own}, of_source[s], {k: 2 * n_blocks[k] for k in own}, own)
    assert {(r["source"], r["shard"]): r["quota"] for r in quotas.collect()} == quota
    # blocks, word by word
    marks = [(k, b) for k, n in n_blocks.items() for b in range(n)]
    hashed = spark.createDataFrame([(*k, b) for k, b in marks], "source string, shard int, b long").withColumn(
        "h", mixing.block_hash(mixing.SEED, F.col("source"), F.col("shard"), F.col("b"))).collect()
    hashes = {((r["source"], r["shard"]), r["b"]): r["h"] for r in hashed}
    expected = []
    for k, rows in by.items():
        n, w = n_blocks[k], words[k]
        extra = set(sorted(range(n), key=lambda b: (hashes[k, b], b))[:quota[k] % n]) if n else set()
        starts = [b * w // n for b in range(n)] + [w]
        times = [quota[k] // n + (b in extra) for b in range(n) for _ in range(starts[b], starts[b + 1])]
        at = 0
        for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"])):
            expected.append((r["doc_id"], r["size"], sizes[k[0]], k[0], sum(times[at:at + r["size"]])))
            at += r["size"]
    got = mixing.mix(docs, **parameters).collect()
    assert sorted([(r["doc_id"], r["size"], r["source_size"], r["source"], r["taken"]) for r in got], key=repr) == sorted(expected, key=repr)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(want[r["source"]])
    taken = {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 2 * block + 1
    return got


def documents(rng, n, hot=0.4):
    out = []
    for i in range(n):
        s = "hot" if rng.random() < hot else rng.choice(["a", "b", "é", "😀", "￿", None, "z"])
        words = rng.choice([0, 1, 5, 30, 200])
        out.append((i if rng.random() > 0.02 else None, rng.choice([None, "", " \t"]) if not words else " ".join(f"w{rng.randrange(99)}" for _ in range(words)), s))
    return out + out[:5]


def test_mix_against_plain_python(spark):
    docs = frame(spark, documents(random.Random(4), 400))
    check(spark, docs)                                          # blocks of one word
    got = check(spark, docs, blocks=500, shard_rows=40)         # several shards for each source
    assert len({r["shard"] for r in got if r["source"] == "hot"}) > 3
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7), blocks=500, shard_rows=40).collect()))


def test_targets_stop_at_twice_their_source(spark):
    docs = frame(spark, [(1, "a " * 10, "x"), (2, "b " * 10, "y"), (3, "c " * 10, "z")])
    got = {r["source"]: r for r in mixing.mix(docs).collect()}
    assert got["x"]["target"] == 20 and got["x"]["taken"] == 20
    assert got["y"]["target"] == pytest.approx(25 / 3) and got["z"]["target"] == pytest.approx(50 / 3)
    assert got["y"]["taken"] in (8, 9) and got["z"]["taken"] in (16, 17)


def test_mix_of_edge_cases(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    got = mixing.mix(frame(spark, [(1, None, None), (1, None, None), (2, "", "a"), (None, " ", "a")])).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in got] == [(0, 0, 0.0, 0)] * 4
    one = mixing.mix(frame(spark, [(7, "one two three \x1c four", "s")])).first()  # only ASCII blanks separate words
    assert (one["size"], one["target"], one["taken"]) == (4, 6.0, 6)
    long = mixing.mix(frame(spark, [(1, "word " * 200_000, "s"), (2, "w", "s")])).collect()
    assert sorted(r["size"] for r in long) == [1, 200_000] and abs(sum(r["taken"] for r in long) - 300_001.5) < 5


def test_the_query_covers_its_table(spark):
    from tonality.llm.queries import op13_sainte_lague_mix
    rows = op13_sainte_lague_mix(spark, "/root/testdata/sf0.001")
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    sums = rows.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r["k"] - r["t"]) <= 5 for r in sums)
