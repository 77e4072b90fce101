"""Sharding and boosted trees against plain versions of their own."""

import math
import random
import zlib
from itertools import product

import numpy as np
from pyspark.sql import functions as F


def test_shards_against_a_map_and_ranks_in_plain_python(spark):
    """The map, its growth and every place, from each record's virtual slot alone; ids and rows repeat and may be null."""
    from tonality.llm import sharding
    rng = random.Random(12)
    rows = [(rng.choice([None, i, i % 50]), rng.choice([None, "", "é" * rng.randrange(50), "word " * rng.randrange(400)])) for i in range(1500)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string").repartition(5)
    recs = sharding.records(docs, 256).cache()
    held = [tuple(r) for r in recs.select("vslot", "doc_id", "text_crc32", "size").collect()]
    assert len(held) == len(rows) + 40
    assert sorted(((i, c, s) for _, i, c, s in held), key=repr) == sorted(
        ((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows + rows[:40]), key=repr)

    total, count = [0] * 256, [0] * 256
    for v, _, _, s in held:
        total[v] += s
        count[v] += 1
    loads, shard = [0] * 8, {}
    for v in sorted(range(256), key=lambda v: (-total[v], -v)):
        shard[v] = loads.index(min(loads))
        loads[shard[v]] += total[v]
    first = sharding.first_map(sharding.slot_totals(recs, 256)).cache()
    assert {r["vslot"]: r["shard"] for r in first.collect()} == shard

    order = {r["vslot"]: r["h"] for r in first.select("vslot", F.xxhash64("vslot", "version").alias("h")).collect()}
    grown, even = {}, sum(total) / 9
    for s in range(8):
        given = 0
        for v in sorted((v for v in shard if shard[v] == s), key=lambda v: (order[v], v)):
            given += total[v]
            grown[v] = 8 if total[v] and given - total[v] / 2 <= loads[s] - even else s
    assert {r["vslot"]: r["shard"] for r in sharding.grown(first).collect()} == grown

    places = {s: 0 for s in range(8)}
    want = []
    for v in range(256):
        own = sorted((x for x in held if x[0] == v), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
        for x in own:
            want.append((*x, shard[v], places[shard[v]]))
            places[shard[v]] += 1
    got = [tuple(r) for r in sharding.assign(recs, first).select("vslot", "doc_id", "text_crc32", "size", "shard", "slot").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_flattened_trees_against_walks_from_the_root():
    from tonality.llm.quality import grow
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 5)).round(1)  # many equal values
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 0.7)).astype(float)
    model = grow(x, y, trees=12, depth=4)
    assert model.feature.shape == (12, 15) and model.leaf.shape == (12, 16)

    def walk(row):
        margin = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            margin += leaf[node - len(f)]
        return 1 / (1 + math.exp(-margin))

    edge = np.vstack([x[:200], model.threshold[np.isfinite(model.threshold)][:20, None].repeat(5, 1)])
    assert np.allclose(model.score(edge), [walk(r) for r in edge], rtol=0, atol=1e-12)
    assert model.score(np.zeros((0, 5))).shape == (0,)


def test_histogram_split_against_every_split():
    """A tree of depth one takes the split and the leaf values that a search over all rows' values finds best."""
    from tonality.llm import quality
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, size=(400, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=400) > 6).astype(float)
    model = quality.grow(x, y, trees=1, depth=1)
    base = math.log((y.sum() + 0.5) / (len(y) + 1) / (1 - (y.sum() + 0.5) / (len(y) + 1)))
    p = 1 / (1 + math.exp(-base))
    g, h = p - y, np.full(len(y), p * (1 - p))

    def half(mask):
        return g[mask].sum() ** 2 / (h[mask].sum() + quality.L2)

    gains = {}
    for j, t in product(range(3), range(12)):
        right = x[:, j] > t
        if min(right.sum(), (~right).sum()) >= quality.LEAST_ROWS:
            gains[j, t] = half(right) + half(~right) - half(right | ~right)
    best = max(gains.values())
    j, t = int(model.feature[0, 0]), float(model.threshold[0, 0])
    right = x[:, j] > t
    assert math.isclose(half(right) + half(~right) - half(right | ~right), best, rel_tol=1e-9)
    for mask, leaf in ((~right, model.leaf[0, 0]), (right, model.leaf[0, 1])):
        assert math.isclose(leaf, -quality.RATE * g[mask].sum() / (h[mask].sum() + quality.L2), rel_tol=1e-9)
