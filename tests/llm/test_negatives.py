"""Hard negatives and their bounds against all pairs in plain Python."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tonality.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, id int, means string, rank string, score double"


def frame(spark, rows, kind="float"):
    """Vectors with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, c, "u", 1, "m", "r", 0.5) for i, v, c in rows], SCHEMA.replace("<float>", f"<{kind}>"))


def clamp(s):
    return min(max(s, -2 ** 63), 2 ** 63 - 1)


def slow(rows, single=True):
    own = []
    for i, v, c in rows:
        if c is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) if single else x for x in v]
        own.append((i, [math.floor(256 * x) for x in v], (c + 1) % 10 if i is not None and i % 7 == 0 else c))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for i, v, c in own:
        if i is None or i % 100:
            continue
        scored = [(j, clamp(sum(a * b for a, b in zip(v, w))), d) for j, w, d in own if len(w) == len(v)]
        same = sorted(((j, s) for j, s, d in scored if d == c and j != i), key=order)[:5]
        for j, s in same:
            fits = sorted(((n, t) for n, t, d in scored if d != c and 80 * s <= 100 * t <= 100 * s), key=order)[:5]
            out += [(i, j, r + 1, n, s, t) for r, (n, t) in enumerate(fits)]
    return sorted(out, key=repr)


def mined(df, **parameters):
    rows = negatives.mine(df, **parameters).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, rows.collect()), key=repr)


def clouds(rng, n, dim, labels=4):
    centre = rng.normal(size=dim)
    near = [centre + 0.4 * rng.normal(size=dim) for _ in range(labels)]
    return [(i, [float(x) for x in near[i % labels] + 0.3 * rng.normal(size=dim)], int(i % labels)) for i in range(n)]


def test_against_all_pairs(spark):
    rng, picks = np.random.default_rng(3), random.Random(3)
    rows = clouds(rng, 1500, 10)
    rows = [(i, v if picks.random() < 0.8 else rows[0][1], c) for i, v, c in rows]   # many equal vectors: ties by id
    rows += [(None, rows[3][1], 1), (None, rows[3][1], 2), (1600, rows[5][1][:4], 1), (1601, rows[5][1][:4], 1), (1602, rows[5][1][:4], 2)]
    rows += [(1700, None, 1), (1800, [1.0] * 10, None), (1900, [float("nan")] * 10, 1), (2000, [None] + [1.0] * 9, 1), (2100, [float("inf")] * 10, 1)]
    want = slow(rows)
    assert len(want) > 100
    df = frame(spark, rows)
    assert mined(df) == want
    assert mined(df.repartition(5), block_rows=200, block_anchors=4) == want


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.cumsum(rng.normal(size=(400, 37)), 1))  # neighbouring components are alike
    means, devs = negatives.summaries(x)
    block = negatives.Block(pd.DataFrame({"vec": list(x), "means": list(means.astype(np.float32)), "devs": list(devs.astype(np.float32)),
                                          "id": range(400), "named": True, "label": 0, "uid": range(400)}))
    exact = x @ x.T
    for level in range(len(negatives.LEVELS)):
        low, high = negatives._bounds(block, block, level, slice(0, 400), slice(None))
        assert (low <= exact).all() and (exact <= high).all()
    seen, scores = [], block.scores
    block.scores = lambda at, of, i: seen.append(len(at)) or scores(at, of, i)
    negatives.positives_of(block, block, 5)
    assert sum(seen) < 0.2 * 400 * 400


def test_repeated_rows_empty_tables_and_few_rows(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(100, [1.0, 0.0], 1)])) == []
    assert mined(frame(spark, [(100, [], 1), (101, [], 1), (102, [], 2)])) == [(100, 101, 1, 102, 0, 0)]
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (101, [1.0, 0.0], 1), (103, [0.9, 0.0], 2), (103, [0.9, 0.0], 2)]
    assert mined(frame(spark, rows)) == slow(rows) and len(slow(rows)) == 4
    # the label moves where the id is divisible by 7: 9 becomes 0
    assert mined(frame(spark, [(700, [1.0], 9), (1, [1.0], 0), (2, [0.9], 9)])) == [(700, 1, 1, 2, 65536, 58880)]
    # negative scores have an empty window
    assert mined(frame(spark, [(100, [1.0], 1), (101, [-1.0], 1), (102, [-1.0], 2)])) == []


@pytest.mark.parametrize("kind", ["float", "double"])
def test_large_components_are_exact(spark, kind):
    rows = [(100, [3e7, 1e5, 1.0], 1), (101, [3e7, 1e5, 2.0], 1), (102, [2.9e7, 1e5, 3.0], 2), (104, [1e30, 1e5, 3.0], 2), (106, [1e30, 1.0, 0.0], 1)]
    assert mined(frame(spark, rows, kind)) == slow(rows, kind == "float")


def test_the_query_against_all_pairs(spark):
    from tonality.llm.queries import op11_segment_negatives
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    got = op11_segment_negatives(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr) == slow(rows)
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["positive_score"] == "bigint"
