"""Document quality: histogram gradient-boosted trees over statistics of the text.

Statistics (lengths, shares of kinds of characters, words and lines, repetition) are computed for whole texts, many texts at a
time, on byte arrays.  The trees are grown on a sample of at most ``SAMPLE`` labelled documents (those with the
smallest hashes of their ids): features are cut into ``BINS`` quantile bins, and each node takes the split with the best
gain from histograms of gradients.  Fitted trees are complete trees flattened into arrays, which all documents of a batch
descend at once.  Only the text enters a score.

Defined results: a null text has the statistics of the empty text; without labelled rows every score is 0.5, with one
class only it is the smoothed share of that class; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import drop_memo
from tonality.llm.minhash import parts, word_hashes

SAMPLE = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
L2 = 2.0
LEAST_ROWS = 5

_SIGNS = b"|#$%&*!?.,;:-_<>@=/\\\"'()[]{}~^+"
_LINE = np.zeros(256, bool)
_LINE[10] = True
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sign, 5 space, 6 newline, 7 beyond ASCII, 8 control
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KIND[:32], _KIND[127] = 8, 8
_KIND[[32, 9, 11, 12, 13]] = 5
_KIND[10] = 6
_KIND[128:] = 7


def _repetition(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the most frequent value's count, for each of ``n`` owners."""
    distinct, most = np.zeros(n), np.zeros(n)
    if len(values):
        order = np.lexsort((values, owner))
        o, v = owner[order], values[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(v)))
        distinct = np.bincount(o[at], minlength=n).astype(float)
        np.maximum.at(most, o[at], runs)
    return distinct, most


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of statistics for each text."""
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    begins = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * 9 + _KIND[data], minlength=9 * n).reshape(n, 9).astype(float)
    hashes, at = word_hashes(data, begins[:-1])
    word_owner = np.searchsorted(begins, at, "right") - 1
    words = np.bincount(word_owner, minlength=n).astype(float)
    cut_after = np.append(at, len(data))[1:]
    gap = _KIND[data]
    solid = np.cumsum(np.concatenate([[0], (gap != 5) & (gap != 6)]))
    length = solid[np.minimum(cut_after, begins[word_owner + 1])] - solid[at] if len(at) else np.empty(0)
    upper = np.cumsum(np.concatenate([[0], gap == 2]))
    sign = np.cumsum(np.concatenate([[0], gap == 4]))
    digit = np.cumsum(np.concatenate([[0], gap == 3]))
    end = at + length.astype(np.int64)
    caps = (upper[end] - upper[at]) >= np.maximum(2, 0.6 * length) if len(at) else np.empty(0, bool)
    signs = sign[end] - sign[at] if len(at) else np.empty(0)
    digits = digit[end] - digit[at] if len(at) else np.empty(0)

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(word_owner, flags, minlength=n) / np.maximum(words, 1)

    double = np.zeros(len(data), bool)
    if len(data) > 1:
        double[1:] = (data[1:] == data[:-1]) & (gap[1:] == 4) & (owner[1:] == owner[:-1])
    distinct, most = _repetition(word_owner, hashes, n)
    pair_ok = word_owner[1:] == word_owner[:-1]
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[pair_ok]
    pair_distinct, pair_most = _repetition(word_owner[1:][pair_ok], pairs, n)
    n_pairs = np.maximum(words - 1, 1)
    line_hash, line_at = word_hashes(data, begins[:-1], _LINE)
    line_owner = np.searchsorted(begins, line_at, "right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(float)
    line_distinct, line_most = _repetition(line_owner, line_hash, n)
    total = np.maximum(size, 1)
    marks = np.zeros(256, np.int64)
    marks[list(_SIGNS)] = np.arange(1, len(_SIGNS) + 1)
    by_sign = np.bincount(owner * (len(_SIGNS) + 1) + marks[data], minlength=n * (len(_SIGNS) + 1)).reshape(n, -1)[:, 1:]
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(lines), words / np.maximum(lines, 1), per_word(length),
        *(kinds / total[:, None]).T,
        per_word(length <= 2), per_word(length >= 12), per_word(length >= 30), per_word(caps), per_word(signs >= 2),
        per_word(signs >= 1), per_word(digits >= 1), np.bincount(owner, double, minlength=n) / np.maximum(words, 1),
        distinct / np.maximum(words, 1), most / np.maximum(words, 1), pair_distinct / n_pairs, pair_most / n_pairs,
        line_distinct / np.maximum(lines, 1), line_most / np.maximum(lines, 1),
        *(by_sign / np.maximum(words, 1)[:, None]).T,
    ]
    return np.column_stack(columns)


@dataclass
class Trees:
    """Complete trees, flattened: row t holds tree t's inner nodes in breadth-first order, then its leaves' values."""

    base: float
    feature: np.ndarray    # (trees, 2^depth - 1)
    threshold: np.ndarray  # (trees, 2^depth - 1); a row goes right if its value is larger
    leaf: np.ndarray       # (trees, 2^depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.base)
        if len(self.leaf) and len(x):
            node = np.zeros((len(x), len(self.leaf)), np.int64)
            tree, row = np.arange(len(self.leaf))[None], np.arange(len(x))[:, None]
            for _ in range(self.leaf.shape[1].bit_length() - 1):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            total = total + self.leaf[tree, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boost ``trees`` trees on statistics ``x`` and labels ``y`` (0 or 1)."""
    inner, none = 2**depth - 1, np.zeros((0, 2**depth - 1))
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, none.astype(np.int64), none, np.zeros((0, 2**depth)))
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    offsets = np.arange(d) * BINS
    feature, threshold, leaf = [], [], []
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (d * BINS) + offsets + binned).ravel()
            sums = [np.bincount(cell, np.repeat(w, d), minlength=width * d * BINS).reshape(width, d, BINS)
                    for w in (g, h, np.ones(n))]
            left = [s.cumsum(2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            right = [a - b for a, b in zip(total, left, strict=True)]
            gain = (left[0]**2 / (left[1] + L2) + right[0]**2 / (right[1] + L2) - total[0]**2 / (total[1] + L2))
            gain[(left[2] < LEAST_ROWS) | (right[2] < LEAST_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    f[first + k], t[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        at = node - inner
        value = -RATE * np.bincount(at, g, minlength=inner + 1) / (np.bincount(at, h, minlength=inner + 1) + L2)
        margin += value[at]
        feature.append(f)
        threshold.append(t)
        leaf.append(value)
    return Trees(base, np.array(feature), np.array(threshold), np.array(leaf))


def held_out(doc_id: Column, parts_of: int = 3, held: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the remainder that is not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts_of == held, F.lit(False))


def _statistics_of(texts: pd.Series) -> np.ndarray:
    raw = [t or b"" for t in texts]
    return np.concatenate([statistics(raw[p]) for p in parts(raw)]) if raw else np.zeros((0, 1))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees for ``quality``, learned from labelled documents outside the held-out fold; at most ``sample`` of them."""
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(sample))
    # at most ``sample`` rows are broadcast
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("label_id", "quality", "text")
    kind = labels.schema["doc_id"].dataType.simpleString()

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame[["label_id", "quality"]].assign(x=list(_statistics_of(frame["text"])))

    # repeated rows of an id count once, so that no more than ``sample`` rows reach the driver
    rows = (texts.mapInPandas(measure, f"label_id {kind}, quality int, x array<double>")
            .groupBy("label_id", "quality").agg(F.min("x").alias("x")).toPandas())
    if not len(rows):
        return grow(np.zeros((0, 1)), np.zeros(0))
    x, y = np.array(rows["x"].tolist()), rows["quality"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of arrival
    return grow(x[order], y[order])


def score(text: Column, model: Trees) -> Column:
    """Score of a text column, 0 to 1."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        drop_memo()
        for texts in batches:
            yield pd.Series(model.score(_statistics_of(texts)), dtype="float64")

    return scored(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document."""
    scores = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                         score(F.col("text"), fit(docs, labels)).alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
