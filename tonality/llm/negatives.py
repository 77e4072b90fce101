"""Hard-negative mining by segment summary filtering.

A vector's components become the integers ``floor(256 x)``.  At each level of ``LEVELS`` a vector is cut into so many
segments, and each segment's mean and deviation are stored beside it.  With l components in a segment, the part of an
inner product that falls into it is ``l * mean * mean`` plus or minus ``l * deviation * deviation``, so a score lies between two
sums over segments.  An anchor first meets all rows of a block at the coarsest level; rows whose bounds show that they can
not be in the result are left, the others are bounded again with finer segments, and only what remains is scored exactly.

Positives: the anchor's ``K`` best rows of its label.  The K-th largest lower bound is what a row's upper bound has to
reach.  Negatives: for each score of a positive the ``K`` best rows of other labels between 80 and 100 % of it.  Rows whose bounds
lie inside this window are sure; the K-th largest lower bound of the sure rows is what the others have to reach.  Bounds are widened by
more than their rounding, so no row is lost; results are those of comparing all rows.

Rows are dealt into blocks of about ``BLOCK_ROWS`` and anchors into blocks of about ``BLOCK_ANCHORS``; each pair of blocks is one
group, whose size is bounded whatever a label's share of the rows.  Of each group an anchor's ``K`` best go on, and ``row_number``
picks from these, with Spark's limit of groups before the shuffle.

Defined results: rows without a label or vector, or with a null or non-finite component, take no part; vectors are
compared with those of their own length; a null id is no anchor, sorts last among equal scores, and may be a negative or
positive; rows of the anchor's own id are not its positives; each repeated row is a row (a repeated anchor
has its results as often); an anchor without positives, and a positive without negatives, have no rows; scores are exact, and beyond
the range of a long its end; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonality.llm.common import cut
from tonality.session import sized_broadcast

LEVELS = (8, 32)    # segments of a vector
K = 5
ANCHOR_EVERY = 100
BLOCK_ROWS = 16_384
BLOCK_ANCHORS = 4_096
AT_ONCE = 128       # anchors whose coarsest bounds are in memory together
NO_ID = (1 << 63) - 1
LONG = (-(1 << 63), (1 << 63) - 1)  # its end is 2^63 as a double
ROUNDING = 1e-5     # summaries are stored in single precision


def _valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def summaries(x: np.ndarray, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all levels, each times the root of the segment's length."""
    means, devs = [], []
    for m in levels:
        for part in np.array_split(np.arange(x.shape[1]), m):
            own = x[:, part].astype(np.float64)
            mean = own.mean(1) if len(part) else np.zeros(len(x))
            means.append(mean * np.sqrt(len(part)))
            devs.append(np.sqrt(((own - mean[:, None]) ** 2).sum(1)))
    return np.stack(means, 1), np.stack(devs, 1)


def described(vectors: DataFrame, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """``uid, id, named, label, dim, vec, means, devs`` of the rows that take part, with the shifted labels."""
    number = F.col("vec_id").cast("long")
    label = F.when(number % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("long")
    rows = vectors.where(F.col("label").isNotNull() & _valid(F.col("embedding"))).select(
        F.monotonically_increasing_id().alias("uid"), F.coalesce(number, F.lit(NO_ID)).alias("id"), number.isNotNull().alias("named"),
        label.alias("label"), F.size("embedding").alias("dim"), F.col("embedding").alias("vec"))
    # floor(256 x) of a single-precision number is one again
    kind = vectors.schema["embedding"].dataType.simpleString()

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, own in frame.groupby("dim", sort=False):
                x = np.floor(256.0 * np.stack(own["vec"].tolist()).astype(np.float64))
                means, devs = summaries(x)
                yield own.assign(vec=list(x), means=list(means), devs=list(devs))

    return cut(rows.mapInPandas(describe, f"uid long, id long, named boolean, label long, dim int, vec {kind}, means array<float>, devs array<float>"))


class Block:
    """Vectors with their summaries."""

    def __init__(self, frame: pd.DataFrame) -> None:
        self.x = np.stack(frame["vec"].tolist()).astype(np.float64)
        self.means, self.devs = (np.stack(frame[c].tolist()).astype(np.float64) for c in ("means", "devs"))
        self.norms = np.linalg.norm(self.x, axis=1)
        self.ids, self.named, self.labels, self.uids = (frame[c].to_numpy() for c in ("id", "named", "label", "uid"))
        self.largest = float(np.abs(self.x).max(initial=0))

    def scores(self, at: np.ndarray, of: Block, i: int) -> np.ndarray:
        """Exact inner products of the rows ``at`` with row ``i`` of another block."""
        if self.x.shape[1] * self.largest * of.largest < 2.0 ** 53:
            return (self.x[at] @ of.x[i]).astype(np.int64)
        other = [int(v) for v in of.x[i]]
        exact = [sum(int(v) * w for v, w in zip(self.x[k], other, strict=True)) for k in at]
        return np.array([min(max(s, LONG[0]), LONG[1]) for s in exact], np.int64)

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in ``at`` of the ``k`` highest scores, ties by id, rows without an id last."""
        return np.lexsort((self.ids[at], ~self.named[at], ~scores))[:k]


def _bounds(rows: Block, anchors: Block, level: int, i: slice | int, at: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of the anchors ``i`` with the rows ``at``."""
    first = sum(LEVELS[:level])
    own = slice(first, first + LEVELS[level])
    middle = anchors.means[i, own] @ rows.means[at, own].T
    spread = anchors.devs[i, own] @ rows.devs[at, own].T
    spread += ROUNDING * (np.multiply.outer(anchors.norms[i], rows.norms[at]) if isinstance(i, slice) else anchors.norms[i] * rows.norms[at]) + 1e-6
    return np.clip(middle - spread, *LONG), np.clip(middle + spread, *LONG)


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _refined(rows: Block, anchors: Block, i: int, at: np.ndarray, first: tuple[np.ndarray, np.ndarray], alive) -> np.ndarray:
    """The rows of ``at`` that ``alive(low, high)`` leaves level after level."""
    low, high = first
    for level in range(len(LEVELS)):
        if level:
            low, high = _bounds(rows, anchors, level, i, at)
        at = at[alive(low, high)]
        if not len(at):
            break
    return at


def positives_of(rows: Block, anchors: Block, k: int) -> list[tuple]:
    """For each anchor its ``k`` best rows: ``(uid, anchor, id, named, score)``."""
    out = []
    for lo in range(0, len(anchors.ids), AT_ONCE):
        low, high = _bounds(rows, anchors, 0, slice(lo, lo + AT_ONCE), slice(None))
        for j in range(len(low)):
            i = lo + j
            at = np.flatnonzero(rows.ids != anchors.ids[i])
            at = _refined(rows, anchors, i, at, (low[j][at], high[j][at]), lambda lw, hg: hg >= _kth(lw, k))
            scores = rows.scores(at, anchors, i)
            for b in rows.best(at, scores, k):
                out.append((int(anchors.uids[i]), int(anchors.ids[i]), int(rows.ids[at[b]]), bool(rows.named[at[b]]), int(scores[b])))
    return out


def negatives_of(rows: Block, anchors: Block, wanted: list, k: int, least: int) -> list[tuple]:
    """For each anchor and each score s of ``wanted`` its ``k`` best rows of other labels with ``least`` % of s <= score <= s."""
    out = []
    for lo in range(0, len(anchors.ids), AT_ONCE):
        low, high = _bounds(rows, anchors, 0, slice(lo, lo + AT_ONCE), slice(None))
        for j in range(len(low)):
            i = lo + j
            windows = [(s * least / 100, s) for s in map(int, wanted[i]) if s >= 0]  # below 0 the window is empty

            def alive(lw: np.ndarray, hg: np.ndarray, windows=windows) -> np.ndarray:
                left = np.zeros(len(lw), bool)
                for a, b in windows:
                    sure = (lw >= a) & (hg <= b)
                    left |= (hg >= a) & (lw <= b) & (hg >= _kth(lw[sure], k))
                return left

            at = np.flatnonzero(rows.labels != anchors.labels[i])
            at = _refined(rows, anchors, i, at, (low[j][at], high[j][at]), alive)
            scores = rows.scores(at, anchors, i)
            for _, s in windows:
                inside = np.array([least * s <= 100 * n <= 100 * s for n in scores.tolist()], bool)
                own, n = at[inside], scores[inside]
                for b in rows.best(own, n, k):
                    out.append((int(anchors.uids[i]), s, int(rows.ids[own[b]]), bool(rows.named[own[b]]), int(n[b])))
    return out


def _meet(rows: DataFrame, anchors: DataFrame, keys: list[str], block_rows: int, block_anchors: int) -> tuple:
    """Rows and anchors of equal ``keys`` in blocks, each row once for each block of anchors and the other way round, grouped
    by pair of blocks."""
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    sizes = sized_broadcast(blocks(rows, block_rows, "n_rows").join(blocks(anchors, block_anchors, "n_anchors"), keys))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other)
        # columns under new identities, as both sides come from one table
        return df.join(sizes, keys).select(*[F.col(c).alias(c) for c in df.columns], F.pmod(F.xxhash64("uid"), F.col(f"n_{own}")).cast("int").alias(own), every)

    pair = [*keys, "rows", "anchors"]
    return dealt(rows, "rows", "anchors").groupBy(*pair), dealt(anchors, "anchors", "rows").groupBy(*pair)


def mine(vectors: DataFrame, every: int = ANCHOR_EVERY, k: int = K, least: int = 80, block_rows: int = BLOCK_ROWS,
         block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    rows = described(vectors)
    anchors = rows.where(F.col("named") & (F.col("id") % every == 0))

    def same_label(own: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        found = positives_of(Block(own), Block(of), k) if len(own) and len(of) else []
        return pd.DataFrame(found, columns=["uid", "anchor_id", "id", "named", "score"])

    left, right = _meet(rows, anchors, ["label", "dim"], block_rows, block_anchors)
    found = left.cogroup(right).applyInPandas(same_label, "uid long, anchor_id long, id long, named boolean, score long")
    best = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("named").desc(), "id")
    positives = cut(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k))

    def other_labels(own: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        got = negatives_of(Block(own), Block(of), of["wanted"].tolist(), k, least) if len(own) and len(of) else []
        return pd.DataFrame(got, columns=["uid", "score", "id", "named", "negative_score"])

    asking = anchors.join(positives.groupBy("uid").agg(F.collect_set("score").alias("wanted")), "uid")  # at most k scores
    left, right = _meet(rows, asking, ["dim"], block_rows, block_anchors)
    met = left.cogroup(right).applyInPandas(other_labels, "uid long, score long, id long, named boolean, negative_score long")
    hardest = Window.partitionBy("uid", "score").orderBy(F.col("negative_score").desc(), F.col("named").desc(), "id")
    negatives = met.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= k).select(
        "uid", "score", "rank", F.when(F.col("named"), F.col("id")).alias("negative_id"), "negative_score")
    return positives.join(negatives, ["uid", "score"]).select(
        "anchor_id", F.when(F.col("named"), F.col("id")).alias("positive_id"), "rank", "negative_id",
        F.col("score").alias("positive_score"), "negative_score")
