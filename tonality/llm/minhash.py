"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every text becomes its set of distinct word shingles (as 64-bit hashes) and a signature of ``COORDS`` minima.
   Texts with equal sets are one class; from here on only classes count.
2. Each class is posted under its (coordinate, value) pairs.  Two classes whose similarity reaches the limit agree in at
   least ``T`` coordinates (all but one in a million times, see ``least_matches``).  As in prefix filtering,
   with all pairs ordered from rare to frequent, such classes share one of their first ``COORDS - T + 1``: only these
   are listed, and the long lists are skipped.  Pairs that occur once need no list, so a class without enough
   repeated pairs drops out at once.
3. Classes connected by lists form candidate groups.  A group is cut into blocks, and each pair of blocks is a task: it
   counts collisions of the full signatures, keeps pairs with ``T`` or more, and confirms them on the
   full shingle sets, most collisions first.  A pair already connected within the task is not needed; a task
   returns the links that connect its rows, never all pairs.
4. Connected components of the links, joined back to all documents.

No list, group or number of partners is capped; a group's size only sets the number of its blocks.

Defined results: text without words (or null, or empty) has no shingles and is linked with nothing; fewer words than the
shingle size are one shingle; equal rows share a component; a null id takes its set's component and is not ``kept``, and a
component without any id has a null one; other texts under one id are documents of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import components, cut, drop_memo
from tonality.session import is_small

COORDS = 64
SIGMAS = 5.0              # how far below its mean the number of matches may fall
BLOCK_CLASSES = 512       # classes of a group in one block
BLOCK_CHARS = 4_000_000   # characters of a group in one block
BROADCAST_ROWS = 1_000_000
WINDOW = 500_000          # bytes hashed at a time

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]  # words are compared in lower case
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULT = _rng.integers(1, 2**63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**63, COORDS, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def least_matches(percent: int, coords: int = COORDS) -> int:
    """Matches that a pair at the limit of similarity falls below only beyond ``SIGMAS`` standard deviations."""
    p = percent / 100
    return max(1, math.floor(coords * p - SIGMAS * math.sqrt(coords * p * (1 - p))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word; a document starts at each of ``starts``, ``apart`` marks separators."""
    space = apart[data]
    first = ~space
    first[1:] &= space[:-1]
    inside = starts[starts < len(data)]
    first[inside] = ~space[inside]
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, np.uint64), at
    counts = np.diff(np.append(at, len(data)))
    head = at[0]
    place = np.arange(len(data) - head) - np.repeat(at - head, counts)
    powers = np.ones(int(place.max()) + 1, np.uint64)
    powers[1:] = _STEP
    np.multiply.accumulate(powers, out=powers)
    terms = _BYTE[data[head:]] * powers[place]
    terms[space[head:]] = 0
    return _mix(np.add.reduceat(terms, at - head)), at


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after another, and where each text's begin."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashes, at = [], []
    low = 0
    while low < len(data):  # windows end where a document or a word does
        high = min(len(data), low + WINDOW)
        if high < len(data):
            ends = begins[(begins > low) & (begins <= high)]
            if len(ends):
                high = int(ends[-1])
            else:
                gaps = np.flatnonzero(_SPACE[data[low:high]])
                while not len(gaps) and high < len(data):
                    more = min(len(data), high + WINDOW)
                    gaps = high - low + np.flatnonzero(_SPACE[data[high:more]])
                    high = more
                high = low + int(gaps[-1]) + 1 if len(gaps) else high
                after = begins[(begins > low) & (begins <= high)]
                high = int(after[0]) if len(after) else high
        h, a = word_hashes(data[low:high], begins[(begins >= low) & (begins < high)] - low)
        hashes.append(h)
        at.append(a + low)
        low = high
    words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    at = np.concatenate(at) if at else np.empty(0, np.int64)
    doc = np.searchsorted(begins, at, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    # a shingle for each word with width - 1 more behind it in its text, or the whole of a shorter text
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    behind = (first + n_words)[doc] - np.arange(len(words)) if len(words) else np.empty(0, np.int64)
    length = np.minimum(n_words, width)
    begin = np.flatnonzero(behind >= length[doc]) if len(words) else np.empty(0, np.int64)
    owner, have = doc[begin], length[doc[begin]]
    value = _mix(have.astype(np.uint64) * _STEP)
    for i in range(width):
        own = i < have
        value[own] = _mix(value[own] * np.uint64(0xD6E8FEB86659FD93) + words[begin[own] + i])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def minima(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The signature (uint32) of each set; sets must not be empty."""
    out = np.empty((len(begins) - 1, COORDS), np.uint32)
    for j in range(COORDS):
        out[:, j] = np.minimum.reduceat((values * _MULT[j] + _PLUS[j]) >> np.uint64(32), begins[:-1])
    return out


def parts(texts: list, most: int = WINDOW) -> Iterator[slice]:
    """Slices of at most ``most`` bytes, or of one text."""
    low, total = 0, 0
    for i, t in enumerate(texts):
        if i > low and total + len(t) > most:
            yield slice(low, i)
            low, total = i, 0
        total += len(t)
    if low < len(texts):
        yield slice(low, len(texts))


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def set_sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Two sums over the hashes of each set, 0 for an empty one."""
    sums, full = np.zeros((2, len(begins) - 1), np.int64), np.flatnonzero(np.diff(begins))
    if len(full):
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            sums[k, full] = np.add.reduceat(_mix(values ^ np.uint64(salt)), begins[:-1][full]).view(np.int64)
    return sums


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, th, n_shingles, set_a, set_b, sig`` of each document: a hash of its text, and two sums that identify its set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memo()
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for part in parts(texts):
                values, begins = shingle_sets(texts[part], width)
                n = np.diff(begins)
                full = np.flatnonzero(n)
                sums, sig = set_sums(values, begins), [None] * len(n)
                if len(full):
                    at = begins[:-1][full]
                    for i, row in zip(full.tolist(), minima(values, np.append(at, len(values))).view(np.int32), strict=True):
                        sig[i] = row
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(part.start, part.stop - part.start) for c in ("doc_id", "th")], pa.array(n, pa.int64()),
                     pa.array(sums[0]), pa.array(sums[1]), pa.array(sig, pa.list_(pa.int32()))],
                    schema=pa.schema([("doc_id", _ARROW[kind]), ("th", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()),
                                      ("set_b", pa.int64()), ("sig", pa.list_(pa.int32()))]))

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text")).mapInArrow(
        work, f"doc_id {kind}, th long, n_shingles long, set_a long, set_b long, sig array<int>")


def candidate_groups(classes: DataFrame, matches: int) -> DataFrame:
    """``node, component``: classes that lists of rare coordinate values connect."""
    prefix = COORDS - matches + 1
    posts = classes.select("class", F.posexplode("sig").alias("pos", "val")).select(
        "class", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(
            F.col("val").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    often = posts.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    repeated = posts.join(often, "token").groupBy("class").agg(  # at most COORDS of a class
        F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("tokens"))
    room = F.size("tokens") - F.lit(COORDS - prefix)  # the pairs that occur once come first
    listed = cut(repeated.where(room > 0).select("class", F.explode(F.slice("tokens", 1, room)).alias("t"))
                 .select("class", F.col("t.token").alias("token")))
    heads = listed.groupBy("token").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return components(listed.join(heads, "token").select(F.col("class").alias("a"), F.col("head").alias("b")))


def _confirmed(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def links_within(ids: np.ndarray, texts: list[bytes], side: np.ndarray, width: int, percent: int, matches: int
                 ) -> list[tuple]:
    """Links that connect the rows of one task; ``side`` is 0 or 1 for two blocks, whose own pairs belong to other
    tasks, or -1 for the pairs of one block."""
    values, begins = shingle_sets(texts, width)
    n = np.diff(begins)
    sig = minima(values, begins)
    found_a, found_b, found_n = [], [], []
    left = np.flatnonzero(side <= 0)
    right = np.flatnonzero(side != 0)
    step = max(1, 4_000_000 // (COORDS * max(1, len(right))))
    for low in range(0, len(left), step):
        rows = left[low:low + step]
        same = (sig[rows][:, None, :] == sig[right][None, :, :]).sum(2)
        small, large = np.minimum(n[rows][:, None], n[right][None]), np.maximum(n[rows][:, None], n[right][None])
        good = (same >= matches) & (100 * small >= percent * large)
        if side[0] < 0:
            good &= rows[:, None] < right[None]
        i, j = np.nonzero(good)
        found_a.append(rows[i])
        found_b.append(right[j])
        found_n.append(same[i, j])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(-np.concatenate(found_n), kind="stable")
    a, b = a[order], b[order]
    group, out = np.arange(len(ids)), []
    block = 256
    while len(a):
        for i, j in zip(a[:block].tolist(), b[:block].tolist(), strict=True):
            if group[i] != group[j] and _confirmed(values[begins[i]:begins[i + 1]], values[begins[j]:begins[j + 1]], percent):
                group[group == group[j]] = group[i]
                out.append((ids[i], ids[j]))
        a, b = a[block:], b[block:]
        apart = group[a] != group[b]
        a, b = a[apart], b[apart]
        block = 4096
    return out


def links(docs: DataFrame, groups: DataFrame, width: int, percent: int, matches: int) -> DataFrame:
    """``a, b``: confirmed links that connect the classes of each group; ``groups`` has ``node, component`` and the document that
    stands for the class, by its id, which may be NULL, and the hash ``th`` of its text.

    Ids may be repeated with other texts: the hash tells which row is meant.
    """
    small = is_small(groups, BROADCAST_ROWS)
    # the documents' side is not shuffled while the classes fit a broadcast of known size
    side = F.broadcast(groups) if small else groups
    whole = docs.select(F.col("doc_id").alias("_id"), "text").withColumn("_th", F.xxhash64("text"))

    def standing(side: DataFrame) -> DataFrame:
        return whole.join(side, (whole["_th"] == side["th"]) & whole["_id"].eqNullSafe(side["doc_id"]))

    rows = standing(side)
    sizes = rows.groupBy("component").agg(F.countDistinct("node").alias("n"), F.sum(F.octet_length("text")).alias("chars"))
    sizes = sizes.select("component", F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("chars") / BLOCK_CHARS),
                                                 F.lit(1)).cast("int").alias("blocks"))
    own = groups.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = standing(F.broadcast(own) if small else own).withColumn("text", F.col("text").cast("binary"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = rows.select("component", "node", "text", "block", other.alias("other")).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "text")
    keys = ["component", "low", "high"]
    dealt = pairs.repartition(*keys).sortWithinPartitions(*keys, "node")
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(group: pd.DataFrame) -> list[tuple]:
            group = group.drop_duplicates("node")
            if len(group) < 2:
                return []
            one = group["low"].iloc[0] == group["high"].iloc[0]
            which = np.full(len(group), -1) if one else (group["block"] == group["high"]).to_numpy().astype(int)
            if not one and (which.all() or not which.any()):
                return []
            return links_within(group["node"].to_numpy(), group["text"].tolist(), which, width, percent, matches)

        drop_memo()
        rest = None
        for frame in frames:
            if rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            turn = np.flatnonzero((frame[keys].to_numpy()[1:] != frame[keys].to_numpy()[:-1]).any(1)) + 1
            edges = [0, *turn.tolist()]
            out = [x for i, j in zip(edges, edges[1:], strict=False) for x in of(frame.iloc[i:j])]
            rest = frame.iloc[edges[-1]:]  # may go on in the next frame
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if rest is not None and len(rest):
            out = of(rest)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return dealt.mapInPandas(work, "a long, b long")


def first_of(*more: str) -> Column:
    """The row with the smallest id, rows without one last, then by the hash of its text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th", *more))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: texts with a Jaccard similarity of ``percent`` or more are linked.

    Further columns: ``th``, a hash of the text, and ``first``, whether the row is the one of its component that stays where one of
    each is kept (rows equal in id and text are equal in it; a document without words always is).
    """
    matches = least_matches(percent)
    rows = cut(signatures(docs, width))
    keys = ["n_shingles", "set_a", "set_b"]
    # equal sets are one class under a number of its own, as ids may be missing or repeated
    classes = cut(rows.where("n_shingles > 0").groupBy(*keys).agg(first_of().alias("own"), F.first("sig").alias("sig"))
                  .withColumn("class", F.monotonically_increasing_id()))
    found = cut(candidate_groups(classes.select("class", "sig"), matches))
    groups = cut(found.join(classes.select(F.col("class").alias("node"), "own.doc_id", "own.th"), "node"))
    edges = cut(links(docs, groups, width, percent, matches))
    joined = components(edges).select(F.col("node").alias("class"), "component")
    named = cut(classes.drop("sig").join(joined, "class", "left").select(
        *keys, F.coalesce("component", "class").alias("component"), "own.*"))
    least = named.groupBy("component").agg(first_of().alias("least"))
    known = named.drop("doc_id", "th", "nameless").join(least, "component")
    out = rows.drop("sig").join(known.drop("component"), keys, "left")
    empty, stays = F.col("n_shingles") == 0, F.col("least")
    component = F.when(empty, F.col("doc_id")).otherwise(stays["doc_id"])
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "th",
                      (empty | (F.col("doc_id").eqNullSafe(stays["doc_id"]) & (F.col("th") == stays["th"]))).alias("first"))
