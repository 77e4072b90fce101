"""The scorers over Arrow batches of ASCII texts, in numpy: the tasks' form of the rule chain and of the linear fold.

A batch is cut into blocks of a bounded number of bytes.  In a block every item is a number: its place in its text, its first and
last byte, the number of its word among those that the rules know; a rule looks at an item's neighbours by shifted arrays.  Sums
are added up in the items' order, as the folds of ``operators.lexicon`` and ``operators.model`` do, so that both give the same
numbers.  Texts with other signs, and rules or tables that have no form here, stay with those folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tonality.functions.text import is_ascii
from tonality.resources import (BOOST_DISTANCE_DAMP, BOOST_INCREMENT, BUT_AFTER, BUT_BEFORE, CAPS_INCREMENT, EXCLAIM_MAX,
                                EXCLAIM_WEIGHT, NEGATION_MARK, NEGATION_SCALAR, NEVER_SO_SCALAR, QUESTION_CAP, QUESTION_WEIGHT)

#: Bytes of the texts that are looked at together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18
SUMS_TYPE = "n int, emph double, s double, ps double, ns double, toned int"
ITEMS_TYPE = "array<struct<pos:int,t:string,tl:string,cap_diff:boolean,factor:double,v0:double,v_caps:double,v:double>>"

_BYTES = np.arange(128)
_SIGNS = [chr(b) for b in _BYTES]
IS_BLANK = np.isin(_BYTES, [ord(c) for c in " \t\n\r\f"])
IS_PUNCT = np.array([33 <= b <= 126 and not c.isalnum() for b, c in enumerate(_SIGNS)])
IS_LOW, IS_UP = (np.array([getattr(c, f)() for c in _SIGNS]) for f in ("islower", "isupper"))
IS_WORD = np.array([c.isalnum() or c == "_" for c in _SIGNS])
LOWER = np.array([ord(c.lower()) for c in _SIGNS], np.uint8)


def ascii_or(text: Column, batch: Callable[[Column], Column], other: Column) -> Column:
    """``batch`` of the texts of ASCII only, ``other`` for the rest (NULL too)."""
    plain = is_ascii(text)
    return F.when(plain, batch(F.when(plain, text))).otherwise(other)


def blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of runs of texts and the places where the texts start and end in them; a NULL text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, "right")) - 1)
        yield data[ends[at]:ends[to]], ends[at:to + 1] - ends[at]
        at = to


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-the-last places of the runs of ``inside`` that do not cross a text's end."""
    first = np.zeros(len(inside) + 1, bool)
    first[ends] = True
    before, after = np.ones_like(inside), np.ones_like(inside)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    return np.flatnonzero(inside & (before | first[:-1])), np.flatnonzero(inside & (after | first[1:])) + 1


def rows_of(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, places, "right") - 1


class Items:
    """The items of a block: ``start``, ``end`` (bytes), ``row``, ``pos`` in the row, ``size`` of the row, and the block's bytes in lower case."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        punct = IS_PUNCT[data]
        filled = ~IS_BLANK[data]
        start, end = runs(filled, ends)
        # signs at the ends of an item go, up to its first and from its last other byte
        core = np.flatnonzero(np.diff((filled & ~punct).astype(np.int8), prepend=0, append=0))
        first, last = core[::2], core[1::2]
        loose = np.flatnonzero(punct[start]) if len(start) else start
        start[loose] = np.minimum(np.append(first, len(data))[np.searchsorted(first, start[loose])], end[loose])
        loose = np.flatnonzero((start < end) & punct[end - 1]) if len(start) else start
        end[loose] = last[np.searchsorted(last, end[loose], "right") - 1]
        kept = end - start > 1
        self.data, self.ends, self.start, self.end = data, ends, start[kept], end[kept]
        self.row = rows_of(self.start, ends)
        self.counts = np.bincount(self.row, minlength=len(ends) - 1)
        self.size = self.counts[self.row]
        self.pos = np.arange(len(self.row)) - (np.cumsum(self.counts) - self.counts)[self.row]
        self.length = self.end - self.start
        self.mixed = bool(IS_UP[data].any())
        self.low = LOWER[data] if self.mixed else data
        inside = np.zeros(len(data) + 1, np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        self.inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        self.lows = self.words(self.low)

    def words(self, data: np.ndarray) -> pa.Array:
        places = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.length), pa.py_buffer(places), pa.py_buffer(data[self.inside]))

    def count(self, table: np.ndarray, data: np.ndarray) -> np.ndarray:
        """For each item, how many of its bytes are in ``table``."""
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        return total[self.end] - total[self.start]

    def near(self, a: np.ndarray, at: np.ndarray, k: int, none):
        """Of the items ``at``, the value in ``a`` of the item ``k`` places on in the same text, ``none`` where there is none."""
        place = self.pos[at] + k
        there = (place >= 0) & (place < self.size[at])
        return np.where(there, a[np.where(there, at + k, 0)], none) if len(a) else np.full(0, none)


@dataclass(frozen=True)
class Known:
    """What the rules know, as plain values; ``rule`` gives the valences of items by itself (NaN: none)."""

    valences: dict[str, float]
    deltas: dict[str, float]
    negators: Sequence[str]
    contrast: Sequence[str]
    rule: Callable[[Items], np.ndarray] | None
    idioms: dict[str, float] | None = None  # None: no rule for phrases
    damps: dict[str, float] | None = None


class Chain:
    """The rule chain over the items of a block: ``v0``, ``caps`` and ``v`` (NaN: no lexicon item), ``capdiff`` and ``but`` by row."""

    def __init__(self, known: Known, steps: Sequence[str]):
        self.known, self.steps = known, steps
        phrases = [p.split(" ") for p in (*(known.idioms or ()), *(known.damps or ()))]
        named = {"kind", "of", "least", "never", "so", "this", "at", "very"}
        self.names = sorted({*known.valences, *known.deltas, *known.negators, *known.contrast, *named, *(w for p in phrases for w in p)})
        self.number = {w: i for i, w in enumerate(self.names)}
        table = lambda values: np.array([*(values.get(w, np.nan) for w in self.names), np.nan])
        self.val, self.boost = table(known.valences), table(known.deltas)

    def among(self, ids: np.ndarray, words: Sequence[str]) -> np.ndarray:
        chosen = np.zeros(len(self.names) + 1, bool)
        chosen[[self.number[w] for w in words]] = True
        return chosen[ids]

    def phrase(self, x: Items, ids: np.ndarray, values: dict[str, float], n: int) -> np.ndarray:
        """For every place the value of the ``n`` items that start there."""
        out, every = np.full(len(ids), np.nan), np.arange(len(ids))
        for phrase, value in values.items():
            words = phrase.split(" ")
            if len(words) == n:
                at = every[ids == self.number[words[0]]]
                for k in range(1, n):
                    at = at[x.near(ids, at, k, -1) == self.number[words[k]]]
                out[at] = value
        return out

    def run(self, x: Items) -> tuple[np.ndarray, ...]:
        known, steps = self.known, self.steps
        ids = pc.index_in(x.lows, value_set=pa.array(self.names, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        is_ = lambda *words: self.among(ids, words)
        val, boost, neg = self.val[ids], self.boost[ids], is_(*known.negators)
        marks = x.low == ord(NEGATION_MARK[1])
        if marks.any():
            mark = np.flatnonzero(marks[1:-1] & (x.low[:-2] == ord(NEGATION_MARK[0])) & (x.low[2:] == ord(NEGATION_MARK[2])))
            item = np.searchsorted(x.start, mark, "right") - 1
            neg[item[(item >= 0) & (mark + len(NEGATION_MARK) <= x.end[item])]] = True
        free_of = np.isnan(val)  # a predecessor that is itself a lexicon word does not modify
        every = np.arange(len(ids))
        v0 = val.copy()
        if known.rule is not None:
            v0 = np.where(free_of & ~neg & ~is_("least", "never"), known.rule(x), v0)
        kind = np.flatnonzero(is_("kind"))
        v0[kind[x.near(ids, kind, 1, -1) == self.number["of"]]] = np.nan
        v0[~np.isnan(boost)] = np.nan
        caps, capdiff, upper = v0, np.zeros(len(x.counts), bool), np.zeros(len(ids), bool)
        if x.mixed:
            upper = (x.count(IS_UP, x.data) > 0) & (x.count(IS_LOW, x.data) == 0)
            ups = np.bincount(x.row[upper], minlength=len(x.counts))
            capdiff = (ups > 0) & (ups < x.counts)
            caps = np.where(upper & capdiff[x.row], v0 + np.where(v0 > 0, CAPS_INCREMENT, -CAPS_INCREMENT), v0)
        v = caps.copy()
        rules = [r for step in steps for r in {"boost": ["boost1", "boost2", "boost3"], "negate": ["negate1", "negate2", "negate3"], "contrast": [], "modify": [
            *(f"{r}{d}" for d in (1, 2, 3) for r in ("boost", "negate")), *(["idiom"] if known.idioms is not None else []), "least"]}[step]]
        if rules:
            acts = ~np.isnan(boost) | neg | is_("least", "never")
            if known.idioms is not None:
                p2, p3 = (self.phrase(x, ids, known.idioms, n) for n in (2, 3))
                d2 = self.phrase(x, ids, known.damps, 2)
                acts = acts | ~np.isnan(p2) | ~np.isnan(p3) | ~np.isnan(d2)
            changed = acts.copy() if known.idioms is not None else np.zeros(len(ids), bool)
            for d in (1, 2, 3):
                changed[d:] |= acts[:-d] & (x.pos[d:] >= d)
            at = every[changed & ~np.isnan(v0)]
            w = v[at]
            free = {d: x.near(free_of, at, -d, False) for d in (1, 2, 3)}

            def boosted(w: np.ndarray, d: int) -> np.ndarray:
                b = x.near(boost, at, -d, np.nan)
                s = np.where(w < 0, -b, b)
                up = capdiff[x.row[at]] & x.near(upper, at, -d, False)
                s = np.where(up, s + np.where(w > 0, CAPS_INCREMENT, -CAPS_INCREMENT), s)
                return np.where(~np.isnan(b) & free[d], w + s * BOOST_DISTANCE_DAMP[d - 1], w)

            def negated(w: np.ndarray, d: int) -> np.ndarray:
                turned = np.where(x.near(neg, at, -d, False) & free[d], w * NEGATION_SCALAR, w)
                if d == 1:
                    return turned
                so = np.logical_or.reduce([x.near(is_("so", "this"), at, -k, False) for k in range(1, d)])
                return np.where(x.near(is_("never"), at, -d, False) & free[d] & so, w * NEVER_SO_SCALAR[d - 2], turned)

            def idiom(w: np.ndarray) -> np.ndarray:
                said = w
                for phrase, k in ((p2, -3), (p3, -3), (p2, -2), (p3, -2), (p2, -1), (p2, 0), (p3, 0)):  # the last of them holds
                    here = x.near(phrase, at, k, np.nan)
                    said = np.where(np.isnan(here), said, here)
                damped = ~np.isnan(x.near(d2, at, -3, np.nan)) | ~np.isnan(x.near(d2, at, -2, np.nan))
                return np.where(free[3], np.where(damped, said - BOOST_INCREMENT, said), w)

            for r in rules:
                if r == "idiom":
                    w = idiom(w)
                elif r == "least":
                    w = np.where(x.near(is_("least"), at, -1, False) & free[1] & ~x.near(is_("at", "very"), at, -2, False), w * NEGATION_SCALAR, w)
                else:
                    w = (boosted if r[:-1] == "boost" else negated)(w, int(r[-1]))
            v[at] = w
        but = np.zeros(len(x.counts), np.int64)
        turns = every[is_(*known.contrast)]
        rows, first = np.unique(x.row[turns], return_index=True)
        but[rows] = x.pos[turns[first]] + 1
        there, place = but[x.row] > 0, but[x.row] - 1
        factor = np.where(there & (x.pos < place), BUT_BEFORE, np.where(there & (x.pos > place), BUT_AFTER, 1.0))
        if "contrast" in steps:
            v = v * factor
        return v0, caps, v, capdiff, factor


def emphasis(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``operators.lexicon.punctuation_emphasis`` of every text."""
    ep, qm = (np.bincount(rows_of(np.flatnonzero(data == ord(c)), ends), minlength=len(ends) - 1) for c in "!?")
    return np.minimum(ep, EXCLAIM_MAX) * EXCLAIM_WEIGHT + np.where(qm > 3, QUESTION_CAP, np.where(qm > 1, qm * QUESTION_WEIGHT, 0.0))


def _structs(columns: dict[str, np.ndarray | pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], [*columns])


def _joined(parts: list[pa.Array], of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else of(pa.array([], pa.string()))


def sums_by_batch(known: Known, steps: Sequence[str]) -> Callable[[Column], Column]:
    """Of a text ``struct<n, emph, s, ps, ns, toned>``: its items, its emphasis, the sums of its valences and how many are not 0."""
    chain = Chain(known, steps)

    def block(data: np.ndarray, ends: np.ndarray) -> pa.StructArray:
        x = Items(data, ends)
        v = chain.run(x)[2]
        at = np.flatnonzero(~np.isnan(v))
        row, v, n = x.row[at], v[at], len(ends) - 1
        add = lambda w: np.bincount(row, weights=w, minlength=n)  # noqa: E731  (in the items' order)
        return _structs({"n": x.counts.astype(np.int32), "emph": emphasis(data, ends), "s": add(v), "ps": add(np.where(v > 0, v + 1.0, 0.0)),
                         "ns": add(np.where(v < 0, v - 1.0, 0.0)), "toned": np.bincount(row[v != 0], minlength=n).astype(np.int32)})

    @F.arrow_udf(SUMS_TYPE)
    def sums(texts: pa.Array) -> pa.Array:
        return _joined([block(*b) for b in blocks(texts)], lambda none: block(np.zeros(0, np.uint8), np.zeros(1, np.int64)))

    return sums


def items_by_batch(known: Known, steps: Sequence[str]) -> Callable[[Column], Column]:
    """Of a text the array of its lexicon items, as ``operators.lexicon.lexicon_items`` lists them."""
    chain = Chain(known, steps)

    def block(data: np.ndarray, ends: np.ndarray) -> pa.ListArray:
        x = Items(data, ends)
        v0, caps, v, capdiff, factor = chain.run(x)
        at = np.flatnonzero(~np.isnan(v0))
        low = x.lows.take(pa.array(at))
        found = _structs({"pos": x.pos[at].astype(np.int32), "t": x.words(data).take(pa.array(at)) if x.mixed else low, "tl": low,
                          "cap_diff": capdiff[x.row[at]], "factor": factor[at], "v0": v0[at], "v_caps": caps[at], "v": v[at]})
        counts = np.bincount(x.row[at], minlength=len(ends) - 1)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), found)

    @F.arrow_udf(ITEMS_TYPE)
    def items(texts: pa.Array) -> pa.Array:
        return _joined([block(*b) for b in blocks(texts)], lambda none: block(np.zeros(0, np.uint8), np.zeros(1, np.int64)))

    return items


def word_sums_by_batch(names: Sequence[str], multipliers: Sequence[int], modulus: int, offset: int) -> Callable[[Column], Column]:
    """Of a text the number ``n`` of its words and, under each name, the sum of their weights by the fixture rule."""
    def block(data: np.ndarray, ends: np.ndarray) -> pa.StructArray:
        start, end = runs(IS_WORD[data], ends)
        row, n = rows_of(start, ends), len(ends) - 1
        first, length = data[start].astype(np.int64), end - start
        return _structs({"n": np.bincount(row, minlength=n).astype(np.int64), **{
            x: np.bincount(row, weights=(first * m + length) % modulus - offset, minlength=n).astype(np.int64) for x, m in zip(names, multipliers)}})

    @F.arrow_udf("n long, " + ", ".join(f"{x} long" for x in names))
    def sums(texts: pa.Array) -> pa.Array:
        return _joined([block(*b) for b in blocks(texts)], lambda none: block(np.zeros(0, np.uint8), np.zeros(1, np.int64)))

    return sums


def word_counts_by_batch() -> Callable[[Column], Column]:
    """Of a text its distinct words, each with its number of occurrences: ``array<struct<word, n>>``."""
    def block(data: np.ndarray, ends: np.ndarray) -> pa.ListArray:
        start, end = runs(IS_WORD[data], ends)
        row = rows_of(start, ends)
        places = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        known = pa.StringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(data[IS_WORD[data]])).dictionary_encode()
        ids, size = known.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(known.dictionary))
        pairs, n = np.unique(row * size + ids, return_counts=True)
        counts = np.bincount(pairs // size, minlength=len(ends) - 1)
        found = _structs({"word": known.dictionary.take(pa.array(pairs % size)), "n": n.astype(np.int64)})
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), found)

    @F.arrow_udf("array<struct<word:string,n:long>>")
    def counted(texts: pa.Array) -> pa.Array:
        return _joined([block(*b) for b in blocks(texts)], lambda none: block(np.zeros(0, np.uint8), np.zeros(1, np.int64)))

    return counted
