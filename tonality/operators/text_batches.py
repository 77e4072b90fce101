"""Cleaning and the cut into kept tokens over Arrow batches, in numpy: the tasks' form of ``functions.text.clean_text`` and of
``tokenize`` without stopwords, for texts whose cleaned form is of ASCII only.

A batch is cut into blocks of a bounded number of bytes (``batches.blocks``).  A sign is folded by a table by its code point, a token
is known by its first byte.  Rows that need more than that (repair of broken Unicode, letters of other scripts, letters without a
spelling) come out as NULL, and the expressions of ``functions.text`` take them.

They are marked as not deterministic, though they give the same rows each time: Spark draws projections with Python functions that feed
each other into one, and would write the expressions between them out wherever a scorer names its text, and fail to run it.  In
return a filter on other columns is not pushed below them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tonality.functions import text as T
from tonality.operators.batches import IS_LOW, IS_WORD, blocks, rows_of, runs

#: Code points from here on have no place in the table of signs.
SIGNS_END = 0x2100
#: Entries of the table that are no signs of ASCII; those between 0x80 and these are numbers of longer spellings.
UNKNOWN, REMOVED = 0xFE, 0xFF

IS_SPACE = np.isin(np.arange(128), [ord(c) for c in " \t\n\x0b\f\r"])
IS_LINE = np.isin(np.arange(128), [ord(c) for c in "\n\r"])
IS_ODD_SPACE = IS_SPACE & ~np.isin(np.arange(128), [ord(c) for c in " \n"])

#: A block's rows: their bytes, the places where they start and end, and which of them are known here.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


@lru_cache(maxsize=None)
def sign_table() -> tuple[np.ndarray, list[bytes]]:
    """What cleaning makes of each code point below ``SIGNS_END`` (the last entry: of any other): a sign of ASCII, ``REMOVED``,
    ``UNKNOWN``, or from 0x80 on the number of a spelling of several signs."""
    src, dst, multi, _ = T.fold_tables()
    one, several = dict(zip(src, dst)), dict(multi)
    spellings = sorted({s.encode() for s in several.values()})
    emoji, script = (re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), p)) for p in (T.EMOJI_PATTERN, T.SCRIPT_CLASS))

    def entry(cp: int) -> int:
        ch = chr(cp).lower()
        if script.match(chr(cp)) or len(ch) != 1:
            return UNKNOWN
        if ch == "-" or (cp >= 0x80 and emoji.match(ch)):
            return REMOVED
        ch = one.get(ch, ch)
        if ch in several:
            return 0x80 + spellings.index(several[ch].encode())
        if ord(ch) < 0x80:
            return ord(ch)
        return UNKNOWN if unicodedata.category(ch)[0] in "LMN" else REMOVED

    return np.array([*(entry(cp) for cp in range(SIGNS_END)), UNKNOWN], np.uint8), spellings


#: Code points that may end a sign of broken Unicode.
_AFTER = np.zeros(SIGNS_END + 1, bool)
_AFTER[0x80:0xC0] = True
_AFTER[[cp for cp in map(ord, T._SIGNS) if cp < SIGNS_END]] = True
_AFTER[-1] = any(ord(ch) >= SIGNS_END for ch in T._SIGNS)


def _folded(data: np.ndarray, ends: np.ndarray) -> Rows:
    """Every sign by the table."""
    table, spellings = sign_table()
    known = np.ones(len(ends) - 1, bool)
    if not (data >= 0x80).any():
        out = table[data]
    else:
        try:
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:  # no valid text: its rows are not for here
            known[rows_of(np.flatnonzero(data >= 0x80), ends)] = False
            points, heads = np.where(data < 0x80, data, ord("?")).astype(np.uint32), np.ones(len(data), bool)
        else:
            heads = (data & 0xC0) != 0x80
        ends = np.concatenate([[0], np.cumsum(heads)])[ends]
        points = np.minimum(points, SIGNS_END)
        out = table[points]
        first = np.flatnonzero((points >= 0xC2) & (points <= 0xF4))
        broken = first[_AFTER[points[np.minimum(first + 1, len(points) - 1)]]]
        broken = broken[~np.isin(broken + 1, ends)]
        unknown = np.flatnonzero(out == UNKNOWN)
        known[rows_of(np.concatenate([broken, unknown]), ends)] = False
        out[unknown] = ord("?")
        longer = np.flatnonzero((out >= 0x80) & (out != REMOVED))
        if len(longer):
            words = [spellings[k - 0x80] for k in out[longer]]
            at = np.repeat(longer + 1, [len(w) - 1 for w in words])
            out[longer] = [w[0] for w in words]
            out = np.insert(out, at, np.frombuffer(b"".join(w[1:] for w in words), np.uint8))
            ends = ends + np.searchsorted(at, ends, "right")
    removed = np.flatnonzero(out == REMOVED)
    if len(removed):
        out, ends = out[out != REMOVED], ends - np.searchsorted(removed, ends, "left")
    return out, ends, known


def _tight(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """White space as ``normalize_space`` has it: a run is a line break if it holds one, else a blank; none at a text's ends."""
    space = IS_SPACE[data]
    filled = np.flatnonzero(ends[:-1] < ends[1:])
    edges = np.concatenate([ends[:-1][filled], ends[1:][filled] - 1])
    if not ((space[1:] & space[:-1]).any() or IS_ODD_SPACE[data].any() or space[edges].any()):
        return data, ends
    start, end = runs(space, ends)
    lines = np.concatenate([[0], np.cumsum(IS_LINE[data], dtype=np.int32)])
    data = data.copy()
    data[start] = np.where(lines[end] > lines[start], ord("\n"), ord(" "))
    kept = ~space
    kept[start] = ~(np.isin(start, ends) | np.isin(end, ends))
    return data[kept], np.concatenate([[0], np.cumsum(kept)])[ends]


def _cleaned(data: np.ndarray, ends: np.ndarray) -> Rows:
    data, ends, known = _folded(data, ends)
    return *_tight(data, ends), known


def _clitics(data: np.ndarray, ends: np.ndarray, word: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks in ``start`` the tokens with an apostrophe (``n't`` at a word's end, ``'`` with lower-case letters); returns the rows
    with an ``n't`` before a further sign of a word, which are not for here."""
    mark = np.flatnonzero(data == ord("'"))
    row = rows_of(mark, ends)

    def at(k: int) -> np.ndarray:
        place = mark + k
        return np.where((place >= ends[row]) & (place < ends[row + 1]), data[np.clip(place, 0, len(data) - 1)], 0)

    negates = (at(-1) == ord("n")) & (at(1) == ord("t"))
    inside = negates & IS_WORD[at(2)]
    nots = mark[negates & ~inside]
    clitic = ~negates & IS_LOW[at(1)] & ~np.isin(mark + 1, nots - 1)
    if clitic.any():
        begin = mark[clitic]
        other = np.append(np.flatnonzero(~IS_LOW[data]), len(data))
        behind = other[np.searchsorted(other, begin + 1)]
        start[begin + 1] = False
        behind = behind[behind < ends[row[clitic] + 1]]
        start[behind[word[behind]]] = True
    start[nots - 1] = True
    start[nots] = False
    start[nots + 1] = False
    return row[inside]


def _kept(data: np.ndarray, ends: np.ndarray, known: np.ndarray, stop: pa.Array) -> Rows:
    """The tokens that are not in ``stop``, with one blank between them."""
    if not len(data):
        return data, ends, known
    word, filled = IS_WORD[data], ~IS_SPACE[data]
    start = filled.copy()
    start[1:] &= ~(word[1:] & word[:-1])
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    start[firsts] = filled[firsts]
    if (data == ord("'")).any():
        known = known.copy()
        known[_clitics(data, ends, word, start)] = False
    last = filled.copy()
    last[:-1] &= start[1:] | ~filled[1:]
    begin = np.flatnonzero(start)
    length = np.flatnonzero(last) + 1 - begin
    signs = data[filled]
    upto = np.searchsorted(begin, ends, "left")  # tokens before each row's end
    if len(stop):
        places = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        tokens = pa.StringArray.from_buffers(len(length), pa.py_buffer(places), pa.py_buffer(signs))
        own = ~pc.is_in(tokens, value_set=stop).to_numpy(zero_copy_only=False)
        signs, length, upto = signs[np.repeat(own, length)], length[own], np.concatenate([[0], np.cumsum(own)])[upto]
    blank = np.ones(len(length), bool)  # behind all tokens of a row but the last
    blank[upto[1:][upto[1:] > upto[:-1]] - 1] = False
    place = np.concatenate([[0], np.cumsum(length + blank)])
    out = np.full(place[-1], ord(" "), np.uint8)
    sign = np.ones(len(out), bool)
    sign[place[1:][blank] - 1] = False
    out[sign] = signs
    return out, place[upto], known


def _texts(data: np.ndarray, ends: np.ndarray, known: np.ndarray) -> pa.Array:
    nulls = None if known.all() else pa.py_buffer(np.packbits(known, bitorder="little"))
    return pa.StringArray.from_buffers(len(known), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)), nulls)


def _by_block(texts: pa.Array, step: Callable[[np.ndarray, np.ndarray], Rows]) -> pa.Array:
    parts, given, at = [], ~texts.is_null().to_numpy(zero_copy_only=False), 0
    for data, ends in blocks(texts):
        data, ends, known = step(data, ends)
        parts.append(_texts(data, ends, known & given[at:at + len(known)]))
        at += len(known)
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def clean_by_batch() -> Callable[[Column], Column]:
    """``clean_text`` of the texts that it makes ASCII only by single signs, NULL for others."""
    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return _by_block(texts, _cleaned)

    return cleaned.asNondeterministic()


def clean(text: Column) -> Column:
    """``functions.text.clean_text``, by Arrow batches where they can."""
    return F.coalesce(clean_by_batch()(text), T.clean_text(text))


def kept_by_batch(stopwords: Sequence[str]) -> Callable[[Column], Column]:
    """The tokens of a cleaned text (``tokenize``) without ``stopwords``, joined by one blank; NULL as in ``clean_by_batch``."""
    words = list(stopwords)

    @F.arrow_udf("string")
    def kept(texts: pa.Array) -> pa.Array:
        stop = pa.array(words, pa.string())
        return _by_block(texts, lambda data, ends: _kept(*_cleaned(data, ends), stop))

    return kept.asNondeterministic()
