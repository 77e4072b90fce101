"""A small table as an expression with a hash table inside: the cost of a lookup does not grow with the table."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a bucket on the average.
LOAD = 2
#: A table of so many words tells by a set first whether it has a word.
GUARDED = 500


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashed_lookup(rows: Mapping[str, object], kind: str = "double") -> Callable[[Column], Column]:
    """``word -> value`` of type ``kind`` (NULL for other words and for NULL).

    Words lie in buckets by their CRC-32.  The buckets travel as one JSON literal, which Spark's optimizer folds into an
    array of small maps; a lookup picks a bucket by number and searches only that one.  Values must be finite.
    """
    if not rows:
        return lambda t: F.lit(None).cast(kind)
    buckets: list[dict] = [{} for _ in range(max(1, len(rows) // LOAD))]
    for word, value in rows.items():
        buckets[zlib.crc32(word.encode()) % len(buckets)][word] = value
    table = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False, allow_nan=False)), f"array<map<string,{kind}>>")

    def find(t: Column) -> Column:
        bucket = (F.crc32(t.cast("binary")) % len(buckets)).cast("int")
        return F.try_element_at(F.get(table, bucket), t)

    if len(rows) > GUARDED:
        return find
    words = sorted(rows)
    return lambda t: F.when(t.isin(words), find(t))
