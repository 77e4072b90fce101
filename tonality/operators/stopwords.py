"""Stopword removal from token arrays, order and duplicates kept.

A stopword list with a proven small size is inlined as a hashed IN-set inside a higher-order ``filter`` (no
shuffle).  A larger list is anti-joined: the tokens are exploded with a row number and their position and put
together again.  Both plans give the same rows: NULL tokens stay NULL, a row of stopwords only becomes an empty
array, and equal rows stay apart.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.session import is_small, materialize

INLINE_MAX_WORDS = 20_000


def drop_stopwords_expr(tokens: Column, words: list[str]) -> Column:
    """Tokens not in ``words``, order and duplicates kept."""
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))


def remove_stopwords(df: DataFrame, stopwords: DataFrame | Iterable[str], tokens_col: str,
                     out_col: str | None = None) -> DataFrame:
    """Replace ``tokens_col`` (array<string>) by its tokens that are not stopwords."""
    out_col = out_col or tokens_col
    words = inline_words(stopwords)
    if words is not None:
        return df.withColumn(out_col, drop_stopwords_expr(F.col(tokens_col), words))
    if not isinstance(stopwords, DataFrame):
        stopwords = df.sparkSession.createDataFrame([(w,) for w in sorted(set(stopwords))], "word string")
    return _anti_joined(df, _distinct(stopwords), tokens_col, out_col)


def _distinct(stopwords: DataFrame) -> DataFrame:
    return stopwords.select(F.col(stopwords.columns[0]).alias("_t")).where("_t IS NOT NULL").distinct()


def inline_words(stopwords: DataFrame | Iterable[str]) -> list[str] | None:
    """The words of a list of proven small size, else None."""
    if isinstance(stopwords, DataFrame):
        stop = _distinct(stopwords)
        return sorted(r[0] for r in stop.collect()) if is_small(stop, INLINE_MAX_WORDS) else None
    words = sorted(set(stopwords))
    return words if len(words) <= INLINE_MAX_WORDS else None


def _anti_joined(df: DataFrame, stop: DataFrame, tokens_col: str, out_col: str) -> DataFrame:
    """The plan for large lists; ``stop`` has the words in ``_t``."""
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))  # the numbers must not change again
    tokens = rows.select("_row", F.posexplode(tokens_col).alias("_p", "_t"))
    kept = (tokens.join(stop, "_t", "left_anti").groupBy("_row")
            .agg(F.sort_array(F.collect_list(F.struct("_p", "_t"))).alias("_kept")))
    words = F.coalesce(F.transform("_kept", lambda s: s["_t"]), F.array().cast("array<string>"))
    return rows.join(kept, "_row", "left").withColumn(
        out_col, F.when(F.col(tokens_col).isNotNull(), words)).select(
            *df.columns, *([out_col] if out_col not in df.columns else []))
