"""Word statistics: frequency per episode, anti-join with a stopword list, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonality.functions.text import extract_words
from tonality.session import sized_broadcast


def word_anti_join(words: DataFrame, stopwords: DataFrame, word_col: str = "word") -> DataFrame:
    """Rows of ``words`` whose word is not in ``stopwords`` (first column)."""
    stop = stopwords.select(F.col(stopwords.columns[0]).alias(word_col)).distinct()
    return words.join(sized_broadcast(stop), word_col, "left_anti")


def word_frequency(df: DataFrame, stopwords: DataFrame | None, by: Sequence[str] = ("Episode",),
                   text_col: str = "CleanText") -> DataFrame:
    """``(by..., word, wordsCount)``: occurrences of each ``\\w+`` word not in ``stopwords``.

    One partial + final hash aggregate: a hot word is pre-counted in every map task.
    """
    words = df.select(*by, F.explode(extract_words(text_col)).alias("word"))
    if stopwords is not None:
        words = word_anti_join(words, stopwords)
    return words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("wordsCount"))


def ordered(freq: DataFrame, by: Sequence[str] = ("Episode",), count_col: str = "wordsCount") -> DataFrame:
    """The word table in descending order of counts (a range-partitioned sort), ties by word."""
    return freq.orderBy(*by, F.col(count_col).desc(), "word")


def top_words(freq: DataFrame, n: int = 10, by: Sequence[str] = ("Episode",),
              count_col: str = "wordsCount") -> DataFrame:
    """The ``n`` most frequent words per group, ties broken by word, with their rank.

    ``row_number() <= n`` lets Spark insert a map-side group limit before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(F.col(count_col).desc(), F.col("word"))
    return (freq.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n))


def wordcloud_weights(freq: DataFrame, max_words: int = 50, by: Sequence[str] = ("Episode",),
                      count_col: str = "wordsCount") -> DataFrame:
    """Word-cloud input: the top ``max_words`` words and their weight relative to the largest."""
    top = top_words(freq, max_words, by, count_col)
    w = Window.partitionBy(*by)
    return top.withColumn("weight", F.col(count_col) / F.max(count_col).over(w))
