"""Statistics over the scored utterance table, grouped by episode.

Counts, means and deviations are partial aggregates of constant size in every task: a group's state is its count, mean and
sum of squared distances from the mean, merged pairwise, so large values lose no digits.  Only medians and quartiles need
the values themselves; they go by ranges of (group, value) (``operators.ranges``), and no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonality.operators.ranges import quantiles
from tonality.session import materialize, sized_broadcast


def null_count(df: DataFrame, col: str = "Character", by: Sequence[str] = ("Episode",)) -> DataFrame:
    """Lines without a speaker code (the secondary speakers' lines), per group."""
    return df.groupBy(*by).agg(F.count_if(F.col(col).isNull()).alias("null_count"))


def distinct_characters(df: DataFrame, col: str = "Character",
                        by: Sequence[str] = ("Episode",)) -> DataFrame:
    return df.select(*by, col).distinct()


def episode_details(df: DataFrame, episodes: DataFrame) -> DataFrame:
    """Left join of the episode dimension; unknown episodes keep NULL details."""
    return df.join(sized_broadcast(episodes), "Episode", "left")


# ---------------------------------------------------------------- labels & totals

SCORERS = ("lex", "model")
LABEL_SHORT = (("Positive", "pos"), ("Neutral", "neu"), ("Negative", "neg"))


def sentiment_totals(scored: DataFrame, by: Sequence[str] = ("Episode",)) -> DataFrame:
    """Rows per prevailing label and scorer, plus all rows; one pass."""
    aggs = [F.count_if(F.col(f"{s}_label") == lab).alias(f"{s}_total_{short}")
            for s in SCORERS for lab, short in LABEL_SHORT]
    return scored.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("total_count"))


def sentiment_share(scored: DataFrame, by: Sequence[str] = ("Episode",)) -> DataFrame:
    t = sentiment_totals(scored, by)
    return t.select(*by, *[(F.col(f"{s}_total_{short}") / F.col("total_count")).alias(f"{s}_share_{short}")
                           for s in SCORERS for _, short in LABEL_SHORT], "total_count")


def modal_sentiment(scored: DataFrame, by: Sequence[str] = ("Episode",),
                    order_col: str = "SentenceIndex") -> DataFrame:
    """Most frequent label per scorer; a tie goes to the label seen first in ``order_col`` order.

    One pass for both scorers: each row contributes (scorer, label) twice, the
    counts are partial-aggregated, and the pick is over at most 3 labels per scorer.
    """
    pairs = F.array(*[F.struct(F.lit(s).alias("scorer"), F.col(f"{s}_label").alias("label"))
                      for s in SCORERS])
    per = (scored.select(*by, order_col, F.inline(pairs))
           .groupBy(*by, "scorer", "label")
           .agg(F.count(F.lit(1)).alias("n"), F.min(order_col).alias("first_seen")))
    best = per.groupBy(*by).agg(*[
        F.max_by(F.col("label"), F.when(F.col("scorer") == s, F.struct(F.col("n"), -F.col("first_seen"))))
        .alias(f"{s}_mode") for s in SCORERS])
    return best


def fill_characters(stats: DataFrame, characters: DataFrame, by: Sequence[str],
                    zero_cols: Sequence[str] = ()) -> DataFrame:
    """Expand per-(group, character) rows to every character of the dimension, in dimension order (``char_order``).

    Characters seen in a group but absent from the dimension (NULL for codes that could not be decoded) stay, with a
    NULL ``char_order``; characters without rows get 0 in ``zero_cols`` and NULL elsewhere.
    """
    dim = characters.select(F.monotonically_increasing_id().alias("_id"), F.col("name").alias("Character"))
    dim = dim.withColumn("char_order", (F.row_number().over(Window.orderBy("_id")) - 1)).drop("_id")  # the dimension only
    # each group with each name of the dimension: that many rows are the result
    groups = stats.select(*by).distinct().withColumn("_k", F.lit(1)).join(
        sized_broadcast(dim.withColumn("_k", F.lit(1))), "_k").drop("_k").withColumn("_in", F.lit(True))
    # null-safe keys: a group or a name may be NULL
    own = stats.withColumnsRenamed({c: f"_{c}" for c in (*by, "Character")})
    same = F.lit(True)
    for c in (*by, "Character"):
        same = same & groups[c].eqNullSafe(own[f"_{c}"])
    out = groups.join(own, same, "full_outer")
    return out.select(
        *[F.when(F.col("_in"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in by], "char_order",
        F.when(F.col("_in"), F.col("Character")).otherwise(F.col("_Character")).alias("Character"),
        *[F.coalesce(c, F.lit(0)).alias(c) if c in zero_cols else F.col(c)
          for c in stats.columns if c not in (*by, "Character")])


def character_counts(scored: DataFrame, characters: DataFrame,
                     by: Sequence[str] = ("Episode",)) -> DataFrame:
    """Sentences per character, 0 for characters without lines, in dimension order."""
    counts = scored.groupBy(*by, "Character").agg(F.count(F.lit(1)).alias("total_count"))
    return fill_characters(counts, characters, by, zero_cols=["total_count"])


MEASURES = ("avg", "median", "std", "count")


def measure_columns(scorers=SCORERS, measures=MEASURES) -> list[str]:
    return [f"{s}_{m}_{short}" for s in scorers for m in measures for _, short in LABEL_SHORT]


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the further columns of ``right`` by ``keys``, of which any may be NULL."""
    own = right.withColumnsRenamed({c: f"_{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same = same & left[c].eqNullSafe(own[f"_{c}"])
    return left.join(own, same, "left").drop(*[f"_{c}" for c in keys])


def chosen_scores(scored: DataFrame, by: Sequence[str], scorers: Sequence[str] = SCORERS) -> DataFrame:
    """``by, scorer, short, score``: of each row the score that each scorer gave for the label it chose."""
    pairs = F.array(*[F.struct(F.lit(s).alias("scorer"), F.when(F.col(f"{s}_label") == lab, F.lit(short)).alias("short"),
                               F.when(F.col(f"{s}_label") == lab, F.col(f"{s}_{short}")).alias("score"))
                      for s in scorers for lab, short in LABEL_SHORT])
    return scored.select(*by, F.inline(pairs)).where("short IS NOT NULL")


def score_medians(scored: DataFrame, by: Sequence[str], scorers: Sequence[str] = SCORERS) -> DataFrame:
    """``by, scorer, short, median`` of ``chosen_scores``, exact."""
    own = quantiles(chosen_scores(scored, by, scorers), [*by, "scorer", "short"], "score", [0.5])
    return own.select(*by, "scorer", "short", F.col("q")[0].alias("median"))


#: Aggregates whose state has the same size for any number of rows.
CONSTANT_SIZE = {"avg": F.avg, "std": F.stddev_samp, "count": F.count}


def character_statistics(scored: DataFrame, characters: DataFrame, by: Sequence[str] = ("Episode",),
                         measures: Sequence[str] = MEASURES, scorers: Sequence[str] = SCORERS) -> DataFrame:
    """Per (group, character): for each scorer and label X, count / mean / median / sample std of the X score over
    rows labelled X, plus all rows of the character.

    Without medians this is one aggregate.  With them, what the statistics read of a row is written once and read by
    the aggregate and by the medians.  Characters without lines appear with count 0 and NULL measures.
    """
    group = [*by, "Character"]
    medians = "median" in measures
    if medians:
        scored = materialize(scored.select(*group, *[c for s in scorers for c in (
            f"{s}_label", *[f"{s}_{short}" for _, short in LABEL_SHORT])]))
    own = {(s, short): F.when(F.col(f"{s}_label") == lab, F.col(f"{s}_{short}")) for s in scorers for lab, short in LABEL_SHORT}
    stats = scored.groupBy(*group).agg(
        *[CONSTANT_SIZE[m](own[s, short]).alias(f"{s}_{m}_{short}") for s in scorers for m in measures if m in CONSTANT_SIZE
          for _, short in LABEL_SHORT], F.count(F.lit(1)).alias("total_count"))
    if medians:
        wide = score_medians(scored, group, scorers).groupBy(*group).agg(
            *[F.max(F.when((F.col("scorer") == s) & (F.col("short") == short), F.col("median"))).alias(f"{s}_median_{short}")
              for s in scorers for _, short in LABEL_SHORT])
        stats = join_groups(stats, wide, group)
    cols = measure_columns(scorers, measures)
    return fill_characters(stats.select(*group, *cols, "total_count"), characters, by,
                           zero_cols=[c for c in cols if "_count_" in c] + ["total_count"])


def statistics_long(stats: DataFrame, by: Sequence[str] = ("Episode",)) -> DataFrame:
    """Long form ``(group, Character, measure, value)`` of ``character_statistics``."""
    ids = [*by, "char_order", "Character"]
    vals = [c for c in stats.columns if c not in ids]
    return stats.select(*ids, *[F.col(c).cast("double").alias(c) for c in vals]).unpivot(
        ids, vals, "measure", "value")


def describe_scores(scored: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ("Episode",)) -> DataFrame:
    """count / mean / std / min / exact quartiles / max of each numeric column (all by default), long form.

    The columns are written once; counts, means, deviations and ends are one aggregate over them, quartiles go by ranges.
    """
    if cols is None:
        cols = [f.name for f in scored.schema if isinstance(f.dataType, T.NumericType) and f.name not in by]
    values = materialize(scored.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]))
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = values.groupBy(*by).agg(*[fn(c).alias(f"{c}:{name}") for c in cols for name, fn in parts.items()])
    long = wide.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[
        F.col(f"`{c}:{name}`").alias(name) for name in parts]) for c in cols])))
    quarters = quantiles(values.unpivot(list(by), list(cols), "column", "x"), [*by, "column"], "x", [0.25, 0.5, 0.75])
    return join_groups(long, quarters, [*by, "column"]).select(
        *by, "column", "count", "mean", "std", "min", *[F.col("q")[i].alias(q) for i, q in enumerate(("q25", "q50", "q75"))], "max")


def row_counts(df: DataFrame, by: Sequence[str] = ("Episode",)) -> DataFrame:
    """Rows per group and the column count of the table (its shape)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)))


def schema_report(df: DataFrame) -> DataFrame:
    """Column names and types of ``df`` (metadata only; no data is read)."""
    spark = df.sparkSession
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)],
                                 "position int, column string, type string")


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("Episode", "SentenceIndex")) -> DataFrame:
    """Keys that occur more than once, with their multiplicity."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
