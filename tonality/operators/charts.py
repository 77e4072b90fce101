"""Chart-ready tables (the data behind each chart; rendering is not done here)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.operators.stats import LABEL_SHORT, score_medians


def chart_share(scored: DataFrame, scorer: str = "model", by: Sequence[str] = ("Episode",)) -> DataFrame:
    """Pie chart: rows per label and their percentage (one decimal) per group."""
    counts = scored.groupBy(*by).agg(
        *[F.count_if(F.col(f"{scorer}_label") == lab).alias(lab) for lab, _ in LABEL_SHORT],
        F.count(F.lit(1)).alias("_total"))
    stack = F.array(*[F.struct(F.lit(i).alias("label_order"), F.lit(lab).alias("label"),
                               F.col(lab).alias("n")) for i, (lab, _) in enumerate(LABEL_SHORT)])
    return counts.select(*by, "_total", F.inline(stack)).select(
        *by, "label_order", "label", "n", F.round(F.col("n") * 100.0 / F.col("_total"), 1).alias("percent"))


def chart_median_by_label(scored: DataFrame, scorer: str = "model",
                          by: Sequence[str] = ("Episode",)) -> DataFrame:
    """Three bar series: per character with rows of label X, the median X score."""
    label = F.create_map(*[F.lit(x) for lab, short in LABEL_SHORT for x in (short, lab)])
    return score_medians(scored, [*by, "Character"], [scorer]).select(*by, "Character", label[F.col("short")].alias("label"), "median")


def _grouped_bars(stats: DataFrame, measure: str, scorer: str, by: Sequence[str]) -> DataFrame:
    cols = [f"{scorer}_{measure}_{short}" for _, short in LABEL_SHORT]
    stack = F.array(*[F.struct(F.lit(c).alias("series"), F.round(F.col(c), 3).alias("value"))
                      for c in cols])
    return stats.select(*by, "char_order", "Character", F.inline(stack))


def chart_std(stats: DataFrame, scorer: str = "model", by: Sequence[str] = ("Episode",)) -> DataFrame:
    """Grouped bars: per character, the std of each label's score, rounded to 3."""
    return _grouped_bars(stats, "std", scorer, by)


def chart_median(stats: DataFrame, scorer: str = "model", by: Sequence[str] = ("Episode",)) -> DataFrame:
    """Grouped bars: per character, the median of each label's score, rounded to 3."""
    return _grouped_bars(stats, "median", scorer, by)
