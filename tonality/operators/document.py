"""The per-episode statistics document (nested: speakers -> measures, details, totals).

Every per-speaker measure is rendered as a string (missing -> "nan"); the
totals stay integers.  Key names follow the established output layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.operators.stats import LABEL_SHORT, SCORERS
from tonality.session import sized_broadcast

# FIXED VALUES — key names of the statistics document layout.
SCORER_KEY = {"lex": "vader", "model": "roBERTa"}
TOTAL_KEY = {"lex": "VADER", "model": "roBERTa"}
MEASURE_KEY = {"avg": "Average", "median": "Median", "std": "Std"}
LABEL_KEY = {"pos": "Positive", "neu": "Neutral", "neg": "Negative"}
UNKNOWN_SPEAKER = "unknown"  # lines whose code the dimension does not have
MEASURE_ORDER = ("avg", "median", "std", "count")


def document_keys() -> list[tuple[str, str]]:
    """(document key, statistics column) in document order."""
    out = []
    for s in SCORERS:
        for m in MEASURE_ORDER:
            for _, short in LABEL_SHORT:
                if m == "count":
                    key = f"{SCORER_KEY[s]}{LABEL_KEY[short]}SentencesCount"
                else:
                    key = f"{SCORER_KEY[s]}{MEASURE_KEY[m]}{LABEL_KEY[short]}"
                out.append((key, f"{s}_{m}_{short}"))
    out.append(("TotalSentencesCount", "total_count"))
    return out


def measure_string(c: Column, is_count: bool) -> Column:
    """A measure as text in full precision, "nan" where it is missing."""
    if is_count:
        return c.cast("string")
    return F.when(c.isNull() | F.isnan(c), F.lit("nan")).otherwise(c.cast("string"))


def statistics_document(stats: DataFrame, totals: DataFrame, modes: DataFrame,
                        details: DataFrame, by: Sequence[str] = ("Episode",)) -> DataFrame:
    """``(Episode, doc struct, document JSON)``, one row per episode.

    In the JSON the speakers are keys of the top level, before ``Episode``, ``Details`` and ``UsefulStatistics``.

    ``stats`` = character_statistics, ``totals`` = sentiment_totals, ``modes`` =
    modal_sentiment, ``details`` = episode dimension.  Per-episode speaker rows
    are bounded by the character dimension.
    """
    measures = F.create_map(*[x for key, col in document_keys()
                              for x in (F.lit(key), measure_string(F.col(col), "count" in col))])
    per_char = stats.select(*by, "char_order", F.struct(
        F.col("char_order"), F.col("Character"), measures.alias("m")).alias("_c"))
    # map values do not sort: the order and the name come first and are never equal
    chars = per_char.groupBy(*by).agg(F.array_sort(
        F.collect_list("_c"),
        lambda a, b: F.when(a["char_order"] < b["char_order"], -1).when(a["char_order"] > b["char_order"], 1)
        .when(a["char_order"].isNull() & b["char_order"].isNotNull(), 1)
        .when(a["char_order"].isNotNull() & b["char_order"].isNull(), -1)
        .when(a["Character"] < b["Character"], -1).otherwise(1)).alias("_cs"))
    chars = chars.select(*by, F.map_from_entries(F.transform(
        "_cs", lambda c: F.struct(F.coalesce(c["Character"], F.lit(UNKNOWN_SPEAKER)), c["m"]))).alias("characters"))
    useful = F.struct(
        F.col("model_mode").alias("roBERTaModalMajorSentiment"),
        F.col("lex_mode").alias("VADERModalMajorSentiment"),
        *[F.col(f"{s}_total_{short}").alias(f"{TOTAL_KEY[s]}Total{LABEL_KEY[short]}Sentences")
          for s in ("model", "lex") for _, short in LABEL_SHORT])
    doc = (chars.join(totals, list(by)).join(modes, list(by))
           .join(sized_broadcast(details), list(by), "left"))
    out = doc.select(*by, F.struct(
        F.col("characters"), F.col(by[0]).alias("Episode"),
        F.struct("Description", "Duration").alias("Details"),
        useful.alias("UsefulStatistics")).alias("doc"))
    rest = F.to_json(F.struct("doc.Episode", "doc.Details", "doc.UsefulStatistics"))
    return out.withColumn("document", F.when(F.size("doc.characters") > 0, F.concat(
        F.expr("left(to_json(doc.characters), length(to_json(doc.characters)) - 1)"), F.lit(","), F.expr("substring(to_json(struct(doc.Episode, doc.Details, doc.UsefulStatistics)), 2)")))
        .otherwise(rest))


def flatten_document(doc: DataFrame, by: Sequence[str] = ("Episode",)) -> DataFrame:
    """``(Episode, section, name, key, value)`` rows of the document, for checks."""
    chars = doc.select(*by, F.explode("doc.characters").alias("name", "m")).select(
        *by, F.lit("character").alias("section"), "name",
        F.explode("m").alias("key", "value"))
    det = doc.select(*by, F.lit("Details").alias("section"), F.lit(None).cast("string").alias("name"),
                     F.explode(F.create_map(F.lit("Description"), F.col("doc.Details.Description"),
                                            F.lit("Duration"), F.col("doc.Details.Duration")))
                     .alias("key", "value"))
    us_fields = doc.select("doc.UsefulStatistics.*").columns
    use = doc.select(*by, F.lit("UsefulStatistics").alias("section"),
                     F.lit(None).cast("string").alias("name"),
                     F.explode(F.create_map(*[x for f in us_fields for x in (
                         F.lit(f), F.col(f"doc.UsefulStatistics.{f}").cast("string"))]))
                     .alias("key", "value"))
    return chars.unionByName(det).unionByName(use)
