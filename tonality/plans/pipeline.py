"""The whole analysis as one composed plan: prepare -> score -> label -> statistics.

Scoring is row-local: both scorers append columns to the prepared rows, so that no key join and no shuffle is needed and
a query that reads only one scorer's columns does not pay for the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonality.operators.lexicon import Rules, lexicon_scores
from tonality.operators.model import (LINEAR_KEY, LOGIT_COLS, ScorerKey, linear_scores, model_rejects,
                                     score_with_pandas, with_softmax)

KEYS = ("Episode", "SentenceIndex")
SCORED = (*KEYS, "CharacterCode", "Character", "lex_neg", "lex_neu", "lex_pos", "lex_compound",
          "model_neg", "model_neu", "model_pos", "model_label", "lex_label")


@dataclass
class Scoring:
    """Which scorers run and what happens to repeated keys.

    ``duplicates``: ``keep`` scores every row (the default; no shuffle), ``last`` keeps of each key the row
    that is last by ``order_col``, ``error`` fails on a repeated key.
    """

    rules: Rules
    model_key: ScorerKey = LINEAR_KEY
    model_factory: Callable | None = None      # None = native linear scorer
    model_weights: DataFrame | None = None     # its weights (word, neg, neu, pos); None = the fixture rule
    neutral_when_empty: bool = False
    duplicates: str = "keep"
    order_col: str | None = None


def one_per_key(df: DataFrame, sc: Scoring, keys: Sequence[str] = KEYS) -> DataFrame:
    """The rows of ``df`` under the policy for repeated keys."""
    if sc.duplicates == "keep":
        return df
    if sc.duplicates == "last":
        if sc.order_col is None:
            raise ValueError("duplicates='last' needs order_col")
        # among equal places the row with the largest hash; every task keeps one row of a key before the shuffle
        last = F.max_by(F.struct(*df.columns), F.struct(F.col(sc.order_col), F.xxhash64(*df.columns)))
        return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(last.alias("_last")).select("_last.*")
    if sc.duplicates == "error":
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        fail = F.raise_error(F.concat(F.lit("repeated key: "), F.concat_ws(", ", *keys)))
        return df.withColumn("_n", F.when(n > 1, fail).otherwise(n)).where(F.col("_n") == 1).drop("_n")
    raise ValueError(f"unknown policy {sc.duplicates!r}")


def with_model(prepared: DataFrame, sc: Scoring) -> DataFrame:
    """All rows with model scores and ``model_error`` (NULL = scored)."""
    if sc.model_factory is None:
        # the raw text is NULL where the cleaned one is, and its test reaches the scan
        text = "Text" if "Text" in prepared.columns else "CleanText"
        return linear_scores(prepared, weights=sc.model_weights).withColumn("model_error", F.when(F.col(text).isNull(), "null text"))
    out = score_with_pandas(prepared, sc.model_key, sc.model_factory, "CleanText", passthrough=prepared.columns)
    return with_softmax(out).drop(*LOGIT_COLS)


def with_scores(prepared: DataFrame, sc: Scoring) -> DataFrame:
    """All rows with both scorers' scores and labels and ``model_error``; ``prepared``'s columns stay."""
    return lexicon_scores(with_model(one_per_key(prepared, sc), sc), sc.rules, "CleanText", sc.neutral_when_empty)


def scored_table(prepared: DataFrame, sc: Scoring) -> DataFrame:
    """Keys, speaker, both scorers' scores and labels of every row that the model scored."""
    return with_scores(prepared, sc).where("model_error IS NULL").select(*SCORED)


def full_table(scores: DataFrame) -> DataFrame:
    """The export: the scored rows of ``with_scores`` with raw and cleaned text."""
    return scores.where("model_error IS NULL").select(*SCORED, "Text", "CleanText")


def run_pipeline(spark, utterances: DataFrame, characters: DataFrame, episodes: DataFrame,
                 stopwords_a, stopwords_b: DataFrame, sc: Scoring, out_dir: str,
                 top_n: int = 10, cloud_words: int = 50) -> dict[str, str]:
    """Run the whole analysis for all episodes in one job and write every output.

    Every row is prepared and scored once: the result is checkpointed to the shared folder
    (``spark.checkpoint.dir``) and feeds the export, the statistics, the words and the rejects, so that a lost executor
    costs a re-read.  Returns the written paths.
    """
    from tonality.operators import charts as CH
    from tonality.operators import document as D
    from tonality.operators import stats as S
    from tonality.operators import words as W
    from tonality.operators.prepare import prepare_utterances
    from tonality.session import materialize
    from tonality.sources.sinks import write_csv, write_document, write_json

    scores = materialize(with_scores(prepare_utterances(utterances, characters, stopwords_a), sc))
    ok, rejects = model_rejects(scores)
    scored = ok.select(*SCORED)
    stats = materialize(S.character_statistics(scored, characters))
    freq = materialize(W.word_frequency(scores, stopwords_b))
    out = {k: f"{out_dir.rstrip('/')}/{k}" for k in (
        "full_csv", "full_json", "document", "statistics", "top_words", "wordcloud",
        "chart_share", "chart_median_by_label", "chart_std", "chart_median", "rejects")}
    full = full_table(scores)
    write_csv(full, out["full_csv"])
    write_json(full, out["full_json"])
    doc = D.statistics_document(stats, S.sentiment_totals(scored), S.modal_sentiment(scored), episodes)
    write_document(doc, out["document"])
    write_json(stats, out["statistics"])
    write_json(W.top_words(freq, top_n), out["top_words"])
    write_json(W.wordcloud_weights(freq, cloud_words), out["wordcloud"])
    write_json(CH.chart_share(scored), out["chart_share"])
    write_json(CH.chart_median_by_label(scored), out["chart_median_by_label"])
    write_json(CH.chart_std(stats), out["chart_std"])
    write_json(CH.chart_median(stats), out["chart_median"])
    write_json(rejects, out["rejects"], partition_by=None)
    return out
