"""Shared inputs of the registered queries: the driver's tables bound to utterances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions.text import clean_text, extract_words
from tonality.operators.lexicon import Rules, generated_valence
from tonality.operators.prepare import prepare_utterances
from tonality.operators.text_batches import clean
from tonality.plans.pipeline import Scoring, scored_table
from tonality.resources import BOOST_INCREMENT, BOOSTERS, CONTRAST_WORDS, NEGATORS, default_stopword_list
from tonality.session import materialize
from tonality.sources.dimensions import characters_df, episodes_df
from tonality.sources.utterances import utterances_from_table
from tonality.sources.wordlists import booster_df, idiom_df, lexicon_from_rows, negator_df

# The prose of the tables is invented; its commonest small words stand in for modifiers, so that every rule fires.
BOUND_BOOSTERS = [*BOOSTERS, ("of", BOOST_INCREMENT), ("with", -BOOST_INCREMENT), ("de", BOOST_INCREMENT)]
BOUND_NEGATORS = [*NEGATORS, "for", "by", "que"]
BOUND_CONTRAST = (*CONTRAST_WORDS, "from", "und")
# Common phrases of the tables, as idioms and as boosters of two words.
BOUND_IDIOMS = [("of the", 3.0), ("the and", -2.0), ("the the the", 1.5), ("de la", 2.5), ("and the of", -1.5), ("the to", -3.0)]
BOUND_PHRASES = [("is the", -BOOST_INCREMENT), ("and and", BOOST_INCREMENT)]
# Stopword list B: words in at least one of so many turns of ``conversations``.
COMMON_SHARE = 20
# Setting with which a caller deals out tables of too few file splits (bench.py).
PARTITIONS_CONF = "spark.tonality.inputPartitions"


@dataclass
class Inputs:
    spark: SparkSession
    sf_dir: str
    table: str = "documents"

    def utterances(self) -> DataFrame:
        n = self.spark.conf.get(PARTITIONS_CONF, None)
        return utterances_from_table(self.spark, self.sf_dir, self.table, int(n) if n else None)

    def characters(self, rows=None) -> DataFrame:
        return characters_df(self.spark, rows)

    def episodes(self) -> DataFrame:
        return episodes_df(self.spark)

    def stopwords_a(self) -> list[str]:
        return list(default_stopword_list())

    def stopwords_b(self) -> DataFrame:
        """Words that at least one turn in ``COMMON_SHARE`` holds, from the whole table."""
        turns = utterances_from_table(self.spark, self.sf_dir, "conversations")
        words = turns.select(F.explode(F.array_distinct(extract_words(clean_text("Text")))).alias("word"))
        counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        total = turns.agg(F.count(F.lit(1)).alias("turns"))
        # computed once: the check of its size and the anti-join both read it
        return materialize(counts.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")  # one row
                           .where(F.col("n") * COMMON_SHARE >= F.col("turns")).select("word"))

    def rules(self) -> Rules:
        return Rules(lexicon_from_rows(self.spark), booster_df(self.spark, BOUND_BOOSTERS),
                     negator_df(self.spark, BOUND_NEGATORS), generated_valence, BOUND_CONTRAST)

    def rules_with_idioms(self) -> Rules:
        return Rules(lexicon_from_rows(self.spark), booster_df(self.spark, [*BOUND_BOOSTERS, *BOUND_PHRASES]),
                     negator_df(self.spark, BOUND_NEGATORS), generated_valence, BOUND_CONTRAST, idiom_df(self.spark, BOUND_IDIOMS))

    def scoring(self, **kw) -> Scoring:
        return Scoring(self.rules(), **kw)

    def scored(self, **kw) -> DataFrame:
        return scored_table(self.prepared(), self.scoring(**kw))

    def prepared(self, keep_tokens: bool = False, characters: DataFrame | None = None) -> DataFrame:
        return prepare_utterances(self.utterances(), characters or self.characters(), self.stopwords_a(),
                                  keep_tokens=keep_tokens)

    def plain(self) -> DataFrame:
        """Utterances with cleaned text, stopwords kept: for the rules that look at small words."""
        return self.utterances().withColumn("PlainText", clean(F.col("Text")))
