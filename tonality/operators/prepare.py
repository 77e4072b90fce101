"""Utterance preparation: decode speakers, clean text, drop stopwords.

Output columns: ``Episode, SentenceIndex, CharacterCode, Character, Text`` (raw,
kept), ``CleanText`` (cleaned text without stopwords, tokens joined by one
space; what the scorers and word statistics read) and optionally ``Tokens``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.functions.text import clean_text, tokenize
from tonality.operators.characters import decode_character
from tonality.operators.stopwords import drop_stopwords_expr, inline_words, remove_stopwords
from tonality.operators.text_batches import kept_by_batch


def prepare_utterances(utt: DataFrame, characters: DataFrame,
                       stopwords: DataFrame | Iterable[str], keep_tokens: bool = False,
                       strict: bool = False, tokens: Callable[[Column], Column] = tokenize) -> DataFrame:
    """``tokens`` cuts cleaned text: ``tokenize``, or ``functions.treebank.treebank_tokens`` for the Treebank convention."""
    decoded = decode_character(utt, characters, strict=strict)
    stopwords = stopwords if isinstance(stopwords, DataFrame) else sorted(set(stopwords))
    words = inline_words(stopwords) if tokens is tokenize and not keep_tokens else None
    if words is not None:
        # by Arrow batches, and by the expressions where those give none
        joined = F.array_join(drop_stopwords_expr(tokenize(clean_text("Text")), words), " ")
        return decoded.withColumn("CleanText", F.coalesce(kept_by_batch(words)(F.col("Text")), joined)).drop("Tokens")
    cut = decoded.withColumn("Tokens", tokens(clean_text("Text")))
    kept = remove_stopwords(cut, stopwords, "Tokens")
    out = kept.withColumn("CleanText", F.array_join("Tokens", " "))
    return out if keep_tokens else out.drop("Tokens")
