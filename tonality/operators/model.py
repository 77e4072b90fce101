"""Model scorer: 3-class logits -> softmax -> (neg, neu, pos) probabilities.

Two interchangeable scorers:

* ``linear_scores`` — a native linear bag-of-words scorer: per class the mean weight of a row's words.  The weights come from
  the caller's table ``(word, neg, neu, pos)``, of any size, e.g. one learned by ``naive_bayes_weights``.  Without a table they are
  the fixture rule ``((ascii(w) * (k + 3) + length(w)) % 11 - 5) / 10`` for class k = 0 (neg), 1 (neu), 2 (pos): a
  stand-in for real model weights, not a trained model.
* ``score_with_pandas`` — the batch-inference harness: ``mapInPandas`` with a scorer that each Python worker keeps under
  an explicit key and feeds with Arrow batches.  Rows the scorer cannot handle are reported instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.functions.labels import major_sentiment, softmax3
from tonality.functions.lookup import hashed_lookup, let
from tonality.functions.text import WORD_PATTERN, extract_words
from tonality.operators.batches import ascii_or, word_counts_by_batch, word_sums_by_batch
from tonality.operators.lexicon import INLINE_MAX_WORDS
from tonality.session import is_small, materialize

CLASSES = ("neg", "neu", "pos")
LOGIT_COLS = tuple(f"logit_{c}" for c in CLASSES)
SCORE_COLS = tuple(f"model_{c}" for c in CLASSES)

# FIXED VALUES — fixture linear scorer: class multipliers (k + 3), modulus, offset, scale.
LINEAR_MULTIPLIERS = (3, 4, 5)
LINEAR_MODULUS, LINEAR_OFFSET, LINEAR_SCALE = 11, 5, 10.0
#: The sums of the three classes share one long, of so many bits each, as long as a text has at most so many words.
PACKED_BITS = 21
PACKED_WORDS = (1 << PACKED_BITS) // LINEAR_MODULUS


def linear_model(text: Column | str) -> Column:
    """``struct<logits, probabilities, model_label>`` of the fixture linear scorer: per class, the mean word weight (0 for a
    row without words); NULL for a row without a text.

    One fold over the words, which reads the text once; texts of ASCII only are added up by Arrow batches.  Sums stay integral until the final division, so equal
    logits are exactly equal.  The fold adds one long for each word, from a table by its first sign's and its length's remainders;
    texts of more words than the long has room for fold a struct.
    """
    text = F.col(text) if isinstance(text, str) else text
    names = [f"s{m}" for m in LINEAR_MULTIPLIERS]
    start = F.struct(*[F.lit(0).cast("long").alias(x) for x in ("n", *names)])

    def step(acc: Column, w: Column) -> Column:
        return F.struct((acc["n"] + 1).alias("n"),
                        *[(acc[x] + (F.ascii(w) * m + F.length(w)) % LINEAR_MODULUS - LINEAR_OFFSET).alias(x)
                          for x, m in zip(names, LINEAR_MULTIPLIERS)])

    def finish(acc: Column) -> Column:
        return F.struct(*[F.when(acc["n"] > 0, acc[x] / (F.lit(LINEAR_SCALE) * acc["n"])).otherwise(F.lit(0.0)).alias(c)
                          for c, x in zip(LOGIT_COLS, names)])

    remainders = range(LINEAR_MODULUS)
    table = F.lit([sum((a * m + n) % LINEAR_MODULUS << PACKED_BITS * k for k, m in enumerate(LINEAR_MULTIPLIERS))
                   for a in remainders for n in remainders])

    def packed(words: Column) -> Column:
        total = F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.get(
            table, F.ascii(w) % LINEAR_MODULUS * LINEAR_MODULUS + F.length(w) % LINEAR_MODULUS))
        n = F.size(words).cast("long")
        return let(total, lambda t: F.struct(n.alias("n"), *[
            (F.shiftright(t, PACKED_BITS * k).bitwiseAND(F.lit((1 << PACKED_BITS) - 1)) - n * LINEAR_OFFSET).alias(x)
            for k, x in enumerate(names)]))

    def sums(words: Column) -> Column:
        return F.when(F.size(words) <= PACKED_WORDS, packed(words)).otherwise(F.aggregate(words, start, step))

    folded = let(extract_words(text), lambda words: F.when(words.isNotNull(), sums(words)))
    total = ascii_or(text, word_sums_by_batch(names, LINEAR_MULTIPLIERS, LINEAR_MODULUS, LINEAR_OFFSET), folded)
    return let(let(total, lambda acc: F.when(acc.isNotNull(), finish(acc))), _scored)


def _scored(m: Column) -> Column:
    """Logits, probabilities and label from a struct of logits."""
    logits = [m[c] for c in LOGIT_COLS]
    return F.struct(*[x.alias(c) for c, x in zip(LOGIT_COLS, logits)],
                    *[p.alias(c) for c, p in zip(SCORE_COLS, softmax3(*logits))],
                    major_sentiment(*logits[::-1]).alias("model_label"))


def _mean(sums: Sequence[Column], n: Column, bias: Sequence[float]) -> Column:
    return F.struct(*[(F.lit(float(b)) + F.when(n > 0, s / n).otherwise(F.lit(0.0))).alias(c)
                      for c, s, b in zip(LOGIT_COLS, sums, bias)])


def word_counts(text: Column) -> Column:
    """``array<struct<word, n>>`` of a text's words; texts of ASCII only list each word once, the others each occurrence."""
    listed = F.transform(extract_words(text), lambda w: F.struct(w.alias("word"), F.lit(1).cast("long").alias("n")))
    return ascii_or(text, word_counts_by_batch(), listed)


def _weighted(df: DataFrame, weights: DataFrame, bias: Sequence[float], text_col: str) -> DataFrame:
    """Append ``_model`` from a table of weights.

    A table of proven small size is a hash table inside one fold over the words (no shuffle).  A larger one is joined once
    on the words of numbered rows, which are counted in their rows first.
    """
    own = weights.where("word IS NOT NULL").groupBy("word").agg(*[F.coalesce(F.max(c).cast("double"), F.lit(0.0)).alias(c) for c in CLASSES])
    words = extract_words(F.col(text_col))
    if is_small(own, INLINE_MAX_WORDS):
        find = hashed_lookup({r["word"]: [r[c] for c in CLASSES] for r in own.orderBy("word").collect()}, "array<double>")
        start = F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(c) for c in CLASSES])

        def step(acc: Column, w: Column) -> Column:
            return F.struct((acc["n"] + 1).alias("n"), *[(acc[c] + F.coalesce(F.get(w, k), F.lit(0.0))).alias(c) for k, c in enumerate(CLASSES)])

        # an empty table knows no word
        known = F.transform(words, lambda w: find(w).cast("array<double>"))
        return df.withColumn("_model", let(F.aggregate(known, start, step, lambda a: _mean([a[c] for c in CLASSES], a["n"], bias)), _scored))
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))  # the numbers must not change again
    counted = rows.select("_row", F.inline(word_counts(F.col(text_col)))).select("_row", "word", F.col("n").alias("_n"))
    sums = counted.join(own, "word", "left").groupBy("_row").agg(
        F.sum("_n").alias("_words"), *[F.sum(F.col("_n") * F.col(c)).alias(f"_{c}") for c in CLASSES])
    joined = rows.join(sums, "_row", "left")
    mean = _mean([F.coalesce(f"_{c}", F.lit(0.0)) for c in CLASSES], F.coalesce("_words", F.lit(0)), bias)
    model = F.when(F.col(text_col).isNotNull(), let(mean, _scored))
    return joined.withColumn("_model", model).drop("_row", "_words", *[f"_{c}" for c in CLASSES])


def naive_bayes_weights(df: DataFrame, label_col: str, labels: Sequence[str], text_col: str = "CleanText") -> DataFrame:
    """``word, neg, neu, pos``: for each word the logarithm of its share of the words of each class, with one occurrence added
    for every word.  ``labels`` are the values of ``label_col`` for the three classes; rows with others are left out."""
    own = df.where(F.col(label_col).isin(list(labels))).select(F.col(label_col).alias("_label"), F.inline(word_counts(F.col(text_col))))
    counts = own.groupBy("word").agg(*[F.sum(F.when(F.col("_label") == x, F.col("n")).otherwise(0)).alias(c) for x, c in zip(labels, CLASSES)])
    counts = materialize(counts)
    totals = counts.agg(F.count(F.lit(1)).alias("v"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES]).first()
    return counts.select("word", *[F.log((F.col(c) + 1.0) / F.lit(float(totals[c] + totals["v"]))).alias(c) for c in CLASSES])


def with_softmax(df: DataFrame, logits: Sequence[str] = LOGIT_COLS, out: Sequence[str] = SCORE_COLS,
                 label: str | None = "model_label") -> DataFrame:
    """Probabilities in full precision; the label is the arg-max of the logits (tie order pos, neu, neg)."""
    df = df.withColumns(dict(zip(out, softmax3(*map(F.col, logits)))))
    return df.withColumn(label, major_sentiment(*[logits[i] for i in (2, 1, 0)])) if label else df


def linear_scores(df: DataFrame, text_col: str = "CleanText", keep_logits: bool = False, weights: DataFrame | None = None,
                  bias: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Append ``model_neg, model_neu, model_pos`` and ``model_label`` from the native linear scorer.

    ``weights(word, neg, neu, pos)``: a class's logit is its bias plus the mean weight of the row's words; words that the
    table lacks, and NULL weights, weigh 0; of a repeated word the largest weights hold.  Without ``weights`` the fixture rule
    scores.  A row without a text has no score and no label, one without words the bias.
    """
    kept = [*(LOGIT_COLS if keep_logits else ()), *SCORE_COLS, "model_label"]
    out = df.withColumn("_model", linear_model(text_col)) if weights is None else _weighted(df, weights, bias, text_col)
    return out.select(*df.columns, *[F.col(f"_model.{c}").alias(c) for c in kept])


# ---------------------------------------------------------------- pandas path

_WORD_RE = regex.compile(WORD_PATTERN)


def linear_fixture_scorer() -> Callable[[pd.Series], np.ndarray]:
    """The fixture linear scorer as a vectorised pandas function (texts -> (n, 3) logits)."""
    mults = np.array(LINEAR_MULTIPLIERS, dtype=np.int64)

    def score(texts: pd.Series) -> np.ndarray:
        words = texts.map(_WORD_RE.findall).explode().dropna()
        if words.empty:
            return np.zeros((len(texts), 3))
        first = words.str[0].map(ord).to_numpy(np.int64)
        length = words.str.len().to_numpy(np.int64)
        w = (first[:, None] * mults[None, :] + length[:, None]) % LINEAR_MODULUS - LINEAR_OFFSET
        sums = pd.DataFrame(w, index=words.index).groupby(level=0).sum()
        counts = words.groupby(level=0).size()
        sums = sums.reindex(range(len(texts)), fill_value=0)
        counts = counts.reindex(range(len(texts)), fill_value=0).to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            logits = sums.to_numpy() / (LINEAR_SCALE * counts[:, None])
        return np.where(counts[:, None] > 0, logits, 0.0)

    return score


class ScorerKey(NamedTuple):
    """Names a model; two models, or two versions of one, must have different keys."""

    name: str
    version: str


_SCORERS: dict[ScorerKey, Callable] = {}


def _scorer_for(key: ScorerKey, factory: Callable[[], Callable]) -> Callable:
    """The worker's scorer of this key, built when first asked for; a worker keeps one model."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = factory()
    return _SCORERS[key]


# What a scorer raises for a row that it cannot handle; anything else is a fault and fails the job.
ROW_ERRORS = (RuntimeError, IndexError)


def score_with_pandas(df: DataFrame, key: ScorerKey, factory: Callable[[], Callable[[pd.Series], np.ndarray]],
                      text_col: str = "CleanText", passthrough: Sequence[str] = ()) -> DataFrame:
    """Batch inference through ``mapInPandas``.

    ``factory()`` builds a scorer ``texts -> ndarray (n, 3)`` of logits (neg, neu, pos); workers keep it under ``key``.
    Rows without a text are not sent to it.  If a batch raises one of ``ROW_ERRORS``, its rows are scored one by one; those
    that fail get NULL logits and the error in ``model_error``.
    """
    passthrough = list(passthrough)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*passthrough).schema.fields]
        + [f"{c} double" for c in LOGIT_COLS] + ["model_error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer_for(key, factory)
        for pdf in batches:
            texts = pdf[text_col].reset_index(drop=True)
            logits, errors = np.full((len(texts), 3), np.nan), np.full(len(texts), None, object)
            missing = texts.isna().to_numpy()
            errors[missing] = "null text"
            there = np.flatnonzero(~missing)
            try:
                if len(there):
                    logits[there] = scorer(texts.iloc[there].reset_index(drop=True))
            except ROW_ERRORS:
                for i in there:
                    try:
                        logits[i] = np.asarray(scorer(texts.iloc[[i]].reset_index(drop=True)), float)[0]
                    except ROW_ERRORS as e:
                        errors[i] = f"{type(e).__name__}: {e}"
            out = pdf[passthrough].reset_index(drop=True).copy()
            for j, c in enumerate(LOGIT_COLS):
                out[c] = pd.Series(logits[:, j]).where(pd.Series(errors).isna(), None)
            out["model_error"] = errors
            yield out

    return df.select(*passthrough, *([text_col] if text_col not in passthrough else [])).mapInPandas(run, schema)


LINEAR_KEY = ScorerKey("linear-fixture", "1")


def limited_fixture_scorer(max_words: int) -> Callable[[], Callable[[pd.Series], np.ndarray]]:
    """The fixture scorer with a context of ``max_words`` words, beyond which it raises as a transformer does."""
    def factory() -> Callable[[pd.Series], np.ndarray]:
        inner = linear_fixture_scorer()

        def score(texts: pd.Series) -> np.ndarray:
            if (texts.map(lambda t: len(_WORD_RE.findall(t))) > max_words).any():
                raise RuntimeError("text too long for the model")
            return inner(texts)

        return score

    return factory


def model_rejects(scored: DataFrame, keys: Sequence[str] = ("Episode", "SentenceIndex")) -> tuple[DataFrame, DataFrame]:
    """Split the rows of ``score_with_pandas`` into (scored, rejects(keys, reason)).

    Both read the same rows: pass a materialised table, or the model runs for each.
    """
    failed = F.col("model_error").isNotNull()
    return scored.where(~failed).drop("model_error"), scored.where(failed).select(*keys, F.col("model_error").alias("reason"))
