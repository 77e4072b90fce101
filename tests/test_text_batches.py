"""Cleaning and kept tokens by Arrow batches give the rows of the expressions, and ordinary Western text takes them."""

import random

import pytest
from pyspark.sql import functions as F

from tonality.functions import text as T
from tonality.operators import batches as B
from tonality.operators import text_batches as X
from tonality.operators.prepare import prepare_utterances
from tonality.operators.stopwords import drop_stopwords_expr
from tonality.sources.dimensions import characters_df

STOP = ["the", "n't", "'s", ".", "don"]
ODD = ["", " ", "\n", None, "a", "-", "--", "The end.", "well-known – “quoted” …", "  two  blanks \t and\ttabs\x0b\x0c. \r\n\r\n line \n \n two\r", "a\rb", "\x00\x7f a",
       "Don't stop; it's the dogs' 'twas isn't", "n't", "xn't", "'n't", "'don't'n't n't", "can'ta n'ta xn'tn'ta", "'ab'cd 'Ab '1 'a1 'aB_'c", "O'Neill's N'T rock'n'roll", "'", "''a''",
       "straße Œuvre æ ÆØ þorn ß", "naïve Café ÀÉÎÕÜ × ÷ €5 ½ x² ª", "é", "é", " x y ", "İstanbul ĳ Ǆ ǅ", "x‍y⃣ ­", "cafÃ© donâ€™t Ã", "Ã", "É x", "Ω привет é",
       "漢字 é", "안녕 é", "emoji 😀 ❤️ é", "™ ℃ K", "the the", "1.5 a_b é1", "…", "„the“"]
SIGNS = ["n't", "'", "n", "t", "a", "the", " ", " ", "\n", "\t", ".", "-", "A", "1", "_", "é", "ß", "“", "…", "Ã", "©", "漢", " ", "don't", "'s"]


def texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(SIGNS[:16] if k % 2 else SIGNS) for _ in range(rng.randrange(14))) for k in range(3000)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(list(enumerate(texts())), "k int, t string").repartition(3).cache()


def joined(text):
    return F.array_join(drop_stopwords_expr(T.tokenize(T.clean_text(text)), STOP), " ")


def test_batches_equal_the_expressions(df, monkeypatch):
    for name, batch, plain in (("clean", X.clean_by_batch(), T.clean_text), ("kept", X.kept_by_batch(STOP), joined), ("none", X.kept_by_batch([]), lambda t: F.array_join(T.tokenize(T.clean_text(t)), " "))):
        own = df.select("t", batch(F.col("t")).alias("own"), plain(F.col("t")).alias("plain")).collect()
        assert [r for r in own if r["own"] is not None and r["own"] != r["plain"]] == [], name
        # what the batches leave to the expressions: NULL, other scripts, broken Unicode, unspelled letters, n't inside a word
        left = {r["t"] for r in own if r["own"] is None and r["t"] is not None}
        assert not left & {t for t in ODD if t and t.isascii() and "n'ta" not in t}
        assert {"straße Œuvre æ ÆØ þorn ß", "well-known – “quoted” …", "„the“", "é"} & left == set()
        assert {"漢字 é", "cafÃ© donâ€™t Ã", "Ω привет é"} <= left


def test_every_sign_of_the_table(spark):
    signs = [chr(c) for c in range(1, X.SIGNS_END + 0x100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"a{c}B", ) for c in signs], "t string")
    rows = df.select("t", X.clean_by_batch()(F.col("t")).alias("own"), T.clean_text("t").alias("plain")).collect()
    assert [r for r in rows if r["own"] is not None and r["own"] != r["plain"]] == []
    # nothing that an expression makes ASCII by single signs is left to it, but letters of other scripts
    assert len([r for r in rows if r["own"] is not None]) > 1000


def test_blocks_and_slices(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(B, "BLOCK_BYTES", 8)
    given = pa.array(["zz", *texts()])[1:]
    alone = [X._by_block(pa.array([t], pa.string()), X._cleaned)[0].as_py() for t in texts()]
    assert X._by_block(given, X._cleaned).to_pylist() == alone
    assert X._by_block(given[:0], X._cleaned).to_pylist() == []


def test_bytes_that_are_no_text_are_left(spark):
    import numpy as np
    data = np.frombuffer(b"ab\xff\xc3cd", np.uint8)
    assert X._cleaned(data, np.array([0, 2, 4, 6]))[2].tolist() == [True, False, True]


def test_prepared_rows_equal_those_of_kept_tokens(spark, df):
    utt = df.select(F.lit("1").alias("Episode"), F.col("k").cast("long").alias("SentenceIndex"), F.lit(1.0).alias("Character"), F.col("t").alias("Text"))
    for stop in (STOP, spark.createDataFrame([(w,) for w in STOP], "w string"), iter(STOP)):
        own = prepare_utterances(utt, characters_df(spark), stop)
        assert "ArrowEvalPython" in own._jdf.queryExecution().toString()
        kept = prepare_utterances(utt, characters_df(spark), STOP, keep_tokens=True)
        assert own.columns == [c for c in kept.columns if c != "Tokens"]
        other = kept.select("SentenceIndex", F.col("CleanText").alias("c"))
        assert own.join(other, "SentenceIndex").where(~F.col("CleanText").eqNullSafe(F.col("c"))).count() == 0


def test_prepared_text_is_a_column_of_its_own(spark, df):
    """A scorer, a filter on its label, the rule scorer's items and statistics read one prepared text, each as its own step."""
    from tonality.operators.stats import character_counts
    from tonality.plans.context import Inputs
    from tonality.plans.pipeline import scored_table
    inp = Inputs(spark, "-")
    utt = df.select(F.lit("1").alias("Episode"), F.col("k").cast("long").alias("SentenceIndex"), F.lit(1.0).alias("Character"), F.col("t").alias("Text"))
    scored = scored_table(prepare_utterances(utt, inp.characters(), STOP), inp.scoring())
    whole = {r["SentenceIndex"]: r["model_label"] for r in scored.collect()}
    negative = scored.where("model_label = 'Negative'")
    assert {r["SentenceIndex"] for r in negative.collect()} == {k for k, x in whole.items() if x == "Negative"} != set()
    assert len(negative._jdf.queryExecution().optimizedPlan().toString()) < 2_000_000
    assert character_counts(scored, inp.characters()).where("Character = 'Mara Quill'").first()["total_count"] == len(whole)
