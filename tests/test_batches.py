"""The scorers' form by Arrow batches gives the rows of their form by folds, and ASCII texts take it."""

import random

from pyspark.sql import functions as F

from tonality.functions import text as T
from tonality.operators import batches as B
from tonality.operators import lexicon as L
from tonality.operators import model as M
from tonality.sources.wordlists import booster_df, idiom_df, lexicon_from_rows, negator_df

ODD = ["", " ", "!!!", "a", "ab", "--ab--  ...c.. 'n't' don't", "GOOD bad Very GOOD kind of good", "at least good least good very least bad",
       "never so good, never this very good but bad BUT good?", "not good\tVERY bad!!!!! ??", "the the the good of the good and the of good",
       "is the good and and good is the x y great", "x" * 70 + "\x0b\x00ab", "???? ok? word... ...word", "café good", None,
       "really very so good NOT REALLY GOOD", "never so this good and the the to happy de la bad"]
WORDS = ("good bad happy GREAT never so this not NOT of the kind least at very Really but BUT don't n't 'll x ab word. (fine) !! ? - and la de "
         "de-la naïve sad, no").split()


def frame(spark):
    rng = random.Random(7)
    texts = ODD + [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(40))) for _ in range(150)]
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2).cache()


def rules(spark, idioms=False):
    phrases = [("of the", 3.0), ("the the the", 1.5), ("de la", 2.5), ("so good", -1.5)] if idioms else []
    damps = [("is the", -0.293), ("and and", 0.293)] if idioms else []
    return L.Rules(lexicon_from_rows(spark), booster_df(spark, [("very", 0.293), ("really", 0.293), ("of", -0.293), *damps]),
                   negator_df(spark), L.generated_valence, ("but", "and"), idiom_df(spark, phrases) if idioms else None)


def plan(df):
    return df._jdf.queryExecution().toString()


def both(monkeypatch, make):
    batched = make()
    assert "ArrowEvalPython" in plan(batched)
    monkeypatch.setattr(L, "_known", lambda *a: None)
    monkeypatch.setattr(M, "ascii_or", lambda text, batch, other: other)
    folded = make()
    assert "ArrowEvalPython" not in plan(folded)
    key = lambda r: repr(r)
    assert sorted(batched.collect(), key=key) == sorted(folded.collect(), key=key)
    monkeypatch.undo()


def test_scores_by_batches_equal_the_folds(spark, monkeypatch):
    df = frame(spark)
    for idioms in (False, True):
        r = rules(spark, idioms)
        both(monkeypatch, lambda: L.lexicon_scores(df, r, "t"))


def test_items_by_batches_equal_the_folds(spark, monkeypatch):
    df = frame(spark)
    for idioms, steps in ((False, ("boost",)), (False, ("negate",)), (False, ("modify", "contrast")), (True, ("modify",)), (False, ())):
        r = rules(spark, idioms)
        both(monkeypatch, lambda: L.lexicon_items(df, r, "t", ["k"], steps))


def test_linear_scores_by_batches_equal_the_fold(spark, monkeypatch):
    df = frame(spark)
    both(monkeypatch, lambda: M.linear_scores(df, "t", keep_logits=True))


def test_blocks_keep_every_text_whole(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(B, "BLOCK_BYTES", 4)
    texts = ["ab", "", "cdefgh", None, "i", "jk", ""]
    found = [bytes(d[a:b]).decode() for d, ends in B.blocks(pa.array(["zz", *texts])[1:]) for a, b in zip(ends, ends[1:])]
    assert found == [t or "" for t in texts]


def test_a_rule_without_a_batch_form_keeps_the_folds(spark):
    r = rules(spark)
    r = L.Rules(r.lexicon, r.boosters, r.negators, lambda w: F.when(w == "ab", 2.0), r.contrast)
    out = L.lexicon_scores(frame(spark), r, "t")
    assert "ArrowEvalPython" not in plan(out)
    assert out.where("t = 'ab'").first()["lex_pos"] == 1.0


def test_tokens_of_ascii_texts(spark):
    df = frame(spark)
    own = T.tokenize(F.col("t"))
    # with a sign outside ASCII at the end the general pattern cuts
    general = F.filter(T.tokenize(F.concat("t", F.lit(" €"))), lambda w: w != "€")
    assert df.where(~own.eqNullSafe(general)).count() == 0


def test_cheap_looks_of_the_cleaner_change_nothing(spark):
    texts = ["naïve café", "straße Œuvre", "emoji 😀 ❤️ é", "“x” … «y»", "cafÃ© donâ€™t", "привет é", "漢字 é", "Ã\xa0 x", "É ", "æ", "ÀÿÐ", "x€y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = T.normalize_space(T._fold(T.strip_emoji(T.lower_text(T.repair_unicode(T.strip_dashes("t")))), True))
    assert df.where(~T.clean_text("t").eqNullSafe(whole)).select("t").collect() == []


def test_word_counts_are_those_of_the_words(spark):
    df = frame(spark)
    ways = [df.select("k", F.inline(M.word_counts(F.col("t")))), df.select("k", F.explode(T.extract_words("t")).alias("word")).withColumn("n", F.lit(1))]
    own, plain = (sorted(map(tuple, x.groupBy("k", "word").agg(F.sum("n")).collect())) for x in ways)
    assert own == plain
    rows = ways[0].join(df, "k").where(F.octet_length("t") == F.char_length("t"))
    assert rows.groupBy("k", "word").count().where("count > 1").count() == 0
