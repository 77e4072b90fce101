import numpy as np
import pytest
from pyspark.sql import functions as F

from tonality.operators import model as M

TEXTS = ["good day", "", "abc def ghi", None, "x " * 50]


def frame(spark):
    rows = [("1", i, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "Episode string, SentenceIndex long, CleanText string")


def test_native_equals_pandas(spark):
    df = frame(spark)
    native = {r.SentenceIndex: (r.logit_neg, r.logit_neu, r.logit_pos)
              for r in M.linear_scores(df, keep_logits=True).collect()}
    pandas_out = M.score_with_pandas(df, M.LINEAR_KEY, M.linear_fixture_scorer, passthrough=["SentenceIndex"])
    for r in pandas_out.collect():
        if r.SentenceIndex == 3:
            assert r.model_error == "null text" and r.logit_neg is None and native[3] == (None, None, None)
        else:
            assert np.allclose(native[r.SentenceIndex], (r.logit_neg, r.logit_neu, r.logit_pos)) and r.model_error is None


def test_softmax_sums_to_one(spark):
    out = M.linear_scores(frame(spark)).where("CleanText IS NOT NULL").select(
        (F.col("model_neg") + F.col("model_neu") + F.col("model_pos")).alias("s")).collect()
    assert len(out) == 4 and all(abs(r.s - 1) < 1e-12 for r in out)


def test_each_key_has_its_own_model(spark):
    def factory(k):
        return lambda: lambda texts: np.full((len(texts), 3), float(k))

    for k in (1, 2, 3, 1):
        out = M.score_with_pandas(frame(spark).repartition(4), M.ScorerKey("closure", str(k)), factory(k), passthrough=["SentenceIndex"])
        assert {r.logit_pos for r in out.where("model_error IS NULL").collect()} == {float(k)}


def test_failing_rows_are_isolated_and_split(spark):
    out = M.score_with_pandas(frame(spark), M.ScorerKey("limited", "20"), M.limited_fixture_scorer(20), passthrough=["SentenceIndex"])
    ok, rejects = M.model_rejects(out, keys=["SentenceIndex"])
    assert {r.SentenceIndex: r.reason for r in rejects.collect()} == {
        3: "null text", 4: "RuntimeError: text too long for the model"}
    assert sorted(r.SentenceIndex for r in ok.collect()) == [0, 1, 2]


def test_a_fault_of_the_scorer_fails_the_job(spark):
    def factory():
        def score(texts):
            raise KeyError("bug")
        return score

    with pytest.raises(Exception, match="bug"):
        M.score_with_pandas(frame(spark), M.ScorerKey("faulty", "1"), factory, passthrough=["SentenceIndex"]).collect()


WEIGHTS = [("good", 0.5, -1.25, 2.0), ("day", None, 0.25, 0.0), ("day", -1.0, 0.125, 0.0), ("x", 1.0, 1.0, 1.0), (None, 9.0, 9.0, 9.0)]


def weights(spark, rows=WEIGHTS):
    return spark.createDataFrame(rows, "word string, neg double, neu double, pos double")


def test_weights_of_a_table(spark):
    out = {r.SentenceIndex: r for r in M.linear_scores(frame(spark), keep_logits=True, weights=weights(spark), bias=(0.0, 0.5, 0.0)).collect()}
    assert (out[0].logit_neg, out[0].logit_neu, out[0].logit_pos, out[0].model_label) == (-0.25, 0.0, 1.0, "Positive")
    assert (out[1].logit_neg, out[1].logit_neu, out[1].model_label) == (0.0, 0.5, "Neutral") and out[2].logit_neu == 0.5
    assert out[3].logit_pos is None and out[3].model_label is None and out[4].logit_pos == 1.0
    empty = M.linear_scores(frame(spark), keep_logits=True, weights=weights(spark, [])).collect()
    assert len(empty) == 5 and {r.logit_pos for r in empty} == {0.0, None}


def test_a_large_table_gives_the_results_of_a_small_one(spark, monkeypatch):
    rows = [("1", i % 3, t) for i, t in enumerate([*TEXTS, *TEXTS, "good good x day unknown", "  "])]  # repeated keys stay apart
    df = spark.createDataFrame(rows, "Episode string, SentenceIndex long, CleanText string")
    small = sorted(map(repr, M.linear_scores(df, keep_logits=True, weights=weights(spark)).collect()))
    monkeypatch.setattr(M, "INLINE_MAX_WORDS", 1)
    joined = M.linear_scores(df, keep_logits=True, weights=weights(spark))
    assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, joined.collect())) == small and len(small) == 12


def test_naive_bayes_weights(spark):
    rows = [("a", "one two two"), ("b", "two three"), ("c", None), ("d", "four"), ("a", "")]
    own = {r.word: r for r in M.naive_bayes_weights(spark.createDataFrame(rows, "k string, t string"), "k", ("a", "b", "c"), "t").collect()}
    assert set(own) == {"one", "two", "three"}
    assert np.allclose([own["two"].neg, own["two"].neu, own["two"].pos], np.log([3 / 6, 2 / 5, 1 / 3]))


def test_packed_sums_end_where_the_long_is_full(spark):
    """Texts on both sides of the bound have the sums of their words."""
    texts = ["zoo " * n + "ape" for n in (0, 3, M.PACKED_WORDS - 1, M.PACKED_WORDS)] + ["", None]
    rows = M.linear_scores(spark.createDataFrame([(t,) for t in texts], "CleanText string"), keep_logits=True).collect()
    for t, r in zip(texts, rows):
        words = (t or "").split()
        for k, c in zip(M.LINEAR_MULTIPLIERS, M.LOGIT_COLS):
            total = sum((ord(w[0]) * k + len(w)) % 11 - 5 for w in words)
            assert r[c] == (None if t is None else total / (10.0 * len(words)) if words else 0.0)
