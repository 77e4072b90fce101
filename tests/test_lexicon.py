import math

from tonality.operators import lexicon as L
from tonality.sources.wordlists import booster_df, lexicon_from_rows, negator_df

LEX = [("good", 1.8), ("bad", -2.5), ("least", 0.5)]


def rules(spark, rule=None, contrast=("but",)):
    return L.Rules(lexicon_from_rows(spark, LEX), booster_df(spark), negator_df(spark), rule, contrast)


def score(spark, text, rule=None):
    df = spark.createDataFrame([("1", 0, text)], "Episode string, SentenceIndex long, CleanText string")
    out = L.lexicon_scores(df, rules(spark, rule)).first()
    return out.lex_neg, out.lex_neu, out.lex_pos, out.lex_compound


def comp(s):
    return round(s / math.sqrt(s * s + 15), 4)


def test_single_positive_word(spark):
    assert score(spark, "good") == (0.0, 0.0, 1.0, comp(1.8))


def test_neutral_words_count(spark):
    # pos_sum = 2.8, neu = 2 -> 2.8 / 4.8
    neg, neu, pos, c = score(spark, "good day there")
    assert (neg, neu, pos) == (0.0, round(2 / 4.8, 3), round(2.8 / 4.8, 3))
    assert c == comp(1.8)


def test_negation(spark):
    v = 1.8 * -0.74
    assert score(spark, "not good") == (round(abs(v - 1) / (abs(v - 1) + 1), 3),
                                        round(1 / (abs(v - 1) + 1), 3), 0.0, comp(v))


def test_contraction_negates(spark):
    assert score(spark, "n't good")[3] == comp(1.8 * -0.74)


def test_booster_and_damping(spark):
    assert score(spark, "very good")[3] == comp(1.8 + 0.293)
    assert score(spark, "very day good")[3] == comp(1.8 + 0.293 * 0.95)
    assert score(spark, "barely good")[3] == comp(1.8 - 0.293)
    assert score(spark, "very bad")[3] == comp(-2.5 - 0.293)


def test_never_so(spark):
    assert score(spark, "never so good")[3] == comp((1.8 + 0.293) * 1.5)


def test_never_at_distance_three_looks_at_both_words_between(spark):
    assert score(spark, "never day so good")[3] == comp((1.8 + 0.293) * 1.25)
    assert score(spark, "never this day good")[3] == comp(1.8 * 1.25)
    assert score(spark, "never day day good")[3] == comp(1.8 * -0.74)


def test_repeated_keys_stay_apart_and_ratios_stay_below_one(spark):
    rows = [("1", 0, "good"), ("1", 0, "good bad good"), ("1", 0, "good")]
    df = spark.createDataFrame(rows, "Episode string, SentenceIndex long, CleanText string")
    out = L.lexicon_scores(df, rules(spark)).collect()
    assert len(out) == 3 and all(0 <= x <= 1 for r in out for x in (r.lex_neg, r.lex_neu, r.lex_pos))
    assert sorted(r.lex_pos for r in out)[1:] == [1.0, 1.0]


def test_large_lexicon_path_equals_inline(spark, monkeypatch):
    texts = ["good", "not good but very bad !!", "GOOD day least bad", "", None, "never so good", "good"]
    df = spark.createDataFrame([("1", i % 3, t) for i, t in enumerate(texts)], "Episode string, SentenceIndex long, CleanText string")
    r = rules(spark)
    want = sorted(map(repr, L.lexicon_scores(df, r).collect()))
    items = sorted(map(repr, L.lexicon_items(df, r).collect()))
    small = L._small_rows
    monkeypatch.setattr(L, "_small_rows", lambda df, value: None if value == "valence" else small(df, value))
    assert sorted(map(repr, L.lexicon_scores(df, r).collect())) == want
    assert sorted(map(repr, L.lexicon_items(df, r).collect())) == items


def test_default_has_no_made_up_valences(spark):
    assert score(spark, "quartz table") == (0.0, 1.0, 0.0, 0.0)


def test_model_only_plans_do_not_score_the_lexicon(spark):
    from conftest import SF001
    from tonality.plans.queries import QUERIES
    plan = QUERIES["chart_share"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "lex_neg" not in plan and "free1" not in plan


def test_but_contrast(spark):
    assert score(spark, "good but bad")[3] == comp(1.8 * 0.5 - 2.5 * 1.5)


def test_least_is_a_modifier_only_outside_lexicon(spark):
    # "least" is a lexicon word here, so it does not negate
    assert score(spark, "least good")[3] == comp(0.5 + 1.8)


def test_punctuation_emphasis(spark):
    s = 1.8 + 3 * 0.292
    neg, neu, pos, c = score(spark, "good !!!")
    assert c == comp(s) and pos == 1.0


def test_question_marks(spark):
    assert score(spark, "good ??")[3] == comp(1.8 + 2 * 0.18)
    assert score(spark, "good ????")[3] == comp(1.8 + 0.96)


def test_caps_emphasis(spark):
    assert score(spark, "GOOD day")[3] == comp(1.8 + 0.733)
    assert score(spark, "GOOD DAY")[3] == comp(1.8)  # no differential


def test_empty_text_scores_zero(spark):
    assert score(spark, "") == (0.0, 0.0, 0.0, 0.0)
    assert score(spark, "a ! ,") == (0.0, 0.0, 0.0, 0.0)


def test_rule_lexicon(spark):
    # "xyz": (ascii('x') + 3) % 9 - 4 = (120 + 3) % 9 - 4 = 6 - 4 = 2 -> 1.0
    assert score(spark, "xyz", rule=L.generated_valence)[3] == comp(1.0)


def test_empty_label_faithful(spark):
    from tonality.functions.labels import major_sentiment
    df = spark.createDataFrame([(0.0, 0.0, 0.0)], "p double, u double, n double")
    assert df.select(major_sentiment("p", "u", "n").alias("l")).first().l == "Positive"


def test_modifiers_beyond_the_inline_bound_are_joined(spark):
    texts = ["good", "not good but very bad !!", "VERY good day least bad", "", None, "never so good", "kind of good", "so very not good",
             "at least good", "n't good", "word7 good", "good"]
    df = spark.createDataFrame([("1", i % 3, t) for i, t in enumerate(texts)], "Episode string, SentenceIndex long, CleanText string")
    few = L.Rules(lexicon_from_rows(spark, LEX), booster_df(spark), negator_df(spark), None, ("but",))
    more = spark.range(L.INLINE_MAX_WORDS + 1).selectExpr("concat('other', id) AS token", "0.5D AS delta")
    many = L.Rules(few.lexicon, few.boosters.unionByName(more), few.negators.unionByName(more.select("token")), None, ("but",))
    assert sorted(map(repr, L.lexicon_scores(df, many).collect())) == sorted(map(repr, L.lexicon_scores(df, few).collect()))
    for steps in (("boost",), ("negate",), ("modify", "contrast")):
        assert sorted(map(repr, L.lexicon_items(df, many, steps=steps).collect())) == sorted(map(repr, L.lexicon_items(df, few, steps=steps).collect()))


def test_texts_with_and_without_modifiers_against_a_plain_version(spark):
    """The rules in plain Python, on texts of random items."""
    import random
    rng = random.Random(8)
    lex, boost, nots = dict(LEX), {"very": 0.293, "barely": -0.293}, {"not", "never"}
    words = ["good", "bad", "least", "very", "barely", "not", "never", "so", "this", "day", "at", "n't", "kind", "of"]

    def plain(items):
        total = []
        for i, t in enumerate(items):
            if t not in lex:
                continue
            v = lex[t]
            for d in (1, 2, 3):
                if i < d or items[i - d] in lex:
                    continue
                p, between = items[i - d], items[i - d + 1:i]
                if p in boost:
                    v += (boost[p] if v >= 0 else -boost[p]) * (1, 0.95, 0.9)[d - 1]
                if d > 1 and p == "never" and {"so", "this"} & set(between):
                    v *= (1.5, 1.25)[d - 2]
                elif p in nots or "n't" in p:
                    v *= -0.74
            total.append((i, round(v, 9)))
        return total

    texts = [" ".join(rng.choice(words if i % 2 else ["good", "bad", "day", "so"]) for _ in range(rng.randrange(12))) for i in range(200)]
    df = spark.createDataFrame([("1", i, t) for i, t in enumerate(texts)], "Episode string, SentenceIndex long, CleanText string")
    own = L.Rules(lexicon_from_rows(spark, LEX), booster_df(spark, list(boost.items())), negator_df(spark, sorted(nots)))
    got = {}
    for r in L.lexicon_items(df, own, steps=("modify",)).collect():
        got.setdefault(r["SentenceIndex"], []).append((r["pos"], round(r["v"], 9)))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain(t.split()), t


def test_lookup_is_a_hash_table(spark):
    from tonality.functions.lookup import hashed_lookup
    rows = {f"wörd{i}": i / 8 for i in range(3000)} | {'quote"\\': 1.5}
    find = hashed_lookup(rows)
    df = spark.createDataFrame([(w,) for w in [*rows, "none", "", None]], "w string")
    got = {r["w"]: r["v"] for r in df.select("w", find(df["w"]).alias("v")).collect()}
    assert got == {**rows, "none": None, "": None, None: None}
    plan = df.select(find(df["w"]).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan  # folded once, not parsed for each row


IDIOMS = [("good day", 3.0), ("kind of day", -1.5), ("so so", -2.0), ("day at day", 2.0)]


def idiom_texts(n, seed):
    import random
    rng = random.Random(seed)
    words = ["good", "bad", "day", "at", "so", "kind", "of", "very", "not", "sort"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(10))) for _ in range(n)]


def with_idioms(spark, idioms=None):
    from tonality.sources.wordlists import idiom_df
    boosters = booster_df(spark, [("very", 0.293), ("sort of", -0.293)])
    return L.Rules(lexicon_from_rows(spark, LEX), boosters, negator_df(spark, ["not"]), None, ("but",), idioms or idiom_df(spark, IDIOMS))


def test_idioms_against_a_plain_version(spark):
    lex, idioms = dict(LEX), dict(IDIOMS)

    def plain(items):
        out = []
        for i, t in enumerate(items):
            if t not in lex or (t == "kind" and items[i + 1:i + 2] == ["of"]):
                continue
            v = lex[t]
            for d in (1, 2, 3):
                if i < d or items[i - d] in lex:
                    continue
                if items[i - d] == "very":
                    v += (0.293 if v >= 0 else -0.293) * (1, 0.95, 0.9)[d - 1]
                if items[i - d] == "not":
                    v *= -0.74
                if d == 3:
                    for a, b in ((i - 1, i), (i - 2, i), (i - 2, i - 1), (i - 3, i - 1), (i - 3, i - 2)):
                        if " ".join(items[a:b + 1]) in idioms:
                            v = idioms[" ".join(items[a:b + 1])]
                            break
                    for n in (2, 3):
                        v = idioms.get(" ".join(items[i:i + n]), v)
                    if "sort of" in (" ".join(items[i - 3:i - 1]), " ".join(items[i - 2:i])):
                        v -= 0.293
            out.append((i, round(v, 9)))
        return out

    texts = idiom_texts(400, 3)
    df = spark.createDataFrame([("1", i, t) for i, t in enumerate(texts)], "Episode string, SentenceIndex long, CleanText string")
    got = {}
    for r in L.lexicon_items(df, with_idioms(spark), steps=("modify",)).collect():
        got.setdefault(r["SentenceIndex"], []).append((r["pos"], round(r["v"], 9)))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain(t.split()), t
    without = L.Rules(lexicon_from_rows(spark, LEX), booster_df(spark, [("very", 0.293)]), negator_df(spark, ["not"]))
    assert L.lexicon_scores(df, with_idioms(spark)).exceptAll(L.lexicon_scores(df, without)).count() > 0


def test_idioms_beyond_the_inline_bound_are_joined(spark):
    from tonality.sources.wordlists import idiom_df
    texts = [*idiom_texts(60, 4), "", None, "day day day good", "DAY so so GOOD day"]
    df = spark.createDataFrame([("1", i % 3, t) for i, t in enumerate(texts)], "Episode string, SentenceIndex long, CleanText string")
    more = spark.range(L.INLINE_MAX_WORDS + 1).selectExpr("concat('other ', id) AS phrase", "0.5D AS valence")
    few, many = with_idioms(spark), with_idioms(spark, idiom_df(spark, IDIOMS).unionByName(more))
    for fn in (L.lexicon_scores, L.lexicon_items):
        assert sorted(map(repr, fn(df, many).collect())) == sorted(map(repr, fn(df, few).collect()))


def test_idiom_table_with_nulls_repeats_and_no_rows(spark):
    from tonality.sources.wordlists import idiom_df
    rows = [("Good  DAY ", 3.0), ("good day", 1.0), (None, 2.0), ("so so", None), ("a phrase of many words", 4.0)]
    df = spark.createDataFrame([("1", 0, "day at day good day")], "Episode string, SentenceIndex long, CleanText string")
    assert L.lexicon_scores(df, with_idioms(spark, idiom_df(spark, rows))).first().lex_compound == comp(3.0)
    assert L.lexicon_scores(df, with_idioms(spark, idiom_df(spark, []))).first().lex_compound == comp(1.8)


def test_plain_texts_skip_tags_and_score_alike(spark, monkeypatch):
    """With and without the look for plain texts: equal items and scores; a plain text's tags are empty."""
    import itertools
    from pyspark.sql import functions as F
    parts = ["tree", "very", "not", "good", "but", "kind", "of", "least", "never", "don't", "Tree!", "TREE"]
    df = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(itertools.product(parts, repeat=3))] + [(-1, None)], "k int, t string")
    rules = L.Rules(L_lexicon(spark), L_boosters(spark), L_negators(spark), L.generated_valence)

    def results():
        return (L.lexicon_scores(df, rules, "t").orderBy("k").collect(), L.lexicon_items(df, rules, "t", ["k"]).orderBy("k", "pos").collect())

    quick = results()
    frame, tags, words = L._tags(df, rules, "t")
    seen = frame.select("k", L._sentence(F.col("t"), rules, tags, words, None).alias("s")).select("s.plain", F.size("s.boost").alias("n"))
    assert {(r.plain, r.n == 0) for r in seen.where("n = 0 OR plain").collect()} <= {(True, True), (False, True)} and seen.where("plain").count()
    monkeypatch.setattr(L, "PLAIN_MAX_WORDS", 0)
    assert L._tags(df, rules, "t")[2] == [] and results() == quick


def L_lexicon(spark):
    return spark.createDataFrame([("good", 1.9), ("kind", 2.4)], "token string, valence double")


def L_boosters(spark):
    return spark.createDataFrame([("very", 0.293)], "token string, delta double")


def L_negators(spark):
    return spark.createDataFrame([("not",), ("never",)], "token string")
