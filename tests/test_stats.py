from tonality.operators import charts as CH
from tonality.operators import stats as S
from tonality.sources.dimensions import characters_df

COLS = ("Episode string, SentenceIndex long, Character string, lex_neg double, lex_neu double, "
        "lex_pos double, model_neg double, model_neu double, model_pos double, "
        "lex_label string, model_label string")


def scored(spark):
    rows = [
        ("1", 0, "Mara Quill", 0.0, 0.2, 0.8, 0.1, 0.2, 0.7, "Positive", "Positive"),
        ("1", 1, "Mara Quill", 0.0, 0.4, 0.6, 0.1, 0.3, 0.6, "Positive", "Positive"),
        ("1", 2, "Secondary", 0.5, 0.5, 0.0, 0.6, 0.3, 0.1, "Neutral", "Negative"),
        ("1", 3, "Secondary", 0.9, 0.1, 0.0, 0.2, 0.7, 0.1, "Negative", "Neutral"),
        ("1", 4, "Secondary", 0.9, 0.1, 0.0, 0.2, 0.7, 0.1, "Negative", "Neutral"),
    ]
    return spark.createDataFrame(rows, COLS)


def test_character_statistics(spark):
    st = {r.Character: r for r in S.character_statistics(scored(spark), characters_df(spark)).collect()}
    assert len(st) == 6
    m = st["Mara Quill"]
    assert m.lex_count_pos == 2 and abs(m.lex_avg_pos - 0.7) < 1e-12 and abs(m.lex_median_pos - 0.7) < 1e-12
    assert abs(m.lex_std_pos - 0.1414213562) < 1e-9
    assert m.total_count == 2
    s = st["Secondary"]
    assert s.lex_count_neu == 1 and s.lex_std_neu is None and s.lex_median_neu == 0.5
    empty = st["Tobin Reyes"]
    assert empty.total_count == 0 and empty.lex_count_pos == 0 and empty.lex_avg_pos is None
    assert [r.Character for r in sorted(st.values(), key=lambda r: r.char_order)][-1] == "Secondary"


def test_invariant_counts_add_up(spark):
    for r in S.character_statistics(scored(spark), characters_df(spark)).collect():
        for s in ("lex", "model"):
            assert getattr(r, f"{s}_count_pos") + getattr(r, f"{s}_count_neu") \
                + getattr(r, f"{s}_count_neg") == r.total_count


def test_modal_tie_goes_to_first_seen(spark):
    rows = [("1", 5, "a", "Neutral"), ("1", 2, "a", "Negative"), ("1", 7, "a", "Negative"),
            ("1", 1, "a", "Neutral")]
    df = spark.createDataFrame(rows, "Episode string, SentenceIndex long, Character string, lex_label string")
    df = df.withColumn("model_label", df.lex_label)
    m = S.modal_sentiment(df).first()
    assert m.lex_mode == "Neutral" and m.model_mode == "Neutral"


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("1", 1, 0.1), ("1", 1, 0.2), ("1", 2, 0.3)],
                               "Episode string, SentenceIndex long, s double")
    assert [(r.SentenceIndex, r.n) for r in S.duplicate_keys(df).collect()] == [(1, 2)]


def test_describe_covers_all_numeric_columns(spark):
    rows = {r["column"]: r for r in S.describe_scores(scored(spark)).collect()}
    assert "SentenceIndex" in rows and len(rows) == 7
    assert (rows["SentenceIndex"]["q25"], rows["SentenceIndex"]["q50"], rows["SentenceIndex"]["mean"]) == (1.0, 2.0, 2.0)
    assert abs(rows["SentenceIndex"]["std"] - 1.5811388300841898) < 1e-12


def test_schema_report(spark):
    rep = S.schema_report(scored(spark)).collect()
    assert rep[0].column == "Episode" and rep[0].type == "string" and len(rep) == 11


def test_deviation_of_large_values_and_of_any_partitioning(spark):
    values = spark.createDataFrame([("1", 1e9), ("1", 1e9 + 1), ("1", 1e9 + 2), ("2", 5.0), (None, 1.0), (None, 4.0)], "Episode string, x double")
    got = {r["Episode"]: r for r in S.describe_scores(values).collect()}
    assert got["1"]["std"] == 1.0 and got["1"]["mean"] == 1e9 + 1 and got["1"]["q25"] == 1e9 + 0.5
    assert got["2"]["std"] is None and got["2"]["q75"] == 5.0 and (got[None]["count"], got[None]["q50"]) == (2, 2.5)
    rows = spark.range(3000).selectExpr("'1' AS Episode", "1e12 + pow(id % 97, 3) / 7 AS x")
    one, many = (S.describe_scores(rows.repartition(n)).first() for n in (1, 13))
    for name in ("count", "mean", "std", "min", "q25", "q50", "q75", "max"):
        assert abs(one[name] - many[name]) <= 1e-9 * abs(one[name]), name


def test_measures_other_than_medians_shuffle_states_only(spark):
    """Without medians there is one aggregate, whose state has a constant size, and no sorting of scores."""
    st = S.character_statistics(scored(spark), characters_df(spark), measures=("avg", "std", "count"))
    plan = st._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower() and "model_pos" in plan and "score#" not in plan


def test_medians_of_many_rows_and_null_speakers(spark):
    import random
    import statistics
    rng = random.Random(6)
    labels = (("Positive", "pos"), ("Neutral", "neu"), ("Negative", "neg"))
    rows = []
    for i in range(600):
        lex, model = [round(rng.random(), 2) for _ in range(3)], [rng.random() for _ in range(3)]
        rows.append((rng.choice(["1", "2"]), i, rng.choice(["Mara Quill", None, "Secondary"]), *lex, *model, rng.choice(labels)[0], rng.choice(labels)[0]))
    df = spark.createDataFrame(rows, COLS)
    st = {(r["Episode"], r["Character"]): r for r in S.character_statistics(df, characters_df(spark)).collect()}
    bars = {(r["Episode"], r["Character"], r["label"]): r["median"] for r in CH.chart_median_by_label(df).collect()}
    for episode in ("1", "2"):
        for who in ("Mara Quill", None, "Secondary"):
            own = [r for r in rows if (r[0], r[2]) == (episode, who)]
            for s, at, label in (("lex", 3, 9), ("model", 6, 10)):
                for k, (lab, short) in enumerate((labels[2], labels[1], labels[0])):
                    x = [r[at + k] for r in own if r[label] == lab]
                    got = st[episode, who]
                    assert got[f"{s}_count_{short}"] == len(x)
                    assert abs(got[f"{s}_median_{short}"] - statistics.median(x)) < 1e-12
                    assert abs(got[f"{s}_std_{short}"] - statistics.stdev(x)) < 1e-12
                    if s == "model":
                        assert abs(bars[episode, who, lab] - statistics.median(x)) < 1e-12
