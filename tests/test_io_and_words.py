import pytest
from pyspark.sql import functions as F

from tonality.operators import stopwords as SW
from tonality.operators import words as W
from tonality.resources import default_stopword_list
from tonality.session import scratch_path
from tonality.sources.sinks import write_csv
from tonality.sources.utterances import read_utterances
from tonality.sources.wordlists import read_lexicon, read_wordlist


def test_csv_round_trip_edge_rows(spark):
    rows = [("01", 0, 1.0, 'Hi, well-known "doctor"'), ("01", 1, None, "No."),
            ("2", 2, 5.0, "line\nbreak, comma"), ("2", 3, 2.0, ""), ("2", 4, 7.0, None),
            ("3", 5, 3.0, "  padded  "), ("3", 6, 1.7, "back\\slash")]
    df = spark.createDataFrame(rows, "Episode string, SentenceIndex long, Character double, Text string")
    path = scratch_path(spark, "test-csv")
    write_csv(df, path)
    back = read_utterances(spark, path)  # "01" stays "01"
    assert sorted(map(tuple, back.select(*df.columns).collect()), key=lambda r: r[1]) == rows


def test_columns_by_header_and_episode_by_file_name(spark, tmp_path):
    folder = tmp_path / "E2024"
    folder.mkdir()
    for n in (1, 2):
        (folder / f"HPE{n}.csv").write_text(f'Character,note,SentenceIndex,Text\n{n},x,7,"a, b"\n,y,8,c\n')
    rows = read_utterances(spark, str(folder)).orderBy("Episode", "SentenceIndex").collect()
    assert [(r.Episode, r.SentenceIndex, r.Character, r.Text, r.note) for r in rows] == [
        ("1", 7, 1.0, "a, b", "x"), ("1", 8, None, "c", "y"), ("2", 7, 2.0, "a, b", "x"), ("2", 8, None, "c", "y")]


def test_bad_headers_and_names_fail(spark, tmp_path):
    (tmp_path / "HPE1.csv").write_text("Character,Text\n1,a\n")
    with pytest.raises(ValueError, match="SentenceIndex"):
        read_utterances(spark, str(tmp_path))
    named = tmp_path / "other"
    named.mkdir()
    (named / "NODE12.csv").write_text("SentenceIndex,Character,Text\n1,1,a\n")
    with pytest.raises(Exception, match="no episode"):
        read_utterances(spark, str(named)).collect()
    swapped = tmp_path / "swapped"
    swapped.mkdir()
    (swapped / "HPE1.csv").write_text("SentenceIndex,Character,Text\n1,1,a\n")
    (swapped / "HPE2.csv").write_text("Character,SentenceIndex,Text\n1,1,a\n")
    with pytest.raises(Exception):
        read_utterances(spark, str(swapped)).collect()


def test_wordlist_distinct_and_stripped(spark, tmp_path):
    (tmp_path / "w.txt").write_text("a\n b \n\na\nc\n")
    assert sorted(r.word for r in read_wordlist(spark, str(tmp_path / "w.txt")).collect()) == ["a", "b", "c"]


def test_default_stopwords_match_spark(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert list(default_stopword_list()) == StopWordsRemover.loadDefaultStopWords("english")


def test_read_lexicon(spark, tmp_path):
    p = tmp_path / "lex.tsv"
    p.write_text("# comment\ngood\t1.9\t0.5\t[1,2]\nbad\t-2.5\t0.4\t[]\n")
    assert sorted(map(tuple, read_lexicon(spark, str(p)).collect())) == [("bad", -2.5), ("good", 1.9)]


def test_large_stopword_list_path_equals_inline(spark, monkeypatch):
    rows = [("1", 0, ["the", "cat", "the", "sat", "cat"]), ("1", 1, []), ("1", 2, None), ("1", 3, ["the", "of"]),
            ("1", 4, ["a", "dog"]), ("1", 4, ["the", "bird"])]
    df = spark.createDataFrame(rows, "Episode string, SentenceIndex long, Tokens array<string>")
    stop = spark.createDataFrame([(w,) for w in [*default_stopword_list(), None]], "word string")
    want = [(0, ["cat", "sat", "cat"]), (1, []), (2, None), (3, []), (4, ["bird"]), (4, ["dog"])]
    for limit in (20_000, 10):
        monkeypatch.setattr(SW, "INLINE_MAX_WORDS", limit)
        for words in (stop, list(default_stopword_list())):
            got = [(r.SentenceIndex, r.Tokens) for r in SW.remove_stopwords(df, words, "Tokens").collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr)


def test_word_frequency_and_top(spark):
    df = spark.createDataFrame([("1", "b a b c"), ("1", "a b"), ("2", "z")], "Episode string, CleanText string")
    stop = spark.createDataFrame([("c",)], "word string")
    freq = W.word_frequency(df, stop)
    got = {(r.Episode, r.word): r.wordsCount for r in freq.collect()}
    assert got == {("1", "a"): 2, ("1", "b"): 3, ("2", "z"): 1}
    top = W.top_words(freq, 1).collect()
    assert sorted((r.Episode, r.word) for r in top) == [("1", "b"), ("2", "z")]
    cloud = {r.word: r.weight for r in W.wordcloud_weights(freq, 5).where("Episode = '1'").collect()}
    assert cloud == {"b": 1.0, "a": 2 / 3}


def test_top_words_plan_limits_before_shuffle(spark):
    df = spark.createDataFrame([("1", "a b")], "Episode string, CleanText string")
    plan = W.top_words(W.word_frequency(df, None), 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_large_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    from pyspark.sql import functions as F

    from tonality.sources.utterances import TASK_ROWS, utterances_from_table
    docs = spark.range(2 * TASK_ROWS + 100).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 9 > 0, "id")).alias("text"),
        F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 7).alias("source"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = utterances_from_table(spark, str(tmp_path))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) * 2 < sum(sizes)
    assert out.count() == docs.count() and out.agg(F.sum("SentenceIndex"), F.count("Text")).first() == docs.agg(F.sum("doc_id"), F.count("text")).first()


def test_small_and_empty_tables_are_not_dealt_out(spark):
    from tonality.sources.utterances import dealt_out
    for n in (0, 1000):
        df = spark.range(n).coalesce(1)
        assert dealt_out(df) is df
