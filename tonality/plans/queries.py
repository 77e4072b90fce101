"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (``documents`` bound to utterances) whole;
computed columns are aliased to the names used by the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions import text as T
from tonality.functions.treebank import treebank_tokens
from tonality.operators import characters as C
from tonality.operators import words as W
from tonality.operators.prepare import prepare_utterances
from tonality.plans.context import Inputs
from tonality.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _round(c, d: int = 6):
    return F.round(c, d)


# --------------------------------------------------------------- projections

@query("fill_character")
def q_fill_character(spark, sf_dir):
    u = Inputs(spark, sf_dir).utterances()
    return C.fill_character(u).select("Episode", "SentenceIndex", "Character")


@query("cast_character")
def q_cast_character(spark, sf_dir):
    u = Inputs(spark, sf_dir).utterances()
    return C.cast_character(C.fill_character(u)).select("Episode", "SentenceIndex", "Character")


@query("decode_character")
def q_decode_character(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    return (C.decode_character(inp.utterances(), inp.characters(), strict=True)
            .select("Episode", "SentenceIndex", "CharacterCode", "Character"))


def _text_step(fn, before=lambda c: c):
    def run(spark, sf_dir):
        u = Inputs(spark, sf_dir).utterances()
        return u.select("Episode", "SentenceIndex", fn(before(F.col("Text"))).alias("Text"))
    return run


def _with_emoji(c):
    """The tables hold no emoji: each sentence end gets some."""
    return F.replace(c, F.lit("."), F.lit(". \U0001F600\u2764\uFE0F"))


def _with_blanks(c):
    """The tables hold single blanks only: they are widened, and the ends padded."""
    return F.concat(F.lit(" \t"), F.replace(F.replace(c, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \r\n\n ")), F.lit("\r\n"))


def _damaged(c):
    """UTF-8 read as Latin-1, as Windows-1252 would show it in documents with an even number."""
    broken = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    as_1252 = F.translate(broken, "".join(T._SIGNS.values()), "".join(T._SIGNS))
    return F.when(F.col("SentenceIndex") % 2 == 0, as_1252).otherwise(broken)


def _in_syllables(c):
    """The tables hold neither kana nor Hangul: the small vowels are written in them."""
    return F.translate(c, "aeiou", "か한ッ글닭")


QUERIES["strip_dashes"] = _text_step(T.strip_dashes)
QUERIES["lower_text"] = _text_step(T.lower_text)
QUERIES["strip_emoji"] = _text_step(T.strip_emoji, _with_emoji)
QUERIES["fold_ascii"] = _text_step(lambda c: T.fold_ascii(T.lower_text(c)))
QUERIES["repair_unicode"] = _text_step(T.repair_unicode, lambda c: _damaged(c))
QUERIES["fold_scripts"] = _text_step(lambda c: T.fold_ascii(T.lower_text(c)), lambda c: _in_syllables(c))
QUERIES["normalize_space"] = _text_step(T.normalize_space, _with_blanks)
QUERIES["clean_text"] = _text_step(T.clean_text)


@query("tokenize")
def q_tokenize(spark, sf_dir):
    return _token_rows(Inputs(spark, sf_dir).utterances(), T.tokenize(T.clean_text("Text")))


def _token_rows(u, toks):
    """A column of its own: two uses of one long expression would compute it twice."""
    return u.select("Episode", "SentenceIndex", toks.alias("_t")).select(
        "Episode", "SentenceIndex", F.size("_t").alias("n_tokens"), F.array_join("_t", " ").alias("tokens"))


def _with_quotes(c):
    """The tables hold hardly any quotes, clitics and numbers: each sentence end gets some."""
    return F.replace(c, F.lit(". "), F.lit(QUOTED))


#: What stands at the sentence ends of ``tokenize_treebank``.
QUOTED = """. "It's 1,000 o'clock," they cannot say (don't ask Mr. X) at 10:30... the dogs' 'twas: so" we'll wanna go. """


@query("tokenize_treebank")
def q_tokenize_treebank(spark, sf_dir):
    return _token_rows(Inputs(spark, sf_dir).utterances(), treebank_tokens(T.clean_text(_with_quotes(F.col("Text")))))


@query("treebank_words")
def q_treebank_words(spark, sf_dir):
    """Preparation with the Treebank's tokens: what is left without list A."""
    inp = Inputs(spark, sf_dir)
    p = prepare_utterances(inp.utterances(), inp.characters(), inp.stopwords_a(), keep_tokens=True, tokens=treebank_tokens)
    return p.select("Episode", "SentenceIndex", F.size("Tokens").alias("n_tokens"), "CleanText")


@query("remove_stopwords")
def q_remove_stopwords(spark, sf_dir):
    p = Inputs(spark, sf_dir).prepared(keep_tokens=True)
    return p.select("Episode", "SentenceIndex", F.size("Tokens").alias("n_tokens"), "CleanText")


@query("extract_words")
def q_extract_words(spark, sf_dir):
    p = Inputs(spark, sf_dir).prepared()
    words = T.extract_words("CleanText")
    return p.select("Episode", "SentenceIndex", F.size(words).alias("n_words"),
                    F.array_join(words, " ").alias("words"))


@query("episode_details")
def q_episode_details(spark, sf_dir):
    from tonality.operators.stats import episode_details
    inp = Inputs(spark, sf_dir)
    return episode_details(inp.utterances().select("Episode").distinct(), inp.episodes())


# ------------------------------------------------------------ word statistics

@query("word_anti_join")
def q_word_anti_join(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    p = inp.prepared()
    words = p.select("Episode", "SentenceIndex", F.posexplode(T.extract_words("CleanText"))
                     .alias("pos", "word"))
    return W.word_anti_join(words, inp.stopwords_b())


@query("word_frequency")
def q_word_frequency(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    return W.ordered(W.word_frequency(inp.prepared(), inp.stopwords_b()))


@query("top_words")
def q_top_words(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    return W.top_words(W.word_frequency(inp.prepared(), inp.stopwords_b()), 10)


@query("wordcloud_weights")
def q_wordcloud_weights(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    out = W.wordcloud_weights(W.word_frequency(inp.prepared(), inp.stopwords_b()), 50)
    return out.withColumn("weight", _round(F.col("weight")))


# --------------------------------------------------------------- small reports

@query("null_count")
def q_null_count(spark, sf_dir):
    from tonality.operators.stats import null_count
    return null_count(Inputs(spark, sf_dir).utterances())


@query("distinct_characters")
def q_distinct_characters(spark, sf_dir):
    from tonality.operators.stats import distinct_characters
    u = C.cast_character(C.fill_character(Inputs(spark, sf_dir).utterances()))
    return distinct_characters(u)


# ------------------------------------------------------------------- scorers

from tonality.operators import lexicon as L  # noqa: E402
from tonality.operators import model as M  # noqa: E402
from tonality.operators import stats as S  # noqa: E402
from tonality.plans import pipeline as P  # noqa: E402

KEYS = ["Episode", "SentenceIndex"]


def _r(df: DataFrame, cols, d: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c in cols})


@query("model_logits")
def q_model_logits(spark, sf_dir):
    """Pluggable batch scorer through mapInPandas (fixture linear scorer in pandas)."""
    p = Inputs(spark, sf_dir).prepared()
    out = M.score_with_pandas(p, M.LINEAR_KEY, M.linear_fixture_scorer, "CleanText", passthrough=KEYS)
    return _r(out.drop("model_error"), M.LOGIT_COLS)


@query("softmax_scores")
def q_softmax_scores(spark, sf_dir):
    p = Inputs(spark, sf_dir).prepared()
    return _r(M.linear_scores(p.select(*KEYS, "CleanText")).select(*KEYS, *M.SCORE_COLS), M.SCORE_COLS)


@query("weighted_logits")
def q_weighted_logits(spark, sf_dir):
    """The native linear scorer with a table of weights, learned from the documents with their episodes as classes."""
    p = materialize(Inputs(spark, sf_dir).prepared().select(*KEYS, "CleanText"))  # the weights and the scores read it
    weights = M.naive_bayes_weights(p, "Episode", ("1", "2", "3"))
    out = M.linear_scores(p, keep_logits=True, weights=weights).select(*KEYS, *M.LOGIT_COLS, "model_label")
    return _r(out, M.LOGIT_COLS)


@query("weighted_scores")
def q_weighted_scores(spark, sf_dir):
    """Labels by speaker of ``conversations`` under the weights learned from the documents, with the larger table's plan."""
    docs = Inputs(spark, sf_dir).prepared().select(*KEYS, "CleanText")
    inp = Inputs(spark, sf_dir, "conversations")
    scored = P.scored_table(inp.prepared(), inp.scoring(model_weights=M.naive_bayes_weights(docs, "Episode", ("1", "2", "3"))))
    return S.sentiment_totals(scored, by=("Character",)).select("Character", *[f"model_total_{x}" for x in M.CLASSES], "total_count")


#: Words that the scorer of ``model_rejects`` takes at most.
CONTEXT_WORDS = 300


@query("model_rejects")
def q_model_rejects(spark, sf_dir):
    """Rows that a scorer with a bounded context raises for."""
    p = Inputs(spark, sf_dir).prepared()
    out = M.score_with_pandas(p, M.ScorerKey("linear-fixture-limited", str(CONTEXT_WORDS)),
                              M.limited_fixture_scorer(CONTEXT_WORDS), "CleanText", passthrough=KEYS)
    return M.model_rejects(out)[1]


#: Added before rounding where products of the rules' constants end exactly in a half.
TIE = 1e-9


def _items(spark, sf_dir, *steps):
    inp = Inputs(spark, sf_dir)
    return L.lexicon_items(inp.plain(), inp.rules(), "PlainText", KEYS, steps)


@query("lex_valence")
def q_lex_valence(spark, sf_dir):
    return _r(_items(spark, sf_dir).select(*KEYS, "pos", "tl", F.col("v0").alias("valence")), ["valence"])


@query("lex_boost")
def q_lex_boost(spark, sf_dir):
    return _r(_items(spark, sf_dir, "boost").select(*KEYS, "pos", "tl", (F.col("v") + TIE).alias("v_boost")), ["v_boost"])


@query("lex_negate")
def q_lex_negate(spark, sf_dir):
    return _r(_items(spark, sf_dir, "negate").select(*KEYS, "pos", "tl", (F.col("v") + TIE).alias("v_negate")), ["v_negate"])


@query("lex_contrast")
def q_lex_contrast(spark, sf_dir):
    out = _items(spark, sf_dir, "modify", "contrast").select(*KEYS, "pos", "tl", "factor", "v")
    return _r(out.withColumn("v", F.col("v") + TIE), ["v"])


@query("lex_idiom")
def q_lex_idiom(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    out = L.lexicon_items(inp.plain(), inp.rules_with_idioms(), "PlainText", KEYS, ("modify",))
    return _r(out.select(*KEYS, "pos", "tl", (F.col("v") + TIE).alias("v_idiom")), ["v_idiom"])


@query("idiom_scores")
def q_idiom_scores(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    out = L.lexicon_scores(inp.plain().select(*KEYS, "PlainText"), inp.rules_with_idioms(), "PlainText")
    return out.select(*KEYS, "lex_compound", "lex_label")


@query("lex_punct")
def q_lex_punct(spark, sf_dir):
    p = Inputs(spark, sf_dir).prepared()
    return _r(p.select(*KEYS, L.punctuation_emphasis(F.col("CleanText")).alias("emphasis")),
              ["emphasis"])


@query("lex_caps")
def q_lex_caps(spark, sf_dir):
    """Capital-letter emphasis, on the raw text (the cleaned text is lower case)."""
    inp = Inputs(spark, sf_dir)
    ex = L.lexicon_items(inp.utterances(), inp.rules(), "Text", KEYS, ())
    return _r(ex.select(*KEYS, "pos", "t", "cap_diff", "v0", "v_caps"), ["v0", "v_caps"])


@query("lex_compound")
def q_lex_compound(spark, sf_dir):
    return Inputs(spark, sf_dir).scored().select(*KEYS, "lex_compound")


@query("lexicon_scores")
def q_lexicon_scores(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    return L.lexicon_scores(inp.prepared().select(*KEYS, "CleanText"), inp.rules()).drop("CleanText", "lex_label")


@query("major_sentiment")
def q_major_sentiment(spark, sf_dir):
    return Inputs(spark, sf_dir).scored().select(*KEYS, "lex_label", "model_label")


SCORED_COLS = ["lex_neg", "lex_neu", "lex_pos", "lex_compound", "model_neg", "model_neu", "model_pos"]


@query("scored_table")
def q_scored_table(spark, sf_dir):
    return _r(Inputs(spark, sf_dir).scored(), SCORED_COLS)


@query("filter_sentiment")
def q_filter_sentiment(spark, sf_dir):
    s = Inputs(spark, sf_dir).scored()
    return _r(s.where(F.col("model_label") == "Negative").select(*KEYS, "Character", "model_neg"),
              ["model_neg"])


@query("filter_character")
def q_filter_character(spark, sf_dir):
    s = Inputs(spark, sf_dir).scored()
    return s.where(F.col("Character") == "Mara Quill").select(*KEYS, "lex_label", "model_label")


# ---------------------------------------------------------------- statistics

@query("sentiment_totals")
def q_sentiment_totals(spark, sf_dir):
    return S.sentiment_totals(Inputs(spark, sf_dir).scored())


@query("sentiment_share")
def q_sentiment_share(spark, sf_dir):
    out = S.sentiment_share(Inputs(spark, sf_dir).scored())
    return _r(out, [c for c in out.columns if "_share_" in c])


@query("modal_sentiment")
def q_modal_sentiment(spark, sf_dir):
    return S.modal_sentiment(Inputs(spark, sf_dir).scored())


@query("character_counts")
def q_character_counts(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    return S.character_counts(inp.scored(), inp.characters())


@query("unknown_speakers")
def q_unknown_speakers(spark, sf_dir):
    """Turns by speaker against a dimension that lacks some of the codes: nobody's lines are lost."""
    from tonality.resources import CHARACTERS
    inp = Inputs(spark, sf_dir, "conversations")
    dim = inp.characters(CHARACTERS[1:3])
    scored = P.scored_table(inp.prepared(characters=dim), inp.scoring())
    return S.character_counts(scored.withColumn("Episode", F.lit("all")), dim)


@query("conversation_totals")
def q_conversation_totals(spark, sf_dir):
    """Labels by speaker over the second utterance table."""
    return S.sentiment_totals(Inputs(spark, sf_dir, "conversations").scored(), by=("Character",))


def _stats(spark, sf_dir, measures):
    inp = Inputs(spark, sf_dir)
    out = S.character_statistics(inp.scored(), inp.characters(), measures=measures)
    return _r(out, [c for c in out.columns if any(f"_{m}_" in c for m in ("avg", "median", "std"))])


QUERIES["stat_count"] = lambda spark, sf_dir: _stats(spark, sf_dir, ("count",))
QUERIES["stat_median"] = lambda spark, sf_dir: _stats(spark, sf_dir, ("median",))
QUERIES["stat_mean"] = lambda spark, sf_dir: _stats(spark, sf_dir, ("avg",))
QUERIES["stat_std"] = lambda spark, sf_dir: _stats(spark, sf_dir, ("std",))
QUERIES["character_statistics"] = lambda spark, sf_dir: _stats(spark, sf_dir, S.MEASURES)


@query("statistics_long")
def q_statistics_long(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    st = S.character_statistics(inp.scored(), inp.characters())
    return _r(S.statistics_long(st), ["value"])


@query("describe_scores")
def q_describe_scores(spark, sf_dir):
    out = S.describe_scores(Inputs(spark, sf_dir).scored())
    return _r(out, ["mean", "std", "min", "q25", "q50", "q75", "max"])


@query("row_counts")
def q_row_counts(spark, sf_dir):
    return S.row_counts(Inputs(spark, sf_dir).scored())


@query("last_turns")
def q_last_turns(spark, sf_dir):
    """Of each conversation's speakers, who take several turns, the last one."""
    inp = Inputs(spark, sf_dir, "conversations")
    policy = inp.scoring(duplicates="last", order_col="SentenceIndex")
    return P.one_per_key(inp.utterances(), policy, ("Episode", "Character"))


@query("duplicate_keys")
def q_duplicate_keys(spark, sf_dir):
    # a conversation's speakers take several turns
    return S.duplicate_keys(Inputs(spark, sf_dir, "conversations").utterances(), ("Episode", "Character"))


# -------------------------------------------------------------------- charts

from tonality.operators import charts as CH  # noqa: E402
from tonality.operators import document as D  # noqa: E402


@query("chart_share")
def q_chart_share(spark, sf_dir):
    return CH.chart_share(Inputs(spark, sf_dir).scored())


@query("chart_median_by_label")
def q_chart_median_by_label(spark, sf_dir):
    return _r(CH.chart_median_by_label(Inputs(spark, sf_dir).scored()), ["median"])


def _model_stats(spark, sf_dir, measure):
    inp = Inputs(spark, sf_dir)
    return S.character_statistics(inp.scored(), inp.characters(), measures=(measure,), scorers=("model",))


@query("chart_std")
def q_chart_std(spark, sf_dir):
    return CH.chart_std(_model_stats(spark, sf_dir, "std"))


@query("chart_median")
def q_chart_median(spark, sf_dir):
    return CH.chart_median(_model_stats(spark, sf_dir, "median"))


# ------------------------------------------------------- document and sinks

def document_for(inp: Inputs) -> DataFrame:
    from tonality.session import materialize
    # three consumers: cut the lineage once (reliable checkpoint in the shared folder)
    scored = materialize(inp.scored())
    return D.statistics_document(S.character_statistics(scored, inp.characters()),
                                 S.sentiment_totals(scored), S.modal_sentiment(scored),
                                 inp.episodes())


@query("statistics_document")
def q_statistics_document(spark, sf_dir):
    out = D.flatten_document(document_for(Inputs(spark, sf_dir)))
    # the document holds full precision; rounded here for the comparison
    number = F.col("value").try_cast("double")
    measure = (F.col("section") == "character") & ~F.col("key").endswith("Count") & (F.col("value") != "nan")
    return out.withColumn("value", F.when(measure, F.format_string("%.6f", F.round(number, 6))).otherwise(F.col("value")))


def _full_rounded(inp: Inputs) -> DataFrame:
    return _r(P.full_table(P.with_scores(inp.prepared(), inp.scoring())), SCORED_COLS)


@query("sink_csv_roundtrip")
def q_sink_csv_roundtrip(spark, sf_dir):
    from tonality.session import scratch_path
    from tonality.sources.sinks import write_csv
    from tonality.sources.utterances import CSV_READ_OPTIONS
    full = _full_rounded(Inputs(spark, sf_dir))
    path = scratch_path(spark, "full-csv")
    write_csv(full, path)
    # the partition column is in the schema, so that its value stays a string
    schema = full.select(*[c for c in full.columns if c != "Episode"], "Episode").schema
    return spark.read.schema(schema).options(**CSV_READ_OPTIONS).csv(path)


@query("sink_json_roundtrip")
def q_sink_json_roundtrip(spark, sf_dir):
    from tonality.session import scratch_path
    from tonality.sources.sinks import write_json
    full = _full_rounded(Inputs(spark, sf_dir))
    path = scratch_path(spark, "full-json")
    write_json(full, path)
    return spark.read.schema(full.schema).json(path)


@query("scan_csv")
def q_scan_csv(spark, sf_dir):
    """Utterance CSV files (one folder per episode) read back by their header, with a further column."""
    from tonality.session import scratch_path
    from tonality.sources.sinks import write_csv
    from tonality.sources.utterances import read_utterances
    u = Inputs(spark, sf_dir).utterances()
    path = scratch_path(spark, "utt-csv")
    write_csv(u.select("Text", F.length("Text").alias("n_chars"), "Character", "SentenceIndex", "Episode"), path)
    return read_utterances(spark, path)


@query("scan_episodes")
def q_scan_episodes(spark, sf_dir):
    """One scan over many episode files; the episode is taken from each file's name ``HPE<n>.csv``."""
    from tonality.session import materialize, scratch_path
    from tonality.sources.sinks import write_csv
    from tonality.sources.utterances import read_utterances
    u = materialize(Inputs(spark, sf_dir).utterances())
    path = scratch_path(spark, "utt-episodes")
    names = [r["Episode"] for r in u.select("Episode").distinct().collect()]  # three by the binding
    for name in names:
        write_csv(u.where(F.col("Episode") == name).drop("Episode"), f"{path}/HPE{name}.csv", partition_by=None)
    return read_utterances(spark, [f"{path}/HPE{name}.csv" for name in sorted(names)])
