from pyspark.sql import functions as F

from tonality.functions.treebank import treebank_tokens
from tonality.operators.prepare import prepare_utterances
from tonality.sources.dimensions import characters_df

CASES = [
    ("they cannot go.", "they can not go ."),
    ("wait... what?!", "wait ... what ? !"),
    ('"it\'s fine," she said.', "`` it 's fine , '' she said ."),
    ("(see [a] {b} <c>)", "( see [ a ] { b } < c > )"),
    ("i don't, you won't; we'll've", "i do n't , you wo n't ; we'll 've"),
    ("1,000 at 10:30, a:b", "1,000 at 10:30 , a : b"),
    ("the dogs' bowl at 5 o'clock", "the dogs ' bowl at 5 o'clock"),
    ("mr. x met dr. y etc. in the u.s.a today.", "mr. x met dr. y etc. in the u.s.a today ."),
    ("one. two.) three.\" four", "one . two . ) three . '' four"),
    ("'tis gonna be, 'twas; gotta, wannabe", "'t is gon na be , 't was ; got ta , wannabe"),
    ("a--b -- c-d", "a -- b -- c-d"),
    ("50% of $5 & #1 @me *!", "50 % of $ 5 & # 1 @ me * !"),
    ("naïve' 漢字. ok", "naïve ' 漢字 . ok"),
    ("cannots scan not candid", "cannots scan not candid"),
    ("''quoted'' \"\"", "`` quoted '' `` ''"),
    ("", ""), (" \n\t ", ""),
]


def tokens(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in df.select("i", treebank_tokens("t", **kw).alias("o")).orderBy("i").collect()]


def test_cases_of_the_convention(spark):
    got = tokens(spark, [t for t, _ in CASES])
    assert [" ".join(g) for g in got] == [want for _, want in CASES]


def test_null_and_long_words(spark):
    long = ["x" * 200_000, "n" * 50_000, "a.b" * 50_000, "'" * 1001, "." * 50_000]
    got = tokens(spark, [None, *long])
    assert got[0] is None
    assert got[1:4] == [[t] for t in long[:3]]
    assert "".join(got[4]).replace("`", "'") == long[3] and got[5] == [long[4]]


def test_nothing_but_white_space_is_lost(spark):
    import random
    rng = random.Random(5)
    texts = ["".join(rng.choice("abnt0 .,:;'`(-)!\n") for _ in range(rng.randrange(40))) for _ in range(500)]
    for t, got in zip(texts, tokens(spark, texts)):
        # opening and closing quotes differ only in their sign
        assert "".join(got).replace("`", "'") == "".join(t.split()).replace("`", "'"), t
        assert all(g and not any(c.isspace() for c in g) for g in got)


def test_own_abbreviations(spark):
    assert tokens(spark, ["mr. x, no. 5."], abbreviations=["no"]) == [["mr", ".", "x", ",", "no.", "5", "."]]
    assert tokens(spark, ["mr. x"], abbreviations=[]) == [["mr", ".", "x"]]


def test_preparation_takes_the_tokens(spark):
    utt = spark.createDataFrame([("1", 0, 1.0, 'She CANNOT say "no"...')], "Episode string, SentenceIndex long, Character double, Text string")
    out = prepare_utterances(utt, characters_df(spark), ["she"], keep_tokens=True, tokens=treebank_tokens)
    row = out.select("CleanText", F.size("Tokens").alias("n")).first()
    assert (row.CleanText, row.n) == ("can not say `` no '' ...", 7)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_cut_once_for_their_number_and_their_text(spark):
    from tonality.functions import text as T
    from tonality.functions.treebank import treebank_pattern
    from tonality.plans.queries import _token_rows
    u = spark.createDataFrame([("1", 1, "It's so. Go!")], "Episode string, SentenceIndex bigint, Text string")
    for cut, pattern in ((T.tokenize, T.TOKEN_PATTERN), (treebank_tokens, treebank_pattern())):
        rows = _token_rows(u, cut(T.clean_text("Text")))
        assert _plan(rows).count(pattern) == 1
        assert tuple(rows.first()) == ("1", 1, 6, "it 's so . go !")


def test_words_skip_the_rules_for_marks_and_keep_them(spark):
    """Tokens of texts of marks, clitics, abbreviations and blanks in every order against the plain form of the pattern."""
    import itertools
    import re
    from tonality.functions import treebank as B
    letters = r"\w"
    end = rf"(?![{letters}'])"
    kept = "|".join(re.escape(a) for a in ("mr", "e.g"))

    def last(m, text):  # Python's lookbehind needs one width
        return not re.search(rf"(?:^|[^{letters}.])(?:{kept})$", text[:m.start()])

    dot = r"\.(?=[\])}>']*(?:\s|$))"
    apart = [r"\.{2,}", "-{2,}", "``", "''", "[:,](?![0-9])", rf"n't{end}|'(?:s|m|d|ll|re|ve){end}", dot, rf"'(?![{letters}])"]
    halves = "|".join(rf"(?<![{letters}'])" + f"{a}(?={b}{end})" for a, b in B.TWO_TOKENS)

    def at(text, i):
        for p in [*apart, r"[;@#$%&?!*\[\](){}<>]"]:
            m = re.compile(p).match(text, i)
            if m and (p != dot or last(m, text)):
                return m.end()
        m = re.compile(halves).match(text, i)
        if m:
            return m.end()
        j = i
        while j < len(text) and not text[j].isspace() and text[j] not in ";@#$%&?!*[](){}<>":
            if text[j] in ".:,'`n-" and any((m := re.compile(p).match(text, j)) and (p != dot or last(m, text)) for p in apart):
                break
            j += 1
        return j

    def plain(text):
        text, out, i = re.sub(r"(^|[\s(\[{<])(?:\"|'')", r"\1``", text).replace('"', "''"), [], 0
        while i < len(text):
            j = at(text, i)
            if j > i:
                out.append(text[i:j])
            i = max(j, i + 1)
        return out

    parts = ["mr", "n't", "cannot", ".", "'", '"', " ", "e.g", "'s", "1,0", "--", "né"]
    texts = ["".join(p) for p in itertools.product(parts, repeat=3)]
    assert tokens(spark, texts, abbreviations=("mr", "e.g")) == [plain(t) for t in texts]
