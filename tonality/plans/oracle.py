"""Independent DuckDB SQL for every registered query (the correctness oracle).

Shared with the Spark side are only data: the fixture word lists, the folding
table and the regular expressions.  The logic is written again in SQL here
(windows with ``lag`` where Spark uses array neighbours, ``unnest`` + GROUP BY
where Spark uses higher-order functions, ...).
"""

from __future__ import annotations

from tonality.functions.text import (ASCII_PUNCT_CLASS, EMOJI_PATTERN, TOKEN_PATTERN, UNFOLDED_PATTERN,
                                     WORD_PATTERN, fold_tables)
from tonality.plans.context import (BOUND_BOOSTERS, BOUND_CONTRAST, BOUND_IDIOMS, BOUND_NEGATORS,
                                    BOUND_PHRASES, COMMON_SHARE)
from tonality.resources import CHARACTERS, EPISODES, default_stopword_list

ORACLE: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols: list[str], types: list[str]) -> str:
    """Inline VALUES table with typed columns."""
    body = ", ".join(
        "(" + ", ".join(lit(v) if isinstance(v, str) else repr(float(v)) for v in r) + ")"
        for r in rows)
    sel = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in zip(cols, types))
    return f"(SELECT {sel} FROM (VALUES {body}) v({', '.join(cols)}))"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


NL = "chr(10)"

# ---------------------------------------------------------------- expressions


def sql_strip_dashes(x: str) -> str:
    return f"replace({x}, '-', '')"


def sql_emoji(x: str) -> str:
    return f"regexp_replace({x}, {lit(EMOJI_PATTERN)}, '', 'g')"


def sql_fold(x: str) -> str:
    src, dst, multi, letters = fold_tables()
    out = f"translate({x}, {lit(src)}, {lit(dst)})"
    for ch, rep in [*multi, *letters]:
        out = f"replace({out}, {lit(ch)}, {lit(rep)})"
    return f"regexp_replace({out}, {lit(UNFOLDED_PATTERN)}, '', 'g')"


def sql_space(x: str) -> str:
    out = f"regexp_replace({x}, '\\r\\n?', {NL}, 'g')"
    out = f"regexp_replace({out}, '[ \\t\\f\\x0B]+', ' ', 'g')"
    out = f"regexp_replace({out}, ' ?\\n[ \\n]*', {NL}, 'g')"
    return f"regexp_replace({out}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def sql_clean(x: str) -> str:
    return sql_space(sql_fold(sql_emoji(f"lower({sql_strip_dashes(x)})")))


def sql_tokens(x: str) -> str:
    split = f"regexp_replace({x}, 'n''t\\b', ' n''t', 'g')"
    return f"regexp_extract_all({split}, {lit(TOKEN_PATTERN)})"


def sql_treebank(x: str) -> str:
    """Blanks around the tokens, one replacement after the other; a dot that stays is chr(1) meanwhile."""
    steps = [
        (r"(^|[\s(\[{<])(?:\"|'')", r"\1``"), (r'"', "''"),
        (r"(^|[^a-z0-9_.])(mr|mrs|ms|dr|st|vs|prof|jr|sr|etc|e\.g|i\.e)\.([^.]|$)", "\\1\\2\x01\\3"),
        (r"(\.{2,})", r" \1 "), (r"([^.\s])\.([\])}>']*)(\s|$)", r"\1 . \2\3"),
        (r"([;@#$%&?!*\[\](){}<>]|``|'')", r" \1 "),
        (r"([:,])([^0-9]|$)", r" \1 \2"), (r"([:,])([^0-9]|$)", r" \1 \2"),
        (r"(n't|'(?:s|m|d|ll|re|ve))([^\w']|$)", r" \1\2"), (r"([^'\s])'([^'\w]|$)", r"\1 ' \2"),
        (r"(^|[^\w'])(can|gim|gon|got|lem|wan|'t)(not|me|na|ta|is|was)([^\w']|$)", r"\1\2 \3\4"), ("\x01", "."),
    ]
    for pattern, put in steps:
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(put)}, 'g')"
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def sql_words(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(WORD_PATTERN)})"


STOP_A = in_list(default_stopword_list())


def sql_drop_stop(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: t NOT IN {STOP_A})"


CHAR_DIM = values(CHARACTERS, ["code", "name"], ["VARCHAR", "VARCHAR"])
EPISODE_DIM = values(EPISODES, ["Episode", "Description", "Duration"],
                     ["VARCHAR", "VARCHAR", "VARCHAR"])
STOP_B = f"""(SELECT word FROM (SELECT unnest(list_distinct({sql_words(sql_clean('text'))})) AS word FROM conversations)
  GROUP BY word HAVING count(*) * {COMMON_SHARE} >= (SELECT count(*) FROM conversations))"""

# ----------------------------------------------------------------------- CTEs

UTT = """utt AS (
  SELECT CAST(1 + doc_id % 3 AS VARCHAR) AS Episode, doc_id AS SentenceIndex,
         CAST(NULLIF(CAST(substr(source, 4) AS INTEGER) % 6, 0) AS DOUBLE) AS Character,
         text AS Text
  FROM documents)"""

CONV = """utt AS (
  SELECT CAST(conv_id AS VARCHAR) AS Episode, turn AS SentenceIndex,
         CASE role WHEN 'user' THEN 1.0 WHEN 'assistant' THEN 2.0 END AS Character, text AS Text
  FROM conversations)"""


def prep_of(utt: str, dim: str) -> str:
    return f"""{utt},
coded AS (
  SELECT Episode, SentenceIndex,
         CAST(CAST(trunc(coalesce(Character, 0.0)) AS SMALLINT) AS VARCHAR) AS CharacterCode,
         Text FROM utt),
named AS (
  SELECT c.Episode, c.SentenceIndex, c.CharacterCode, d.name AS Character, c.Text
  FROM coded c LEFT JOIN {dim} d ON c.CharacterCode = d.code),
toks AS (
  SELECT *, {sql_drop_stop(sql_tokens(sql_clean('Text')))} AS Tokens FROM named),
prep AS (
  SELECT Episode, SentenceIndex, CharacterCode, Character, Text, Tokens,
         array_to_string(Tokens, ' ') AS CleanText FROM toks)"""


PREP = prep_of(UTT, CHAR_DIM)

WORDFREQ = f"""{PREP},
words AS (SELECT Episode, unnest({sql_words('CleanText')}) AS word FROM prep),
freq AS (
  SELECT Episode, word, count(*) AS wordsCount FROM words
  WHERE word NOT IN (SELECT word FROM {STOP_B})
  GROUP BY Episode, word)"""


def q(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


# ---------------------------------------------------------------- projections

q("fill_character", f"""WITH {UTT}
SELECT Episode, SentenceIndex, coalesce(Character, 0.0) AS Character FROM utt""")

q("cast_character", f"""WITH {UTT}
SELECT Episode, SentenceIndex,
       CAST(CAST(trunc(coalesce(Character, 0.0)) AS SMALLINT) AS VARCHAR) AS Character FROM utt""")

q("decode_character", f"""WITH {PREP}
SELECT Episode, SentenceIndex, CharacterCode, Character FROM prep""")

q("strip_dashes", f"WITH {UTT} SELECT Episode, SentenceIndex, {sql_strip_dashes('Text')} AS Text FROM utt")
q("lower_text", f"WITH {UTT} SELECT Episode, SentenceIndex, lower(Text) AS Text FROM utt")
q("strip_emoji", f"WITH {UTT} SELECT Episode, SentenceIndex, {sql_emoji("replace(Text, '.', '. ' || chr(128512) || chr(10084) || chr(65039))")} AS Text FROM utt")
q("fold_ascii", f"WITH {UTT} SELECT Episode, SentenceIndex, {sql_fold('lower(Text)')} AS Text FROM utt")
# damaged text is whole again
q("repair_unicode", f"WITH {UTT} SELECT Episode, SentenceIndex, Text FROM utt")
# vowels stand as control signs until the rest is folded
_SYLLABLES = "translate(Text, 'aeiou', chr(1) || chr(2) || chr(3) || chr(4) || chr(5))"
_SYLLABLES = sql_fold(f"lower({_SYLLABLES})")
for _code, _spelled in ((1, "ka"), (2, "han"), (3, "tu"), (4, "geul"), (5, "dalg")):
    _SYLLABLES = f"replace({_SYLLABLES}, chr({_code}), '{_spelled}')"
q("fold_scripts", f"WITH {UTT} SELECT Episode, SentenceIndex, {_SYLLABLES} AS Text FROM utt")
_BLANKS = ("(' ' || chr(9) || replace(replace(Text, ' ', '  '), chr(10), ' ' || chr(13) || chr(10) || chr(10) || ' ') "
           "|| chr(13) || chr(10))")
q("normalize_space", f"WITH {UTT} SELECT Episode, SentenceIndex, {sql_space(_BLANKS)} AS Text FROM utt")
q("clean_text", f"WITH {UTT} SELECT Episode, SentenceIndex, {sql_clean('Text')} AS Text FROM utt")

q("tokenize", f"""WITH {UTT}, t AS (SELECT Episode, SentenceIndex, {sql_tokens(sql_clean('Text'))} AS tk FROM utt)
SELECT Episode, SentenceIndex, CAST(len(tk) AS INTEGER) AS n_tokens, array_to_string(tk, ' ') AS tokens FROM t""")

QUOTED = """. "It's 1,000 o'clock," they cannot say (don't ask Mr. X) at 10:30... the dogs' 'twas: so" we'll wanna go. """
_QUOTED = f"replace(Text, '. ', {lit(QUOTED)})"
q("tokenize_treebank", f"""WITH {UTT}, t AS (SELECT Episode, SentenceIndex, {sql_treebank(sql_clean(_QUOTED))} AS tk FROM utt)
SELECT Episode, SentenceIndex, CAST(len(tk) AS INTEGER) AS n_tokens, array_to_string(tk, ' ') AS tokens FROM t""")

q("treebank_words", f"""WITH {UTT}, t AS (SELECT Episode, SentenceIndex, {sql_drop_stop(sql_treebank(sql_clean('Text')))} AS tk FROM utt)
SELECT Episode, SentenceIndex, CAST(len(tk) AS INTEGER) AS n_tokens, array_to_string(tk, ' ') AS CleanText FROM t""")

q("remove_stopwords", f"""WITH {PREP}
SELECT Episode, SentenceIndex, CAST(len(Tokens) AS INTEGER) AS n_tokens, CleanText FROM prep""")

q("extract_words", f"""WITH {PREP}, w AS (SELECT Episode, SentenceIndex, {sql_words('CleanText')} AS ws FROM prep)
SELECT Episode, SentenceIndex, CAST(len(ws) AS INTEGER) AS n_words, array_to_string(ws, ' ') AS words FROM w""")

q("episode_details", f"""WITH {UTT}, e AS (SELECT DISTINCT Episode FROM utt)
SELECT e.Episode, d.Description, d.Duration FROM e LEFT JOIN {EPISODE_DIM} d ON e.Episode = d.Episode""")

# ------------------------------------------------------------ word statistics

q("word_anti_join", f"""WITH {PREP},
w AS (SELECT Episode, SentenceIndex, unnest({sql_words('CleanText')}) AS word,
             unnest(range(len({sql_words('CleanText')}))) AS pos FROM prep)
SELECT word, Episode, SentenceIndex, CAST(pos AS INTEGER) AS pos FROM w
WHERE word NOT IN (SELECT word FROM {STOP_B})""")

q("word_frequency", f"WITH {WORDFREQ} SELECT Episode, word, wordsCount FROM freq")

q("top_words", f"""WITH {WORDFREQ},
r AS (SELECT Episode, word, wordsCount,
             CAST(row_number() OVER (PARTITION BY Episode ORDER BY wordsCount DESC, word) AS INTEGER) AS rank
      FROM freq)
SELECT * FROM r WHERE rank <= 10""")

q("wordcloud_weights", f"""WITH {WORDFREQ},
r AS (SELECT Episode, word, wordsCount,
             CAST(row_number() OVER (PARTITION BY Episode ORDER BY wordsCount DESC, word) AS INTEGER) AS rank
      FROM freq)
SELECT Episode, word, wordsCount, rank,
       round(wordsCount / max(wordsCount) OVER (PARTITION BY Episode), 6) AS weight
FROM r WHERE rank <= 50""")

# --------------------------------------------------------------- small reports

q("null_count", f"""WITH {UTT}
SELECT Episode, count(*) FILTER (WHERE Character IS NULL) AS null_count FROM utt GROUP BY Episode""")

q("distinct_characters", f"""WITH {UTT}
SELECT DISTINCT Episode, CAST(CAST(trunc(coalesce(Character, 0.0)) AS SMALLINT) AS VARCHAR) AS Character
FROM utt""")


# ------------------------------------------------------------------- scorers

from tonality.operators.lexicon import PUNCT_EDGES, SPLIT_BLANKS  # noqa: E402
from tonality.resources import (BOOST_DISTANCE_DAMP, CAPS_INCREMENT,  # noqa: E402
                                MINI_LEXICON, NEGATION_SCALAR, NEVER_SO_SCALAR)

LEXV = values(MINI_LEXICON, ["token", "valence"], ["VARCHAR", "DOUBLE"])
BOOSTV = values(BOUND_BOOSTERS, ["token", "delta"], ["VARCHAR", "DOUBLE"])
NEGV = values([(w,) for w in BOUND_NEGATORS], ["token"], ["VARCHAR"])


def sql_upper(x: str) -> str:
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


def sql_linear_logit(words: str, mult: int) -> str:
    return (f"CASE WHEN len({words}) > 0 THEN "
            f"list_sum(list_transform({words}, lambda w: (ascii(w) * {mult} + length(w)) % 11 - 5))"
            f" / (10.0::DOUBLE * len({words})) ELSE 0.0::DOUBLE END")


def sql_idiom(x: str) -> str:
    """A lexicon item's value ``x`` after the phrases around it; ``n1``, ``n2`` are the items behind."""
    found = "CASE {} " + " ".join(f"WHEN {lit(p)} THEN {v!r}::DOUBLE" for p, v in BOUND_IDIOMS) + " END"
    places = (("tl", "n1", "n2"), ("tl", "n1"), ("p1", "tl"), ("p2", "p1", "tl"), ("p2", "p1"), ("p3", "p2", "p1"), ("p3", "p2"))
    said = ", ".join(found.format("(" + " || ' ' || ".join(ws) + ")") for ws in places)
    damps = in_list([p for p, _ in BOUND_PHRASES])
    damp = f"CASE WHEN coalesce((p3 || ' ' || p2) IN {damps}, false) OR coalesce((p2 || ' ' || p1) IN {damps}, false) THEN 0.293::DOUBLE ELSE 0.0::DOUBLE END"
    known = in_list([w for w, _ in MINI_LEXICON])
    return f"CASE WHEN in_lex AND p3 IS NOT NULL AND p3 NOT IN {known} THEN coalesce({said}, {x}) - {damp} ELSE {x} END"


def lex_ctes(src: str = "prep", text: str = "CleanText", idioms: bool = False) -> str:
    """CTEs ending in ``chain`` (per item) and ``sent`` (per sentence) over ``src``."""
    behind = "lead(tl, 2) OVER (PARTITION BY Episode, SentenceIndex ORDER BY pos) AS n2"
    last = f"(SELECT * REPLACE ({sql_idiom('a6')} AS a6) FROM (SELECT *, {behind} FROM c6))" if idioms else "c6"
    d1, d2, d3 = BOOST_DISTANCE_DAMP
    ns = repr(NEGATION_SCALAR)

    def gate(d):
        return f"(p{d} IS NOT NULL AND NOT coalesce(l{d}, false))"

    def negw(d):
        return f"(coalesce(g{d}, false) OR contains(p{d}, 'n''t'))"

    def boost(v, d, damp):
        caps = f"(capdiff AND {sql_upper(f'o{d}')})"
        return (f"CASE WHEN {gate(d)} AND b{d} IS NOT NULL THEN {v} + "
                f"((CASE WHEN {v} < 0 THEN -b{d} ELSE b{d} END) + "
                f"(CASE WHEN {caps} THEN (CASE WHEN {v} > 0 THEN {CAPS_INCREMENT} ELSE -{CAPS_INCREMENT} END) ELSE 0.0 END))"
                f" * {damp} ELSE {v} END")

    def negate(v, d):
        if d == 1:
            return f"CASE WHEN {gate(1)} AND {negw(1)} THEN {v} * {ns} ELSE {v} END"
        so = " OR ".join(f"p{k} IN ('so', 'this')" for k in range(1, d))
        sc = NEVER_SO_SCALAR[d - 2]
        return (f"CASE WHEN {gate(d)} AND p{d} = 'never' AND ({so}) THEN {v} * {sc} "
                f"WHEN {gate(d)} AND {negw(d)} THEN {v} * {ns} ELSE {v} END")

    contrast = ", ".join(f"nullif(coalesce(list_position(list_transform(it, lambda w: lower(w)), '{w}'), 0), 0)" for w in BOUND_CONTRAST)
    return f"""
items AS (
  SELECT Episode, SentenceIndex, coalesce({text}, '') AS tx,
         list_filter(list_transform(string_split_regex(coalesce({text}, ''), {lit(SPLIT_BLANKS)}),
                                    lambda w: regexp_replace(w, {lit(PUNCT_EDGES)}, '', 'g')),
                     lambda w: length(w) > 1) AS it
  FROM {src}),
sent0 AS (
  SELECT Episode, SentenceIndex, it, len(it) AS n,
         coalesce(least({contrast}), 0) AS but_pos,
         length(tx) - length(replace(tx, '!', '')) AS n_excl,
         length(tx) - length(replace(tx, '?', '')) AS n_q,
         coalesce(list_bool_or(list_transform(it, lambda w: {sql_upper('w')})), false)
           AND coalesce(list_bool_or(list_transform(it, lambda w: NOT {sql_upper('w')})), false) AS capdiff
  FROM items),
sent AS MATERIALIZED (
  SELECT Episode, SentenceIndex, n, but_pos, capdiff,
         least(n_excl, 4) * 0.292::DOUBLE
         + CASE WHEN n_q > 3 THEN 0.96::DOUBLE WHEN n_q > 1 THEN n_q * 0.18::DOUBLE ELSE 0.0::DOUBLE END AS emph
  FROM sent0),
tok AS (
  SELECT Episode, SentenceIndex, unnest(it) AS t, unnest(range(len(it))) AS pos FROM sent0),
ctx AS (
  SELECT Episode, SentenceIndex, t, CAST(pos AS INTEGER) AS pos, lower(t) AS tl,
         lag(lower(t), 1) OVER w AS p1, lag(lower(t), 2) OVER w AS p2, lag(lower(t), 3) OVER w AS p3,
         lag(t, 1) OVER w AS o1, lag(t, 2) OVER w AS o2, lag(t, 3) OVER w AS o3,
         lead(lower(t), 1) OVER w AS n1
  FROM tok WINDOW w AS (PARTITION BY Episode, SentenceIndex ORDER BY pos)),
lexv AS {LEXV},
boostv AS {BOOSTV},
negv AS {NEGV},
modw AS (
  SELECT token FROM boostv UNION SELECT token FROM negv UNION SELECT 'least' UNION SELECT 'never'
  UNION SELECT token FROM lexv WHERE contains(token, 'n''t')),
mods AS (
  SELECT w.token, b.delta AS m_boost, (n.token IS NOT NULL) AS m_neg, (l.token IS NOT NULL) AS m_inlex
  FROM modw w LEFT JOIN boostv b ON w.token = b.token LEFT JOIN negv n ON w.token = n.token
       LEFT JOIN lexv l ON w.token = l.token),
lk AS (
  SELECT c.*, s.capdiff, s.but_pos,
         (m0.token IS NOT NULL) AS is_mod, m0.m_boost AS b0,
         m1.m_boost AS b1, m1.m_neg AS g1, m1.m_inlex AS l1,
         m2.m_boost AS b2, m2.m_neg AS g2, m2.m_inlex AS l2,
         m3.m_boost AS b3, m3.m_neg AS g3, m3.m_inlex AS l3,
         lx.valence AS val
  FROM ctx c JOIN sent s ON c.Episode = s.Episode AND c.SentenceIndex = s.SentenceIndex
       LEFT JOIN mods m0 ON c.tl = m0.token LEFT JOIN mods m1 ON c.p1 = m1.token
       LEFT JOIN mods m2 ON c.p2 = m2.token LEFT JOIN mods m3 ON c.p3 = m3.token
       LEFT JOIN lexv lx ON c.tl = lx.token),
lv AS (
  SELECT *, coalesce(val, CASE WHEN NOT is_mod AND NOT contains(tl, 'n''t') AND regexp_full_match(tl, '[a-z]{{3,}}')
                               THEN ((ascii(tl) + length(tl)) % 9 - 4) * 0.5::DOUBLE END) AS valence,
         (b0 IS NOT NULL OR (tl = 'kind' AND n1 IS NOT DISTINCT FROM 'of')) AS skip
  FROM lk),
lv0 AS (
  SELECT *, (valence IS NOT NULL AND NOT skip) AS in_lex,
         CASE WHEN skip OR valence IS NULL THEN 0.0::DOUBLE ELSE valence END AS v0
  FROM lv),
lcaps AS (
  SELECT *, CASE WHEN in_lex AND capdiff AND {sql_upper('t')}
                 THEN (CASE WHEN v0 > 0 THEN v0 + {CAPS_INCREMENT} ELSE v0 - {CAPS_INCREMENT} END)
                 ELSE v0 END AS v_caps
  FROM lv0),
c1 AS (SELECT *, {boost('v_caps', 1, d1)} AS a1 FROM lcaps),
c2 AS (SELECT *, {negate('a1', 1)} AS a2 FROM c1),
c3 AS (SELECT *, {boost('a2', 2, d2)} AS a3 FROM c2),
c4 AS (SELECT *, {negate('a3', 2)} AS a4 FROM c3),
c5 AS (SELECT *, {boost('a4', 3, d3)} AS a5 FROM c4),
c6 AS (SELECT *, {negate('a5', 3)} AS a6 FROM c5),
c7 AS (
  SELECT *, CASE WHEN NOT in_lex THEN v_caps
                 WHEN {gate(1)} AND p1 = 'least' AND NOT coalesce(p2 IN ('at', 'very'), false) THEN a6 * {ns}
                 ELSE a6 END AS v_mod
  FROM {last}),
chain AS MATERIALIZED (
  SELECT *, CASE WHEN but_pos > 0 AND pos < but_pos - 1 THEN 0.5::DOUBLE
                 WHEN but_pos > 0 AND pos > but_pos - 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS factor,
         v_mod * (CASE WHEN but_pos > 0 AND pos < but_pos - 1 THEN 0.5::DOUBLE
                       WHEN but_pos > 0 AND pos > but_pos - 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS v
  FROM c7),
bonly AS (
  SELECT *, CASE WHEN in_lex THEN {boost(boost(boost('v_caps', 1, d1), 2, d2), 3, d3)} ELSE v_caps END AS v_boost
  FROM lcaps),
nonly AS (
  SELECT *, CASE WHEN in_lex THEN {negate(negate(negate('v_caps', 1), 2), 3)} ELSE v_caps END AS v_negate
  FROM lcaps),
sagg AS (
  SELECT Episode, SentenceIndex, sum(v) AS s,
         sum(CASE WHEN v > 0 THEN v + 1.0 ELSE 0.0 END) AS ps,
         sum(CASE WHEN v < 0 THEN v - 1.0 ELSE 0.0 END) AS ns,
         count(*) FILTER (WHERE v > 0) AS np, count(*) FILTER (WHERE v < 0) AS nn
  FROM chain GROUP BY Episode, SentenceIndex),
sfin AS (
  SELECT t.*, (t.n - t.np - t.nn)::DOUBLE AS neu,
         CASE WHEN t.s > 0 THEN t.s + t.emph WHEN t.s < 0 THEN t.s - t.emph ELSE t.s END AS s2,
         CASE WHEN t.ps > abs(t.ns) THEN t.ps + t.emph ELSE t.ps END AS ps2,
         CASE WHEN t.ps < abs(t.ns) THEN t.ns - t.emph ELSE t.ns END AS ns2
  FROM (SELECT s.Episode, s.SentenceIndex, s.n, s.emph, coalesce(a.s, 0.0) AS s,
               coalesce(a.ps, 0.0) AS ps, coalesce(a.ns, 0.0) AS ns,
               coalesce(a.np, 0) AS np, coalesce(a.nn, 0) AS nn
        FROM sent s LEFT JOIN sagg a ON s.Episode = a.Episode AND s.SentenceIndex = a.SentenceIndex) t),
lexs AS (
  SELECT Episode, SentenceIndex,
         CASE WHEN n > 0 THEN round(abs(ns2 / (ps2 + abs(ns2) + neu)), 3) ELSE 0.0 END AS lex_neg,
         CASE WHEN n > 0 THEN round(abs(neu / (ps2 + abs(ns2) + neu)), 3) ELSE 0.0 END AS lex_neu,
         CASE WHEN n > 0 THEN round(abs(ps2 / (ps2 + abs(ns2) + neu)), 3) ELSE 0.0 END AS lex_pos,
         CASE WHEN n > 0 THEN round(greatest(-1.0, least(1.0, s2 / sqrt(s2 * s2 + 15.0))), 4) ELSE 0.0 END
           AS lex_compound
  FROM sfin)"""


MODEL = """
mw AS (SELECT Episode, SentenceIndex, {ws} AS ws FROM prep),
ml AS (SELECT Episode, SentenceIndex, {l0} AS logit_neg, {l1} AS logit_neu, {l2} AS logit_pos FROM mw),
mp AS (
  SELECT Episode, SentenceIndex, logit_neg, logit_neu, logit_pos,
         exp(logit_neg - greatest(logit_neg, logit_neu, logit_pos)) AS e0,
         exp(logit_neu - greatest(logit_neg, logit_neu, logit_pos)) AS e1,
         exp(logit_pos - greatest(logit_neg, logit_neu, logit_pos)) AS e2
  FROM ml),
model AS (
  SELECT Episode, SentenceIndex, logit_neg, logit_neu, logit_pos,
         e0 / (e0 + e1 + e2) AS model_neg, e1 / (e0 + e1 + e2) AS model_neu,
         e2 / (e0 + e1 + e2) AS model_pos,
         CASE WHEN logit_pos >= logit_neu AND logit_pos >= logit_neg THEN 'Positive'
              WHEN logit_neu >= logit_neg THEN 'Neutral' ELSE 'Negative' END AS model_label
  FROM mp)""".format(ws=sql_words("CleanText"), l0=sql_linear_logit("ws", 3), l1=sql_linear_logit("ws", 4),
                     l2=sql_linear_logit("ws", 5))


def sql_label(pos: str, neu: str, neg: str) -> str:
    return (f"CASE WHEN {pos} >= {neu} AND {pos} >= {neg} THEN 'Positive' "
            f"WHEN {neu} >= {neg} THEN 'Neutral' ELSE 'Negative' END")


def scored_of(prep: str) -> str:
    return f"""{prep},{lex_ctes()},{MODEL},
scored AS (
  SELECT p.Episode, p.SentenceIndex, p.CharacterCode, p.Character,
         l.lex_neg, l.lex_neu, l.lex_pos, l.lex_compound,
         m.model_neg, m.model_neu, m.model_pos,
         {sql_label('l.lex_pos', 'l.lex_neu', 'l.lex_neg')} AS lex_label,
         m.model_label
  FROM prep p JOIN lexs l ON p.Episode = l.Episode AND p.SentenceIndex = l.SentenceIndex
       JOIN model m ON p.Episode = m.Episode AND p.SentenceIndex = m.SentenceIndex)"""


SCORED = scored_of(PREP)

R6 = "round({0}, 6) AS {1}"

q("model_logits", f"""WITH {PREP},{MODEL}
SELECT Episode, SentenceIndex, round(logit_neg, 6) AS logit_neg, round(logit_neu, 6) AS logit_neu,
       round(logit_pos, 6) AS logit_pos FROM model""")

q("softmax_scores", f"""WITH {PREP},{MODEL}
SELECT Episode, SentenceIndex, round(model_neg, 6) AS model_neg, round(model_neu, 6) AS model_neu,
       round(model_pos, 6) AS model_pos FROM model""")

_NB = f"""
nbw AS MATERIALIZED (SELECT Episode, unnest({sql_words('CleanText')}) AS word FROM {{docs}}),
nbc AS (SELECT word, count(*) FILTER (WHERE Episode = '1') AS c0, count(*) FILTER (WHERE Episode = '2') AS c1,
               count(*) FILTER (WHERE Episode = '3') AS c2 FROM nbw GROUP BY word),
nbt AS (SELECT count(*) AS v, sum(c0) AS n0, sum(c1) AS n1, sum(c2) AS n2 FROM nbc),
nb AS MATERIALIZED (SELECT word, ln((c0 + 1.0::DOUBLE) / (n0 + v)) AS w0, ln((c1 + 1.0::DOUBLE) / (n1 + v)) AS w1,
                           ln((c2 + 1.0::DOUBLE) / (n2 + v)) AS w2 FROM nbc, nbt),
nbr AS (SELECT row_number() OVER () AS r, Episode, SentenceIndex, Character, {sql_words('CleanText')} AS ws FROM prep WHERE CleanText IS NOT NULL),
nbx AS (SELECT r, unnest(ws) AS word FROM nbr),
nbs AS (SELECT r, sum(w0) AS s0, sum(w1) AS s1, sum(w2) AS s2 FROM nbx JOIN nb ON nb.word = nbx.word GROUP BY r),
nbl AS (SELECT Episode, SentenceIndex, Character, {', '.join(f"CASE WHEN len(ws) > 0 THEN coalesce(s{k}, 0.0) / len(ws) ELSE 0.0::DOUBLE END AS {c}"
        for k, c in enumerate(("logit_neg", "logit_neu", "logit_pos")))} FROM nbr LEFT JOIN nbs ON nbs.r = nbr.r),
nbm AS (SELECT *, CASE WHEN logit_pos >= logit_neu AND logit_pos >= logit_neg THEN 'Positive'
                       WHEN logit_neu >= logit_neg THEN 'Neutral' ELSE 'Negative' END AS model_label FROM nbl)"""

q("weighted_logits", f"""WITH {PREP},{_NB.replace('{docs}', 'prep')}
SELECT Episode, SentenceIndex, round(logit_neg, 6) AS logit_neg, round(logit_neu, 6) AS logit_neu,
       round(logit_pos, 6) AS logit_pos, model_label FROM nbm""")

_DOCS_PREP = PREP.replace("utt AS", "dutt AS").replace("FROM utt", "FROM dutt").replace("coded", "dcoded").replace(
    "named", "dnamed").replace("toks", "dtoks").replace("prep AS", "dprep AS")

q("weighted_scores", f"""WITH {_DOCS_PREP},{prep_of(CONV, CHAR_DIM)},{_NB.replace('{docs}', 'dprep')}
SELECT Character, count(*) FILTER (WHERE model_label = 'Negative') AS model_total_neg,
       count(*) FILTER (WHERE model_label = 'Neutral') AS model_total_neu,
       count(*) FILTER (WHERE model_label = 'Positive') AS model_total_pos, count(*) AS total_count
FROM nbm GROUP BY Character""")

q("model_rejects", f"""WITH {PREP}
SELECT Episode, SentenceIndex,
       CASE WHEN CleanText IS NULL THEN 'null text' ELSE 'RuntimeError: text too long for the model' END AS reason
FROM prep WHERE CleanText IS NULL OR len({sql_words('CleanText')}) > 300""")

PLAIN = f"{UTT}, plain AS (SELECT Episode, SentenceIndex, {sql_clean('Text')} AS PlainText FROM utt)"

q("lex_valence", f"""WITH {PLAIN},{lex_ctes('plain', 'PlainText')}
SELECT Episode, SentenceIndex, pos, tl, round(v0, 6) AS valence FROM lv0 WHERE in_lex""")

q("lex_boost", f"""WITH {PLAIN},{lex_ctes('plain', 'PlainText')}
SELECT Episode, SentenceIndex, pos, tl, round(v_boost + 1e-9, 6) AS v_boost FROM bonly WHERE in_lex""")

q("lex_negate", f"""WITH {PLAIN},{lex_ctes('plain', 'PlainText')}
SELECT Episode, SentenceIndex, pos, tl, round(v_negate + 1e-9, 6) AS v_negate FROM nonly WHERE in_lex""")

q("lex_contrast", f"""WITH {PLAIN},{lex_ctes('plain', 'PlainText')}
SELECT Episode, SentenceIndex, pos, tl, factor, round(v + 1e-9, 6) AS v
FROM chain WHERE in_lex""")

q("lex_idiom", f"""WITH {PLAIN},{lex_ctes('plain', 'PlainText', idioms=True)}
SELECT Episode, SentenceIndex, pos, tl, round(v_mod + 1e-9, 6) AS v_idiom FROM chain WHERE in_lex""")

q("idiom_scores", f"""WITH {PLAIN},{lex_ctes('plain', 'PlainText', idioms=True)}
SELECT Episode, SentenceIndex, lex_compound, {sql_label('lex_pos', 'lex_neu', 'lex_neg')} AS lex_label FROM lexs""")

q("lex_punct", f"""WITH {PREP},{lex_ctes()}
SELECT Episode, SentenceIndex, round(emph, 6) AS emphasis FROM sent""")

q("lex_caps", f"""WITH {UTT},{lex_ctes('utt', 'Text')}
SELECT Episode, SentenceIndex, pos, t, capdiff AS cap_diff, round(v0, 6) AS v0, round(v_caps, 6) AS v_caps
FROM lcaps WHERE in_lex""")

q("lex_compound", f"WITH {SCORED} SELECT Episode, SentenceIndex, lex_compound FROM scored")

q("lexicon_scores", f"""WITH {PREP},{lex_ctes()}
SELECT Episode, SentenceIndex, lex_neg, lex_neu, lex_pos, lex_compound FROM lexs""")

q("major_sentiment", f"WITH {SCORED} SELECT Episode, SentenceIndex, lex_label, model_label FROM scored")

SC = ["lex_neg", "lex_neu", "lex_pos", "lex_compound", "model_neg", "model_neu", "model_pos"]

q("scored_table", f"""WITH {SCORED}
SELECT Episode, SentenceIndex, CharacterCode, Character, {', '.join(R6.format(c, c) for c in SC)},
       lex_label, model_label FROM scored""")

q("filter_sentiment", f"""WITH {SCORED}
SELECT Episode, SentenceIndex, Character, round(model_neg, 6) AS model_neg FROM scored
WHERE model_label = 'Negative'""")

q("filter_character", f"""WITH {SCORED}
SELECT Episode, SentenceIndex, lex_label, model_label FROM scored WHERE Character = 'Mara Quill'""")

# ---------------------------------------------------------------- statistics

LAB = (("Positive", "pos"), ("Neutral", "neu"), ("Negative", "neg"))
SCR = ("lex", "model")

q("sentiment_totals", f"""WITH {SCORED}
SELECT Episode, {', '.join(f"count(*) FILTER (WHERE {s}_label = '{lab}') AS {s}_total_{sh}" for s in SCR for lab, sh in LAB)},
       count(*) AS total_count
FROM scored GROUP BY Episode""")

q("sentiment_share", f"""WITH {SCORED}
SELECT Episode, {', '.join(f"round(count(*) FILTER (WHERE {s}_label = '{lab}') / count(*), 6) AS {s}_share_{sh}" for s in SCR for lab, sh in LAB)},
       count(*) AS total_count
FROM scored GROUP BY Episode""")

q("modal_sentiment", f"""WITH {SCORED},
lc AS (SELECT Episode, 'lex' AS s, lex_label AS label, count(*) AS n, min(SentenceIndex) AS f
       FROM scored GROUP BY Episode, lex_label
       UNION ALL
       SELECT Episode, 'model', model_label, count(*), min(SentenceIndex)
       FROM scored GROUP BY Episode, model_label),
rk AS (SELECT *, row_number() OVER (PARTITION BY Episode, s ORDER BY n DESC, f ASC) AS r FROM lc)
SELECT Episode, max(label) FILTER (WHERE s = 'lex') AS lex_mode, max(label) FILTER (WHERE s = 'model') AS model_mode
FROM rk WHERE r = 1 GROUP BY Episode""")

CHAR_ORDER = values([(str(i), n) for i, (_, n) in enumerate(CHARACTERS)], ["char_order", "Character"],
                    ["INTEGER", "VARCHAR"])

q("character_counts", f"""WITH {SCORED},
c AS (SELECT Episode, Character, count(*) AS n FROM scored GROUP BY Episode, Character),
g AS (SELECT e.Episode, d.char_order, d.Character FROM (SELECT DISTINCT Episode FROM c) e CROSS JOIN {CHAR_ORDER} d)
SELECT g.Episode, g.char_order, g.Character, coalesce(c.n, 0) AS total_count
FROM g LEFT JOIN c ON g.Episode = c.Episode AND g.Character = c.Character""")


_FEW = values(CHARACTERS[1:3], ["code", "name"], ["VARCHAR", "VARCHAR"])
_FEW_ORDER = values([(str(i), n) for i, (_, n) in enumerate(CHARACTERS[1:3])], ["char_order", "Character"], ["INTEGER", "VARCHAR"])

q("unknown_speakers", f"""WITH {scored_of(prep_of(CONV, _FEW))},
c AS (SELECT Character, count(*) AS n FROM scored GROUP BY Character)
SELECT 'all' AS Episode, d.char_order, coalesce(d.Character, c.Character) AS Character, coalesce(c.n, 0) AS total_count
FROM {_FEW_ORDER} d FULL JOIN c ON d.Character = c.Character""")

q("conversation_totals", f"""WITH {scored_of(prep_of(CONV, CHAR_DIM))}
SELECT Character, {', '.join(f"count(*) FILTER (WHERE {s}_label = '{lab}') AS {s}_total_{sh}" for s in SCR for lab, sh in LAB)},
       count(*) AS total_count
FROM scored GROUP BY Character""")


def stats_ctes(measures) -> str:
    fn = {"avg": "avg({x})", "median": "median({x})", "std": "stddev_samp({x})", "count": "count({x})"}
    sel, outer = [], []
    for s in SCR:
        for m in measures:
            for lab, sh in LAB:
                x = f"CASE WHEN {s}_label = '{lab}' THEN {s}_{sh} END"
                name = f"{s}_{m}_{sh}"
                sel.append(f"{fn[m].format(x=x)} AS {name}")
                if m == "count":
                    outer.append(f"coalesce(st.{name}, 0) AS {name}")
                else:
                    outer.append(f"round(st.{name}, 6) AS {name}")
    return f"""st AS (SELECT Episode, Character, {', '.join(sel)}, count(*) AS total_count
       FROM scored GROUP BY Episode, Character),
g AS (SELECT e.Episode, d.char_order, d.Character FROM (SELECT DISTINCT Episode FROM st) e CROSS JOIN {CHAR_ORDER} d),
stats AS (
  SELECT g.Episode, g.char_order, g.Character, {', '.join(outer)}, coalesce(st.total_count, 0) AS total_count
  FROM g LEFT JOIN st ON g.Episode = st.Episode AND g.Character = st.Character)"""


def sql_stats(measures) -> str:
    return f"WITH {SCORED},\n{stats_ctes(measures)}\nSELECT * FROM stats"


q("stat_count", sql_stats(("count",)))
q("stat_median", sql_stats(("median",)))
q("stat_mean", sql_stats(("avg",)))
q("stat_std", sql_stats(("std",)))
q("character_statistics", sql_stats(("avg", "median", "std", "count")))

_ALL_MEASURES = [f"{s}_{m}_{sh}" for s in SCR for m in ("avg", "median", "std", "count") for _, sh in LAB]

q("statistics_long", f"""WITH {SCORED},
{stats_ctes(("avg", "median", "std", "count"))},
wide AS (SELECT Episode, char_order, Character,
                {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _ALL_MEASURES + ['total_count'])}
         FROM stats)
SELECT Episode, char_order, Character, measure, round(value, 6) AS value
FROM wide UNPIVOT INCLUDE NULLS (value FOR measure IN ({', '.join(_ALL_MEASURES + ['total_count'])}))""")


def _describe_part(c: str) -> str:
    return (f"SELECT Episode, '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max "
            f"FROM scored GROUP BY Episode")


q("describe_scores", f"""WITH {SCORED}
{' UNION ALL '.join(_describe_part(c) for c in ["SentenceIndex", *SC])}""")

q("row_counts", f"""WITH {SCORED}
SELECT Episode, count(*) AS n_rows, 13 AS n_columns FROM scored GROUP BY Episode""")

q("last_turns", f"""WITH {CONV}
SELECT Episode, SentenceIndex, Character, Text FROM utt
QUALIFY row_number() OVER (PARTITION BY Episode, Character ORDER BY SentenceIndex DESC) = 1""")

q("duplicate_keys", f"""WITH {CONV}
SELECT Episode, Character, count(*) AS n FROM utt GROUP BY Episode, Character HAVING count(*) > 1""")


# -------------------------------------------------------------------- charts

q("chart_share", f"""WITH {SCORED},
c AS (SELECT Episode, count(*) AS total,
             count(*) FILTER (WHERE model_label = 'Positive') AS p,
             count(*) FILTER (WHERE model_label = 'Neutral') AS u,
             count(*) FILTER (WHERE model_label = 'Negative') AS g
      FROM scored GROUP BY Episode)
SELECT Episode, 0 AS label_order, 'Positive' AS label, p AS n, round(p * 100.0 / total, 1) AS percent FROM c
UNION ALL SELECT Episode, 1, 'Neutral', u, round(u * 100.0 / total, 1) FROM c
UNION ALL SELECT Episode, 2, 'Negative', g, round(g * 100.0 / total, 1) FROM c""")

q("chart_median_by_label", f"""WITH {SCORED}
SELECT Episode, Character, model_label AS label,
       round(median(CASE model_label WHEN 'Positive' THEN model_pos WHEN 'Neutral' THEN model_neu
                    ELSE model_neg END), 6) AS median
FROM scored GROUP BY Episode, Character, model_label""")


def _bars(measure: str) -> str:
    parts = [f"SELECT Episode, char_order, Character, 'model_{measure}_{sh}' AS series, "
             f"round(model_{measure}_{sh}, 3) AS value FROM stats" for _, sh in LAB]
    return f"WITH {SCORED},\n{stats_ctes((measure,))}\n" + " UNION ALL ".join(parts)


q("chart_std", _bars("std"))
q("chart_median", _bars("median"))

# ------------------------------------------------------- document and sinks

_DOC_KEYS = []
for _s, _sk in (("lex", "vader"), ("model", "roBERTa")):
    for _m, _mk in (("avg", "Average"), ("median", "Median"), ("std", "Std"), ("count", None)):
        for _lab, _sh in LAB:
            _DOC_KEYS.append((f"{_sk}{_lab}SentencesCount" if _mk is None else f"{_sk}{_mk}{_lab}",
                              f"{_s}_{_m}_{_sh}"))
_DOC_KEYS.append(("TotalSentencesCount", "total_count"))


def _doc_value(col: str) -> str:
    if "count" in col:
        return f"CAST({col} AS VARCHAR)"
    return f"coalesce(printf('%.6f', round({col}, 6)), 'nan')"


q("statistics_document", f"""WITH {SCORED},
{stats_ctes(("avg", "median", "std", "count"))},
tot AS (SELECT Episode,
               {', '.join(f"count(*) FILTER (WHERE {s}_label = '{lab}') AS {s}_total_{sh}" for s in SCR for lab, sh in LAB)}
        FROM scored GROUP BY Episode),
lc AS (SELECT Episode, 'lex' AS s, lex_label AS label, count(*) AS n, min(SentenceIndex) AS f
       FROM scored GROUP BY Episode, lex_label
       UNION ALL
       SELECT Episode, 'model', model_label, count(*), min(SentenceIndex)
       FROM scored GROUP BY Episode, model_label),
rk AS (SELECT *, row_number() OVER (PARTITION BY Episode, s ORDER BY n DESC, f ASC) AS r FROM lc),
modes AS (SELECT Episode, max(label) FILTER (WHERE s = 'lex') AS lex_mode,
                 max(label) FILTER (WHERE s = 'model') AS model_mode FROM rk WHERE r = 1 GROUP BY Episode),
ep AS (SELECT m.Episode, d.Description, d.Duration FROM modes m LEFT JOIN {EPISODE_DIM} d ON m.Episode = d.Episode)
{' UNION ALL '.join(f"SELECT Episode, 'character' AS section, Character AS name, '{k}' AS key, {_doc_value(c)} AS value FROM stats" for k, c in _DOC_KEYS)}
UNION ALL SELECT Episode, 'Details', NULL, 'Description', Description FROM ep
UNION ALL SELECT Episode, 'Details', NULL, 'Duration', Duration FROM ep
UNION ALL SELECT Episode, 'UsefulStatistics', NULL, 'roBERTaModalMajorSentiment', model_mode FROM modes
UNION ALL SELECT Episode, 'UsefulStatistics', NULL, 'VADERModalMajorSentiment', lex_mode FROM modes
{' '.join(f"UNION ALL SELECT Episode, 'UsefulStatistics', NULL, '{tk}Total{lab}Sentences', CAST({s}_total_{sh} AS VARCHAR) FROM tot" for s, tk in (("model", "roBERTa"), ("lex", "VADER")) for lab, sh in LAB)}""")

FULL = f"""{SCORED},
full_t AS (
  SELECT s.Episode, s.SentenceIndex, s.CharacterCode, s.Character,
         {', '.join(f'round(s.{c}, 6) AS {c}' for c in SC)}, s.lex_label, s.model_label,
         p.Text, p.CleanText
  FROM scored s JOIN prep p ON s.Episode = p.Episode AND s.SentenceIndex = p.SentenceIndex)"""

q("sink_csv_roundtrip", f"WITH {FULL} SELECT * FROM full_t")
q("sink_json_roundtrip", f"WITH {FULL} SELECT * FROM full_t")
q("scan_csv", f"WITH {UTT} SELECT Episode, SentenceIndex, Character, Text, CAST(length(Text) AS VARCHAR) AS n_chars FROM utt")
q("scan_episodes", f"WITH {UTT} SELECT Episode, SentenceIndex, Character, Text FROM utt")
