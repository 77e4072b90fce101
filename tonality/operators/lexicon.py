"""Lexicon-and-rules sentiment scorer (valence lexicon, boosters, negation, "but" contrast, punctuation and
capital-letter emphasis), computed inside each row.

1. ``_sentence``: white-space split, punctuation stripped from the ends, tokens of length 1 dropped, and the
   sentence's facts (item count, first contrast word, "!" / "?" emphasis, mixed capitals).
2. ``_tags``: every item gets its lexicon valence, its booster's delta and whether it negates, as three arrays beside the items.
   Tables of proven small size are hash tables inside an expression (``functions.lookup``); if one of them is larger, all three
   are put into one table and joined once on the exploded items of numbered rows.  Both give the same tags.
   With a table of idioms, ``_phrases`` tags every place with the valence of the two or three items that start there.
3. ``_chain``: the rules run over the lexicon items, kept as an array of places and one of valences, and look at an item's
   neighbours by their places.  An item without a modifier near it skips them.
4. ``lexicon_scores`` folds the items' valences.  No shuffle, and rows with equal keys stay apart, so that every
   ratio is at most 1.

Texts of ASCII only (all cleaned text in Latin letters) go through the same steps by Arrow batches (``operators.batches``) where the
tables are proven small and the rule has a form for batches; steps 1 to 4 take the other texts.

A lexicon can also carry a *rule*: a Column function ``token -> valence`` (NULL where it does not apply) for tokens
that the lexicon table does not have.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.functions.labels import major_sentiment
from tonality.functions.lookup import hashed_lookup, let
from tonality.functions.text import ASCII_PUNCT_CLASS
from tonality.operators.batches import IS_LOW, Items, Known, ascii_or, items_by_batch, sums_by_batch
from tonality.resources import (BOOST_DISTANCE_DAMP, BOOST_INCREMENT, BUT_AFTER, BUT_BEFORE, CAPS_INCREMENT,
                                COMPOUND_ALPHA, CONTRAST_WORDS, EXCLAIM_MAX, EXCLAIM_WEIGHT, NEGATION_MARK,
                                NEGATION_SCALAR, NEVER_SO_SCALAR, QUESTION_CAP, QUESTION_WEIGHT)
from tonality.session import is_small, materialize

PUNCT_EDGES = f"^{ASCII_PUNCT_CLASS}+|{ASCII_PUNCT_CLASS}+$"
SPLIT_BLANKS = r"[ \t\n\r\f]+"
SCORE_COLS = ("lex_neg", "lex_neu", "lex_pos", "lex_compound")
INLINE_MAX_WORDS = 20_000

Rule = Callable[[Column], Column]


@dataclass(frozen=True)
class BatchRule:
    """A rule with a second form, over the items of a batch (NaN where it does not apply)."""

    column: Rule
    batch: Callable[[Items], np.ndarray]

    def __call__(self, token: Column) -> Column:
        return self.column(token)


@dataclass(frozen=True)
class Rules:
    """What the scorer knows: ``lexicon(token, valence)``, ``boosters(token, delta)``, ``negators(token)``, contrast words,
    an optional rule for words that the lexicon lacks, and optional ``idioms(phrase, valence)``.

    Idioms are phrases of two or three items.  With idioms given, boosters of two words dampen the item after them.
    """

    lexicon: DataFrame | None
    boosters: DataFrame
    negators: DataFrame
    rule: Rule | None = None
    contrast: tuple[str, ...] = CONTRAST_WORDS
    idioms: DataFrame | None = None


def _generated_valence(token: Column) -> Column:
    return F.when(token.rlike("^[a-z]{3,}$"),
                  ((F.ascii(token) + F.length(token)) % 9 - 4) * F.lit(0.5))


def _generated_valences(x: Items) -> np.ndarray:
    word = (x.length >= 3) & (x.count(IS_LOW, x.low) == x.length)
    return np.where(word, ((x.low[x.start].astype(np.int64) + x.length) % 9 - 4) * 0.5, np.nan)


#: Fixture rule lexicon for volume tests: every word of >= 3 ASCII letters gets ``((ascii(w) + length(w)) % 9 - 4) * 0.5``
#: (NULL otherwise).
generated_valence = BatchRule(_generated_valence, _generated_valences)


# Punctuation at the start or end of a whitespace-separated token, matched over
# the whole text at once (one regex pass per sentence, not one per token).
PUNCT_TOKEN_EDGES = (rf"(?={ASCII_PUNCT_CLASS})(?:(?<=^|[ \t\n\r\f]){ASCII_PUNCT_CLASS}+"
                     rf"|{ASCII_PUNCT_CLASS}+(?=[ \t\n\r\f]|$))")


def sentiment_items(text: Column) -> Column:
    """Whitespace tokens with edge punctuation stripped; tokens shorter than 2 dropped."""
    stripped = F.regexp_replace(F.coalesce(text, F.lit("")), PUNCT_TOKEN_EDGES, "")
    return F.filter(F.split(stripped, SPLIT_BLANKS), lambda w: F.length(w) > 1)


def _is_upper(w: Column) -> Column:
    return (F.upper(w) == w) & (F.lower(w) != w)


def _count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def punctuation_emphasis(text: Column) -> Column:
    """'!' adds 0.292 each (at most 4); 2-3 '?' add 0.18 each, more add 0.96."""
    t = F.coalesce(text, F.lit(""))
    ep = F.least(_count_char(t, "!"), F.lit(EXCLAIM_MAX)) * F.lit(EXCLAIM_WEIGHT)
    qm = _count_char(t, "?")
    qa = (F.when(qm > 3, F.lit(QUESTION_CAP))
          .when(qm > 1, qm * F.lit(QUESTION_WEIGHT)).otherwise(F.lit(0.0)))
    return ep + qa


def _small_rows(df: DataFrame, value: str) -> dict[str, float] | None:
    """``{token: largest value}`` of a table proven small, else None."""
    own = df.groupBy(F.lower("token").alias("token")).agg(F.max(value).alias("v")).where("token IS NOT NULL AND v IS NOT NULL")
    return {r["token"]: float(r["v"]) for r in own.orderBy("token").collect()} if is_small(own, INLINE_MAX_WORDS) else None


@dataclass(frozen=True)
class Tables:
    """The rules' tables as plain values, each None unless proven small; ``idioms`` and ``damps`` are empty without idioms."""

    valences: dict[str, float] | None
    deltas: dict[str, float] | None
    negators: dict[str, float] | None
    idioms: dict[str, float] | None
    damps: dict[str, float] | None


def _phrase_tables(rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Idioms and boosters of two words, ``token`` with single blanks."""
    plain = F.array_join(F.split(F.trim(F.col("phrase")), SPLIT_BLANKS), " ")
    return (rules.idioms.select(plain.alias("token"), "valence"),
            rules.boosters.select(F.col("token").alias("phrase"), "delta").select(plain.alias("token"), "delta").where("token LIKE '% %'"))


def _tables(rules: Rules) -> Tables:
    idioms, damps = _phrase_tables(rules) if rules.idioms is not None else (None, None)
    return Tables(_small_rows(rules.lexicon, "valence") if rules.lexicon is not None else {}, _small_rows(rules.boosters, "delta"),
                  _small_rows(rules.negators.withColumn("one", F.lit(1.0)), "one"),
                  _small_rows(idioms, "valence") if idioms is not None else {}, _small_rows(damps, "delta") if damps is not None else {})


def _known(rules: Rules, tables: Tables) -> Known | None:
    """What the form by batches needs, None where it cannot take the rules."""
    small = all(t is not None for t in (tables.valences, tables.deltas, tables.negators, tables.idioms, tables.damps))
    if not small or not (rules.rule is None or isinstance(rules.rule, BatchRule)):
        return None
    phrases = (tables.idioms, tables.damps) if rules.idioms is not None else (None, None)
    return Known(tables.valences, tables.deltas, sorted(tables.negators), rules.contrast, rules.rule.batch if rules.rule else None, *phrases)


#: From the lower-case items of a text: arrays of their valences, deltas and whether they negate.
Tags = Callable[[Column], tuple[Column, Column, Column]]


def _marked(t: Column) -> Column:
    return F.contains(t, F.lit(NEGATION_MARK))


def _tagged(df: DataFrame, lexicon: DataFrame | None, boosters: DataFrame, negators: DataFrame, text_col: str) -> tuple[DataFrame, Tags]:
    """Append ``_tags``, an array of ``struct<v, b, g>`` by an item's place, by one join on the items of numbered rows."""
    def part(rows: DataFrame, value: Column, name: str) -> DataFrame:
        own = {"v": "double", "b": "double", "g": "boolean"}
        return rows.select(F.lower("token").alias("_t"), *[
            (value if k == name else F.lit(None)).cast(kind).alias(k) for k, kind in own.items()]).where(f"_t IS NOT NULL AND {name} IS NOT NULL")

    known = part(boosters, F.col("delta"), "b").unionByName(part(negators, F.lit(True), "g"))
    if lexicon is not None:
        known = known.unionByName(part(lexicon, F.col("valence"), "v"))
    words = known.groupBy("_t").agg(F.struct(F.max("v").alias("v"), F.max("b").alias("b"), F.max("g").alias("g")).alias("_k"))
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))  # the numbers must not change again
    low = F.transform(sentiment_items(F.col(text_col)), lambda w: F.lower(w))
    out = _placed(rows, rows.select("_row", F.posexplode(low).alias("_p", "_t")).join(words, "_t"),
                  "struct<v:double,b:double,g:boolean>", "_tags")
    tags = F.col("_tags")
    return out, lambda low: (tags["v"], tags["b"], F.transform(low, lambda t, i: F.coalesce(F.get(tags["g"], i), F.lit(False)) | _marked(t)))


def _placed(rows: DataFrame, hits: DataFrame, kind: str, name: str) -> DataFrame:
    """Numbered ``rows`` with an array ``name`` of the ``hits`` (``_row, _p, _k``) by their places, NULL between them."""
    listed = hits.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_p", "_k"))).alias("_h"))
    none = F.lit(None).cast(kind)
    gap = lambda h, i: h["_p"] - F.coalesce(F.get("_h", i - 1)["_p"], F.lit(-1)) - 1
    dense = F.flatten(F.transform("_h", lambda h, i: F.concat(F.array_repeat(none, gap(h, i)), F.array(h["_k"]))))
    return rows.join(listed.select("_row", dense.alias(name)), "_row", "left").drop("_row")


def _gram(low: Column, i: Column, t: Column, n: int) -> Column:
    """The ``n`` items from place ``i`` on, NULL where the text ends before."""
    return F.concat(t, *[x for k in range(1, n) for x in (F.lit(" "), F.get(low, i + k))])


def _phrases(df: DataFrame, rules: Rules, text_col: str, tables: Tables | None = None) -> tuple[DataFrame, Tags | None]:
    """``df``, with a column for the phrases where a table is not proven small, and for the items of a text the valences of
    the two and of the three items that start at each place, and whether two of them are a booster."""
    if rules.idioms is None:
        return df, None
    idioms, damps = _phrase_tables(rules)
    tables = tables or _tables(rules)
    known, steps = tables.idioms, tables.damps
    if known is not None and steps is not None:
        valence, delta = hashed_lookup(known), hashed_lookup(steps)
        return df, lambda low: (F.transform(low, lambda t, i: valence(_gram(low, i, t, 2))),
                                F.transform(low, lambda t, i: valence(_gram(low, i, t, 3))),
                                F.transform(low, lambda t, i: delta(_gram(low, i, t, 2)).isNotNull()))
    none = F.lit(None)
    table = (idioms.select(F.lower("token").alias("_t"), F.col("valence").cast("double").alias("v"), none.cast("boolean").alias("d"))
             .unionByName(damps.where("delta IS NOT NULL").select(F.lower("token").alias("_t"), none.cast("double").alias("v"), F.lit(True).alias("d")))
             .where("_t IS NOT NULL").groupBy("_t").agg(F.max("v").alias("v"), F.max("d").alias("d")))
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))  # the numbers must not change again
    low = F.transform(sentiment_items(F.col(text_col)), lambda w: F.lower(w))

    def grams(x: Column, n: int) -> Column:
        return F.transform(x, lambda t, i: F.struct(i.alias("_p"), F.lit(n).alias("n"), _gram(x, i, t, n).alias("_t")))

    two, three = F.col("n") == 2, F.col("n") == 3
    hits = (rows.select("_row", F.explode(let(low, lambda x: F.concat(grams(x, 2), grams(x, 3)))).alias("g")).select("_row", "g.*").join(table, "_t").groupBy("_row", "_p")
            .agg(F.struct(F.max(F.when(two, F.col("v"))).alias("p2"), F.max(F.when(three, F.col("v"))).alias("p3"),
                          F.max(F.when(two, F.col("d"))).alias("d2")).alias("_k")))
    out = _placed(rows, hits, "struct<p2:double,p3:double,d2:boolean>", "_phrases")
    at = F.col("_phrases")
    return out, lambda low: (at["p2"], at["p3"], F.transform(low, lambda t, i: F.coalesce(F.get(at["d2"], i), F.lit(False))))


#: Words of a scorer's tables that one look at a text may compare with all its items.
PLAIN_MAX_WORDS = 2_000
#: Words that the rules themselves name.
RULE_WORDS = ("kind", "least", "never")


def _tags(df: DataFrame, rules: Rules, text_col: str, tables: Tables | None = None) -> tuple[DataFrame, Tags, list[str]]:
    """``df``, with a column for the tags where a table is not proven small, the tags of a text's items, and the words without which
    a text has no tags and no rule but the lexicon's acts on it (none where they are too many)."""
    tables = tables or _tables(rules)
    valences, deltas, negators = tables.valences, tables.deltas, tables.negators
    if valences is None or deltas is None or negators is None:
        return *_tagged(df, rules.lexicon, rules.boosters, rules.negators, text_col), []
    valence, delta, nots = hashed_lookup(valences), hashed_lookup(deltas), sorted(negators)

    def negates(t: Column) -> Column:
        return (t.isin(nots) | _marked(t)) if nots else _marked(t)

    words = sorted({*valences, *deltas, *nots, *RULE_WORDS})
    return (df, lambda low: (F.transform(low, valence), F.transform(low, delta), F.transform(low, negates)),
            words if len(words) <= PLAIN_MAX_WORDS else [])


def _sentence(text: Column, rules: Rules, tags: Tags, words: list[str], phrases: Tags | None) -> Column:
    """``struct<items, low, plain, val, boost, neg, n, emph, but, capdiff>`` of a text, and ``p2, p3, d2`` with idioms.

    ``plain`` texts hold none of ``words`` and no negation mark; their ``val``, ``boost`` and ``neg`` are left empty.
    """
    # the capital-letter rules need a mix of all-caps and other items; a text without upper-case letters (all
    # cleaned text) skips the test of each item
    has_upper = F.coalesce(text.rlike("[A-Z]"), F.lit(False))

    def facts(x: Column) -> Column:
        places = [F.nullif(F.array_position(x["low"], w), F.lit(0)) for w in rules.contrast]
        first = F.least(*places) if len(places) > 1 else places[0] if places else F.lit(None).cast("long")
        mixed = F.exists(x["items"], _is_upper) & F.exists(x["items"], lambda w: ~_is_upper(w))
        val, boost, neg = (F.when(x["plain"], F.array().cast(f"array<{kind}>")).otherwise(tag) if words else tag
                           for tag, kind in zip(tags(x["low"]), ("double", "double", "boolean")))
        named = [c.alias(k) for k, c in zip(("p2", "p3", "d2"), phrases(x["low"]))] if phrases else []
        return F.struct(*named, x["items"].alias("items"), x["low"].alias("low"), x["plain"].alias("plain"), val.alias("val"), boost.alias("boost"), neg.alias("neg"),
                        F.size(x["items"]).alias("n"), x["emph"].alias("emph"), F.coalesce(first, F.lit(0)).alias("but"),
                        F.when(x["upper"], mixed).otherwise(F.lit(False)).alias("capdiff"))

    def looked_at(x: Column) -> Column:
        plain = ~F.arrays_overlap(x["low"], F.lit(words)) & ~_marked(F.lower(text)) if words else F.lit(False)
        return F.struct(*[x[c].alias(c) for c in ("items", "low", "emph", "upper")], F.coalesce(plain, F.lit(False)).alias("plain"))

    return let(let(let(sentiment_items(text), lambda items: F.struct(
        items.alias("items"), F.when(F.lower(text) == text, items).otherwise(F.transform(items, lambda w: F.lower(w))).alias("low"),
        punctuation_emphasis(text).alias("emph"),
        has_upper.alias("upper"))), looked_at), facts)


def _chain(rules: Rules, steps: Sequence[str], scores: bool = False) -> Callable[[Column], Column]:
    """From a sentence to ``struct<pos, v0, caps, v>`` of its lexicon items, each an array: their places, their valences, those with
    emphasis by capitals, and those after ``steps``: ``boost``, ``negate``, ``modify`` (both, by distance, then "least") and
    ``contrast``.  For ``scores`` the last array only."""
    Rule3 = Callable[[Column, Column, Column], Column]  # of sentence, item's place and valence

    def valences(x: Column) -> Column:
        """Of every item, NULL for those that are no lexicon items."""
        def item(t: Column, i: Column) -> Column:
            known = F.get(x["val"], i)
            if rules.rule is not None:
                known = F.coalesce(known, F.when(~F.get(x["neg"], i) & ~t.isin("least", "never"), rules.rule(t)))
            skip = F.get(x["boost"], i).isNotNull() | ((t == "kind") & F.get(x["low"], i + 1).eqNullSafe(F.lit("of")))
            return F.when(~skip, known)

        ruled = rules.rule if rules.rule is not None else lambda t: F.lit(None).cast("double")
        return F.when(x["plain"], F.transform(x["low"], lambda t: ruled(t).cast("double"))).otherwise(F.transform(x["low"], item))

    def free(x: Column, i: Column) -> Column:
        """A predecessor that is itself a lexicon word does not modify."""
        return (i >= 0) & F.get(x["val"], i).isNull()

    def boosted(d: int) -> Rule3:
        def rule(x: Column, p: Column, v: Column) -> Column:
            i = p - d
            b = F.get(x["boost"], i)
            s = F.when(v < 0, -b).otherwise(b)
            up = x["capdiff"] & F.coalesce(_is_upper(F.get(x["items"], i)), F.lit(False))
            s = F.when(up, F.when(v > 0, s + CAPS_INCREMENT).otherwise(s - CAPS_INCREMENT)).otherwise(s)
            return F.when(b.isNotNull() & free(x, i), v + s * F.lit(BOOST_DISTANCE_DAMP[d - 1])).otherwise(v)
        return rule

    def negated(d: int) -> Rule3:
        def rule(x: Column, p: Column, v: Column) -> Column:
            i = p - d
            turned = F.when(F.coalesce(F.get(x["neg"], i), F.lit(False)) & free(x, i), v * NEGATION_SCALAR).otherwise(v)
            if d == 1:
                return turned
            # "never" with "so" or "this" between it and the item
            so = F.lit(False)
            for k in range(1, d):
                so = so | F.coalesce(F.get(x["low"], p - k).isin("so", "this"), F.lit(False))
            return F.when(F.coalesce(F.get(x["low"], i) == "never", F.lit(False)) & free(x, i) & so, v * NEVER_SO_SCALAR[d - 2]).otherwise(turned)
        return rule

    def least(x: Column, p: Column, v: Column) -> Column:
        i = p - 1
        return F.when(F.coalesce(F.get(x["low"], i) == "least", F.lit(False)) & free(x, i)
                      & ~F.coalesce(F.get(x["low"], i - 1).isin("at", "very"), F.lit(False)), v * NEGATION_SCALAR).otherwise(v)

    def idiom(x: Column, p: Column, v: Column) -> Column:
        """A phrase that holds the item or ends before it gives its valence, one that starts with the item before all others;
        a booster of two words before the item dampens.  As published, only if a third predecessor could modify."""
        at = lambda name, k: F.get(x[name], p + k)
        said = F.coalesce(at("p3", 0), at("p2", 0), at("p2", -1), at("p3", -2), at("p2", -2), at("p3", -3), at("p2", -3), v)
        damped = F.coalesce(at("d2", -3), F.lit(False)) | F.coalesce(at("d2", -2), F.lit(False))
        return F.when(free(x, p - 3), F.when(damped, said - BOOST_INCREMENT).otherwise(said)).otherwise(v)

    idioms = [idiom] if rules.idioms is not None else []
    modifiers: list[Rule3] = []
    for step in steps:
        modifiers += {"boost": [boosted(d) for d in (1, 2, 3)], "negate": [negated(d) for d in (1, 2, 3)],
                      "modify": [f(d) for d in (1, 2, 3) for f in (boosted, negated)] + idioms + [least], "contrast": []}[step]

    reach = range(0 if idioms else 1, 4)  # places before an item, from its own on where phrases may start with it

    def modifies(x: Column) -> Column:
        """Of every place, whether a modifier or a phrase stands or starts there."""
        def at(t: Column, i: Column) -> Column:
            own = F.get(x["boost"], i).isNotNull() | F.get(x["neg"], i) | t.isin("least", "never")
            if idioms:
                own = own | F.get(x["p2"], i).isNotNull() | F.get(x["p3"], i).isNotNull() | F.get(x["d2"], i)
            return F.coalesce(own, F.lit(False))

        return F.transform(x["low"], at)

    def modified(x: Column, pos: Column, caps: Column) -> Column:
        def ruled(p: Column, v: Column, left: list[Rule3]) -> Column:
            return let(left[0](x, p, v), lambda w: ruled(p, w, left[1:])) if left else v

        def steps_of(marks: Column) -> Column:
            def near(p: Column) -> Column:
                found = F.lit(False)
                for d in reach:
                    found = found | F.coalesce(F.get(marks, p - d), F.lit(False))
                return found

            return F.when(F.exists(marks, lambda m: m), F.zip_with(
                pos, caps, lambda p, v: F.when(near(p), ruled(p, v, modifiers)).otherwise(v))).otherwise(caps)

        found = let(modifies(x), steps_of)
        return found if idioms else F.when(x["plain"], caps).otherwise(found)

    def run(x: Column) -> Column:
        def placed(own: Column) -> Column:
            pos = F.filter(F.transform(own, lambda v, i: i), lambda i: F.get(own, i).isNotNull())
            return F.struct(pos.alias("pos"), F.filter(own, lambda v: v.isNotNull()).alias("v0"))

        def emphasised(y: Column) -> Column:
            def up(p: Column, v: Column) -> Column:
                return F.when(_is_upper(F.get(x["items"], p)), F.when(v > 0, v + CAPS_INCREMENT).otherwise(v - CAPS_INCREMENT)).otherwise(v)

            caps = F.when(x["capdiff"], F.zip_with(y["pos"], y["v0"], up)).otherwise(y["v0"])
            return F.struct(y["pos"].alias("pos"), y["v0"].alias("v0"), caps.alias("caps"))

        def finished(y: Column) -> Column:
            v = modified(x, y["pos"], y["caps"]) if modifiers else y["caps"]
            if "contrast" in steps:
                v = let(v, lambda v: F.when(x["but"] > 0, F.zip_with(
                    y["pos"], v, lambda p, w: w * contrast_factor(p, x["but"]))).otherwise(v))
            return F.struct(*[y[c].alias(c) for c in ("pos", "v0", "caps")], v.alias("v"))

        if not scores:
            return let(let(let(valences(x), placed), emphasised), finished)
        bare = x["plain"] & ~x["capdiff"] & (x["but"] == 0) if not idioms else F.lit(False)
        return let(valences(x), lambda own: F.when(bare, F.filter(own, lambda v: v.isNotNull())).otherwise(
            let(let(placed(own), emphasised), finished)["v"]))

    return run


def contrast_factor(pos: Column, but: Column) -> Column:
    """0.5 before the first contrast word (``but``: its place from 1, or 0), 1.5 after it, 1 elsewhere."""
    return (F.when((but > 0) & (pos < but - 1), F.lit(BUT_BEFORE))
            .when((but > 0) & (pos > but - 1), F.lit(BUT_AFTER)).otherwise(F.lit(1.0)))


def lexicon_items(df: DataFrame, rules: Rules, text_col: str = "CleanText", keys: Sequence[str] = ("Episode", "SentenceIndex"),
                  steps: Sequence[str] = ("modify", "contrast")) -> DataFrame:
    """One row for each lexicon item: ``keys, pos, t, tl, cap_diff, factor, v0, v_caps, v``."""
    tables = _tables(rules)
    df, tags, words = _tags(df, rules, text_col, tables)
    df, phrases = _phrases(df, rules, text_col, tables)
    run = _chain(rules, steps)

    def rows(x: Column) -> Column:
        return let(run(x), lambda y: F.transform(y["pos"], lambda p, i: F.struct(
            p.alias("pos"), F.get(x["items"], p).alias("t"), F.get(x["low"], p).alias("tl"), x["capdiff"].alias("cap_diff"),
            contrast_factor(p, x["but"]).alias("factor"), F.get(y["v0"], i).alias("v0"), F.get(y["caps"], i).alias("v_caps"),
            F.get(y["v"], i).alias("v"))))

    text = F.col(text_col)
    listed, known = let(_sentence(text, rules, tags, words, phrases), rows), _known(rules, tables)
    if known is not None:
        listed = ascii_or(text, items_by_batch(known, steps), listed)
    return df.select(*keys, F.explode(listed).alias("x")).select(*keys, "x.*")


def lexicon_scores(df: DataFrame, rules: Rules, text_col: str = "CleanText", neutral_when_empty: bool = False) -> DataFrame:
    """Append ``lex_neg, lex_neu, lex_pos, lex_compound`` and ``lex_label``; all columns and rows of ``df`` stay.

    The score is one expression that reads the text once, so that a filter on a score or label repeats it once at most.
    """
    columns, tables, steps = df.columns, _tables(rules), ("modify", "contrast")
    df, tags, words = _tags(df, rules, text_col, tables)
    df, phrases = _phrases(df, rules, text_col, tables)
    run = _chain(rules, steps, scores=True)

    def sums(x: Column, v: Column) -> Column:
        """Folds of numbers, one for each sum: a fold of a struct would make one for each item."""
        def fold(part: Callable[[Column], Column]) -> Column:
            return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + part(x))

        return F.struct(x["n"].alias("n"), x["emph"].alias("emph"), fold(lambda x: x).alias("s"), fold(lambda x: F.when(x > 0, x + 1.0).otherwise(0.0)).alias("ps"),
                        fold(lambda x: F.when(x < 0, x - 1.0).otherwise(0.0)).alias("ns"),
                        F.size(F.filter(v, lambda x: x != 0)).alias("toned"))

    def emphasised(a: Column) -> Column:
        e, s, ps, ns = a["emph"], a["s"], a["ps"], a["ns"]
        return F.struct(a["n"].alias("n"), F.when(s > 0, s + e).when(s < 0, s - e).otherwise(s).alias("s"),
                        F.when(ps > F.abs(ns), ps + e).otherwise(ps).alias("ps"),
                        F.when(ps < F.abs(ns), ns - e).otherwise(ns).alias("ns"),
                        (a["n"] - a["toned"]).cast("double").alias("neu"))

    def finished(a: Column) -> Column:
        total = a["ps"] + F.abs(a["ns"]) + a["neu"]
        comp = a["s"] / F.sqrt(a["s"] * a["s"] + F.lit(COMPOUND_ALPHA))
        has = a["n"] > 0
        return F.struct(
            F.when(has, F.round(F.abs(a["ns"] / total), 3)).otherwise(0.0).alias("lex_neg"),
            F.when(has, F.round(F.abs(a["neu"] / total), 3)).otherwise(1.0 if neutral_when_empty else 0.0).alias("lex_neu"),
            F.when(has, F.round(F.abs(a["ps"] / total), 3)).otherwise(0.0).alias("lex_pos"),
            F.when(has, F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), comp)), 4)).otherwise(0.0).alias("lex_compound"))

    def labelled(a: Column) -> Column:
        return F.struct(*[a[c].alias(c) for c in SCORE_COLS],
                        major_sentiment(a["lex_pos"], a["lex_neu"], a["lex_neg"]).alias("lex_label"))

    text = F.col(text_col)
    folded = let(_sentence(text, rules, tags, words, phrases), lambda x: let(run(x), lambda v: sums(x, v)))
    known = _known(rules, tables)
    if known is not None:
        folded = ascii_or(text, sums_by_batch(known, steps), folded)
    out = df.withColumn("_lex", let(let(let(folded, emphasised), finished), labelled))
    return out.select(*columns, *[F.col(f"_lex.{c}").alias(c) for c in (*SCORE_COLS, "lex_label")])
