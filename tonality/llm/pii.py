"""Personal data: fixed patterns, and information-theoretic sanitisation of what reveals the found entities.

Base spans.  Four patterns (e-mail, IP address, card number, phone number) give the protected entities.  They are
written with possessive parts and only start where a run of their characters starts or the last match ended,
which finds the same matches without trying every position of a long run.

Added spans.  A term discloses an entity by the information that its presence gives about the entity's.  Over all
distinct texts: p(e) and p(t) are the shares of texts that hold the entity and the term, p(e, t) the share in which the
term stands within ``RADIUS`` code points of the entity.  PMI(e; t) = log2(p(e, t) / (p(e) p(t))) is at most the
entity's information IC(e) = -log2 p(e).  A term whose PMI reaches ``REMOVE`` of IC(e) for some entity is removed
wherever it occurs, one that reaches ``GENERALISE`` is replaced by its kind; both need ``SUPPORT`` texts of
co-occurrence.  Exact copies count as one text.

Everything is Spark expressions.  The counts cover the whole corpus: words are counted by a join with the terms seen
near entities, which is a broadcast only up to ``BROADCAST_ROWS`` rows, else a shuffle join.

Defined results: null text is the empty text (no spans); repeated rows get the same spans; an empty table gives no rows;
other columns pass through ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import cut

RADIUS = 64
REMOVE = 0.95
GENERALISE = 0.85
SUPPORT = 3
BROADCAST_ROWS = 1_000_000

KINDS = ("email", "ip", "card", "phone")
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# From the first to the last letter or digit of a run without white space.
_TERM = r"[\p{L}\p{N}](?:[^ \t\n\r\f]*[\p{L}\p{N}])?"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": m.rlike(rf"^{_BYTE_PART}(?:\.{_BYTE_PART}){{3}}$"),
        "card": F.length(digits).between(16, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(8, 15),
    }[kind]


def _spans(matches: Column, gaps: Column, keep) -> Column:
    """``array<struct<start, end, value>>`` of the matches that ``keep``: lengths of gaps and matches add up to places."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["match"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("value"))
        return F.struct(end.alias("at"), F.when(keep(x["match"]), F.array_append(acc["spans"], span))
                        .otherwise(acc["spans"]).alias("spans"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(F.size(matches) > 0, F.aggregate(pairs, start, step)["spans"]).otherwise(none)


def with_base(docs: DataFrame) -> DataFrame:
    """Add ``base``: array of ``struct<kind, start, end, value>`` by kind and place; ``text`` becomes non-null."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    hints = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast("array<string>")
    for kind in KINDS:
        found = F.regexp_extract_all(text, F.lit(_PATTERNS[kind]), F.lit(0))
        docs = docs.withColumn(f"__m_{kind}", F.when(hints[kind], found).otherwise(none) if kind in hints else found)
    for kind in KINDS:
        m = F.col(f"__m_{kind}")
        gaps = F.when(F.size(m) > 0, F.split(text, _PATTERNS[kind], -1)).otherwise(none)
        docs = docs.withColumn(f"__s_{kind}", _spans(m, gaps, lambda x, k=kind: _valid(k, x)))

    def named(kind: str) -> Column:
        return F.transform(f"__s_{kind}", lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return docs.withColumn("base", F.concat(*map(named, KINDS))).drop(*(f"__{x}_{k}" for k in KINDS for x in "ms"))


def _near(text: Column, s: Column) -> Column:
    """The whole runs within ``RADIUS`` code points before and after a span."""
    low = F.greatest(s["start"] - RADIUS - 1, F.lit(0))
    left = F.substring(text, low + 1, s["start"] - low)
    right = F.substring(text, s["end"] + 1, F.lit(RADIUS + 1))
    # a run cut by the window's edge is no whole run
    left = F.when(low > 0, F.regexp_replace(left, r"^[^ \t\n\r\f]+", "")).otherwise(left)
    right = F.when(F.char_length(right) > RADIUS, F.regexp_replace(right, r"[^ \t\n\r\f]+$", "")).otherwise(right)
    return F.concat(left, F.lit(" "), right)


def _terms(text: Column) -> Column:
    """Distinct terms of a text, lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))), F.lower))


def _is_term(t: Column) -> Column:
    return t.rlike(r"\p{L}") & ~F.contains(t, F.lit("@")) & ~t.rlike("[0-9]") & (F.char_length(t) >= 2)


def _sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast while its rows are proven few; the planner shuffles it otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def disclosing_terms(found: DataFrame) -> DataFrame:
    """``term, action`` (``term``: remove, ``hint``: generalise) from texts with their base spans.

    ``found``: ``th`` (the text's hash), ``text``, ``base``.
    """
    entity = F.transform("base", lambda s: F.struct(
        F.concat_ws(":", s["kind"], F.lower(F.when(s["kind"] == "email", s["value"])
                                            .otherwise(F.regexp_replace(s["value"], "[ ()-]", "")))).alias("entity"),
        _terms(_near(F.col("text"), s)).alias("near")))
    seen = cut(found.where(F.size("base") > 0).select("th", F.explode(entity).alias("e")).select("th", "e.entity", "e.near"))
    per_entity = seen.groupBy("entity").agg(F.countDistinct("th").alias("n_e")).where(F.col("n_e") >= SUPPORT)
    pairs = cut(seen.join(per_entity, "entity").select("th", "entity", "n_e", F.explode("near").alias("term"))
                .where(_is_term(F.col("term"))).groupBy("entity", "term", "n_e")
                .agg(F.countDistinct("th").alias("n_et")).where(F.col("n_et") >= SUPPORT))
    wanted = cut(pairs.select("term").distinct())
    # every text's terms, joined with the terms in question before they are counted
    n_t = (found.select("th", F.explode(_terms(F.col("text"))).alias("term")).join(_sized(wanted), "term")
           .groupBy("term").agg(F.countDistinct("th").alias("n_t")))
    n = found.select("th").distinct().count()
    information = F.log2(F.lit(float(max(n, 1))) / F.col("n_e"))
    pmi = F.log2(F.col("n_et") * F.lit(float(n)) / (F.col("n_e") * F.col("n_t")))
    share = F.max(F.when(information > 0, pmi / information))
    return (pairs.join(n_t, "term").groupBy("term").agg(share.alias("disclosure"))
            .where(F.col("disclosure") >= GENERALISE)
            .select("term", F.when(F.col("disclosure") >= REMOVE, "term").otherwise("hint").alias("action")))


def with_spans(docs: DataFrame) -> DataFrame:
    """Add ``base`` and ``added``, arrays of ``struct<kind, start, end, value>`` by kind and place."""
    found = with_base(docs).withColumn("th", F.xxhash64("text"))
    terms = cut(disclosing_terms(found.select("th", "text", "base")))
    sized = _sized(terms)
    hits = cut(found.select("th", F.explode(_terms(F.col("text"))).alias("term")).join(sized, "term")
               .groupBy("th").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("term", "action")))).alias("hits")))
    # a row of hits holds a text's terms: their total bounds the broadcast
    entries = hits.agg(F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()[0]
    found = found.join(F.broadcast(hits) if entries <= BROADCAST_ROWS else hits, "th", "left")
    has = F.col("hits").isNotNull()
    none = F.array().cast("array<string>")
    found = found.withColumn("__m", F.when(has, F.regexp_extract_all("text", F.lit(_TERM), F.lit(0))).otherwise(none))
    found = found.withColumn("__g", F.when(F.size("__m") > 0, F.split("text", _TERM, -1)).otherwise(none))
    found = found.withColumn("__t", _spans(F.col("__m"), F.col("__g"), lambda m: F.element_at("hits", F.lower(m)).isNotNull()))
    # what a base span covers is found already
    apart = F.filter("__t", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    named = F.transform(apart, lambda s: F.struct(F.element_at("hits", F.lower(s["value"])).alias("kind"), s["start"].alias("start"),
                                                  s["end"].alias("end"), s["value"].alias("value")))
    found = found.withColumn("__n", named)
    added = F.concat(F.filter("__n", lambda s: s["kind"] == "hint"), F.filter("__n", lambda s: s["kind"] == "term"))
    return found.withColumn("added", added).drop("__m", "__g", "__t", "__n", "hits", "th")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document."""
    found = with_spans(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, with every span of ``text`` replaced: base spans and removed terms by their
    kind, hints by a word's shape."""
    found = with_spans(docs.select(F.struct(*docs.columns).alias("__doc"), "text"))
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"),
        F.when(s["kind"] != "hint", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        .when(s["value"].rlike(r"^\p{Lu}"), F.lit("[Name]")).otherwise(F.lit("[word]")).alias("put"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["back"]
        new = F.struct(end.alias("at"), F.concat(
            acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["put"]).alias("out"))
        # a span that overlaps an earlier one: its rest goes too
        rest = F.struct(F.greatest(acc["at"], end).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(rest)

    found = found.withColumn("__done", F.aggregate(spans, start, step))
    done = F.concat(F.col("__done.out"), F.substring(F.col("text"), F.col("__done.at") + 1, F.char_length("text")))
    text = F.when(F.size("base") + F.size("added") > 0, done).otherwise(F.col("__doc.text"))
    return found.select(F.col("__doc").withField("text", text).alias("__doc")).select("__doc.*")
