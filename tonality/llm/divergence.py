"""Source divergence audit by duplicate-text collapse.

Identical texts of a language are one row with the multiplicity of each source (``collapsed``); only that row is cut into
terms, and each task adds up its texts' terms.  Counts are its occurrences, and document frequencies its terms, times the multiplicities, so both equal those over
all documents.  Each language keeps the V terms that at least ``MIN_DOCS`` of its documents hold.

With N the occurrences of kept terms in a group, a term that occurs ``count`` times there has ``p = 1 + floor(10^9 (count + 1) /
(N + V))``, and ``f(p, q) = floor((p - q)^2 / q)``.  All numbers are integers.

A pair's value sums f over all kept terms, but only terms that occur are looked at.  With ``p0`` for a term that does not
occur, the sum over a source's and its partner's terms is

    V f(p0, q0) + sum over the source's terms of (f(p, q0) - f(p0, q0)) + sum over the partner's of (f(p0, q) - f(p0, q0))
    + sum over their common terms of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).

The first two sums depend on a term's count alone, so they go over each source's distinct counts.  The last one meets
only sources that share a term: pairs within a term's list of sources, summed up in each task.  Texts are shuffled once, after equal
ones of a task have been put together.

Defined results: null text, lang or source is read as ''; a group whose documents have no terms takes part with N = 0; a language
without kept terms has pair values of 0 and no term rows; a language with one source has no pairs; an empty table gives no rows;
repeated rows count as often as they are there; other columns are ignored.  Sums beyond a long fail the job (none does below
N + V = 10^9 for each language and source, as the sum of p is at most 10^9 + V).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonality.llm.common import cut
from tonality.session import sized_broadcast

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term's bytes stay, capital letters become small, all others blanks.
BYTES = bytes(b if b >= 0x80 or chr(b) in LOWER else ord(chr(b).lower()) if chr(b) in UPPER else 0x20 for b in range(256))
ENTRIES = 500_000   # terms of sources that a task holds before it passes them on
DOC_BITS = 50


def collapsed(docs: DataFrame) -> DataFrame:
    """``lang, text, by_source``: each text of a language once, with ``array<struct<source, n>>``.

    A text's copies are counted by a digest of it (SHA-256); of the texts themselves each task passes on one of each.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    keyed = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = keyed.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    copies = keyed.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    by_source = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("by_source"))
    return texts.join(by_source, ["lang", "digest"]).drop("digest")


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, count, docs`` of the texts of a task, equal keys put together as long as ``ENTRIES`` suffice.

    UTF-8 bytes other than letters of ASCII and parts of other characters become blanks, at which the text is split.
    """
    found: dict[tuple[str, str], dict[bytes, int]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in found.items():
            both = list(terms.values())
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(list(terms), pa.binary()).cast(pa.string(), safe=False),
                pa.array([v >> DOC_BITS for v in both], pa.int64()), pa.array([v & (1 << DOC_BITS) - 1 for v in both], pa.int64())],
                ["lang", "source", "term", "count", "docs"])

    for batch in batches:
        langs, lists, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("lang", "by_source", "bytes"))
        for i in range(len(batch)):
            own, lang = Counter(texts[i].as_py().translate(BYTES).split()), langs[i].as_py()
            for copies in lists[i].as_py():
                n, terms = copies["n"], found.setdefault((lang, copies["source"]), {})
                for term, k in own.items():
                    # occurrences and documents of a term in one number
                    terms[term] = terms.get(term, 0) + ((k * n) << DOC_BITS) + n
            if sum(map(len, found.values())) > ENTRIES:
                yield from rows()
                found = {}
    yield from rows()


def kept_terms(texts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, total, entries``: the terms in at least ``min_docs`` documents of a language, with their occurrences there and
    in each source, ``array<struct<source, count>>``."""
    counted = texts.select("lang", "by_source", F.col("text").cast("binary").alias("bytes")).mapInArrow(
        count_terms, "lang string, source string, term string, count long, docs long")
    # counted in every task already: one shuffle by term serves both sums
    counts = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    return counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("count").alias("total"),
        F.collect_list(F.struct("source", "count")).alias("entries")).where(F.col("docs") >= min_docs).drop("docs")


def _share(count: Column, n: Column, v: Column) -> Column:
    """p; in decimals, as a thousand million times a count may exceed a long."""
    part = F.call_function("div", (count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)"),
                           F.nullif((n + v).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")))
    return 1 + part.cast("long")


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: parts ``pair`` (all other sources of the language) and ``term`` (the ``top_terms`` terms
    that a source has more of than its language)."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = cut(kept_terms(collapsed(docs), min_docs))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    entries = kept.select("lang", "term", "total", F.inline("entries"))
    sums = entries.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    # one row for each source of a language, and its p0
    groups = cut(named.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "n_lang", "n"]).withColumn(
        "p0", _share(F.lit(0), F.col("n"), F.col("v"))))
    rated = cut(entries.join(sized_broadcast(groups), ["lang", "source"]).select(
        "lang", "source", "term", "count", "p0", _share(F.col("count"), F.col("n"), F.col("v")).alias("p"),
        _share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q")))
    return pairs(groups, rated).unionByName(terms(rated, top_terms))


def pairs(groups: DataFrame, rated: DataFrame) -> DataFrame:
    """Part ``pair``; its rows are all pairs of sources of a language."""
    a = groups.select("lang", "source", "v", "p0")
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = a.join(sized_broadcast(b), "lang").where("source <> item")
    zero = _f(F.col("p0"), F.col("q0"))
    # distinct counts of a source: at most the square root of twice its occurrences
    counts = rated.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    own = both.join(counts, ["lang", "source"]).select("lang", "source", "item", (F.col("terms") * (_f(F.col("p"), F.col("q0")) - zero)).alias("s"))
    theirs = both.join(counts.withColumnRenamed("source", "item"), ["lang", "item"]).select(
        "lang", "source", "item", (F.col("terms") * (_f(F.col("p0"), F.col("p")) - zero)).alias("s"))
    lists = rated.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("own"))

    def more(x: Column, y: Column) -> Column:
        return _f(x["p"], y["p"]) - _f(x["p"], y["p0"]) - _f(x["p0"], y["p"]) + _f(x["p0"], y["p0"])

    # each two sources of a term once, with what it adds in both directions
    met = F.flatten(F.transform("own", lambda x, i: F.transform(
        F.slice("own", i + 2, F.size("own")), lambda y: F.struct(x["source"].alias("x"), y["source"].alias("y"), more(x, y).alias("xy"), more(y, x).alias("yx")))))
    shared = lists.select("lang", F.inline(met)).groupBy("lang", "x", "y").agg(F.sum("xy").alias("xy"), F.sum("yx").alias("yx"))
    common = shared.select("lang", F.inline(F.array(
        F.struct(F.col("x").alias("source"), F.col("y").alias("item"), F.col("xy").alias("s")),
        F.struct(F.col("y").alias("source"), F.col("x").alias("item"), F.col("yx").alias("s")))))
    base = both.select("lang", "source", "item", F.coalesce(F.col("v") * zero, F.lit(0)).alias("s"))
    values = base.unionByName(own).unionByName(theirs).unionByName(common).groupBy("lang", "source", "item").agg(F.sum("s").alias("value"))
    return _ranked(values, "pair")


def terms(rated: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """Part ``term``."""
    more = rated.where("count > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    return _ranked(more, "term").where(F.col("rank") <= top)


def _ranked(values: DataFrame, part: str) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return values.withColumn("rank", F.row_number().over(best)).select(
        "lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
