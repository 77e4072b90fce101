"""Order MinHash fingerprints: sketches whose agreement follows edit distance, not only shared content.

K-mers start at every code point of the text and are ``WIDTH`` code points long, white space included (a shorter text is one
k-mer).  Equal k-mers are numbered by occurrence.  The 64 hash functions are the 64 parts of one hash's range: in each part the
two numbered k-mers with the smallest hash are selected, put back into text order and hashed as a tuple.  Two texts agree
in a part if the same k-mers were selected in the same order.

All steps are array expressions on one row.  A text becomes UTF-32, in which a k-mer is a slice at a known place; hashes and
positions are packed into longs, so that sorting and selection are sorts of long arrays.  The k-mers of the edited text that
lie in what it keeps are a slice of the text's own; only those from the seam on are hashed.  ``likeness`` is the share of agreeing
parts among parts that are filled in either text; two empty texts have likeness 1.

Packing keeps 37 bits of a hash and 26 bits of a position (positions beyond 2^26 wrap, which may only
change the order inside a tuple).  Every text is read whole.

Defined results: null text is the empty text, whose fingerprint is the empty string; rows of one id are read
in the order of their texts; null ids come last; a single document is its own successor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS_BITS = 6  # 64 parts
POS_BITS = 26
HASH_BITS = 37
LOW = (1 << POS_BITS) - 1
HIGH = ((1 << HASH_BITS) - 1) << POS_BITS
WIDTH = 8       # code points in a k-mer


def _pack(h: Column, pos: Column) -> Column:
    low = h.bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    return F.shiftleft(low, POS_BITS).bitwiseOR(pos.cast("long").bitwiseAND(F.lit(LOW)))


def _hash_of(x: Column) -> Column:
    return F.shiftright(x, POS_BITS)


def _pos_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << POS_BITS) - 1))


def _part_of(x: Column) -> Column:
    return F.shiftright(x, POS_BITS + HASH_BITS - PARTS_BITS)


def _held(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` taken from its row once: a column's bytes or array would be fetched for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _two(a: Column) -> Column:
    """The two smallest of each part of an ascending array."""
    below = F.lit((1 << (POS_BITS + HASH_BITS - PARTS_BITS)) - 1)  # longs of one part differ in lower bits only
    return _held(a, lambda a: F.concat(F.slice(a, 1, 2), F.filter(a, lambda x, i: x.bitwiseXOR(F.get(a, i - 2)) > below)))


def kmers(text: Column, n_chars: Column, first: Column, width: int = WIDTH) -> Column:
    """The k-mers from place ``first`` (from 0) on, each as its hash and place in one long."""
    last = F.when(n_chars == 0, -1).otherwise(F.greatest(n_chars - width, F.lit(0))).cast("int")
    start = first.cast("int")
    # four bytes for each code point: where the k-mers start in the bytes, from 1
    at = F.slice(F.sequence(start * 4 + 1, F.greatest(start, last) * 4 + 1, F.lit(4)), F.lit(1), F.greatest(last - start + 1, F.lit(0)))

    def of(utf32: Column) -> Column:
        def packed(place: Callable[[Column], Column]) -> Column:
            return F.transform(at, lambda j: F.xxhash64(F.substring(utf32, j, F.lit(4 * width))).bitwiseAND(F.lit(HIGH))
                               .bitwiseOR(place(F.shiftright(j, 2).cast("long"))))

        return F.when(n_chars <= LOW, packed(lambda i: i)).otherwise(packed(lambda i: i.bitwiseAND(F.lit(LOW))))

    return _held(F.encode(text, "UTF-32"), of)


def with_signature(df: DataFrame, packed: str, out: str) -> DataFrame:
    """Add ``out``: array<long> of one hash per filled part, ``part << 32 | 32 bits``, ascending, from the k-mers in ``packed``.

    A k-mer's first occurrence has the k-mer's own hash and needs no second one; only the others are numbered.  Each step is a
    column of its own, as a long expression used twice would be computed twice.  No array may hold a NULL by its type: Spark sorts
    such arrays as numbers, others as objects.
    """
    s, f, r, b, o, p = (f"__{out}_{i}" for i in "sfrbop")
    srt, firsts, again, starts, occ = map(F.col, (s, f, r, b, o))
    df = df.withColumn(s, F.sort_array(packed))
    df = df.withColumn(f, _held(srt, lambda a: F.concat(F.slice(a, 1, 1), F.filter(
        a, lambda x, i: x.bitwiseXOR(F.get(a, i - 1)) > LOW))))
    df = df.withColumn(r, F.when(F.size(firsts) < F.size(srt), F.array_except(srt, firsts)).otherwise(F.slice(srt, 1, 0))).drop(s)
    # where the stretches of equal k-mers begin
    df = df.withColumn(b, F.when(F.size(again) > 0, _held(again, lambda a: F.concat(F.array(F.lit(0)), F.filter(
        F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i).bitwiseXOR(F.get(a, i - 1)) > LOW)))))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(again)))
    df = df.withColumn(o, F.flatten(F.transform(
        F.zip_with(starts, ends, lambda x, y: y - x), lambda c: F.sequence(F.lit(1), c)))).drop(b)
    numbered = F.zip_with(again, occ, lambda x, c: F.coalesce(_pack(F.xxhash64(_hash_of(x), c), _pos_of(x)), F.lit(0).cast("long")))
    df = df.withColumn(s, F.when(F.size(again) > 0, F.sort_array(numbered)).otherwise(again)).drop(r, o)
    df = df.withColumn(r, F.sort_array(F.concat(_two(firsts), _two(srt)))).drop(s, f)
    return _tuples(df.withColumn(p, _two(F.col(r))).drop(r), p, out)


def with_text_signature(df: DataFrame, text: str, out: str, width: int = WIDTH) -> DataFrame:
    """Add ``out``, the signature of a column of text."""
    packed = f"__{out}_k"
    own = kmers(F.col(text), F.char_length(text), F.lit(0), width)
    return with_signature(df.withColumn(packed, own), packed, out).drop(packed)


def _tuples(df: DataFrame, p: str, out: str) -> DataFrame:
    """``out`` from column ``p``, the k-mers selected of each part, which is dropped."""
    t = f"__{out}_t"
    tuples = F.col(t)
    by_place = F.array_sort(F.transform(p, lambda x: F.struct(
        _part_of(x).alias("part"), _pos_of(x).alias("pos"), _hash_of(x).alias("hash"))))
    df = df.withColumn(t, by_place).drop(p)
    after = F.concat(F.slice(tuples, 2, F.greatest(F.size(tuples) - 1, F.lit(0))),
                     F.array(F.lit(None).cast("struct<part:bigint,pos:bigint,hash:bigint>")))
    before = F.concat(F.array(F.lit(None).cast("struct<part:bigint,pos:bigint,hash:bigint>")), tuples)
    pairs = F.arrays_zip(tuples.alias("x"), after.alias("y"), before.alias("z"))
    elems = F.filter(F.transform(pairs, lambda q: F.when(
        q["x"].isNotNull() & ~q["z"]["part"].eqNullSafe(q["x"]["part"]),
        F.shiftleft(q["x"]["part"], 32).bitwiseOR(F.xxhash64(
            q["x"]["hash"], F.when(q["y"]["part"] == q["x"]["part"], q["y"]["hash"]))
            .bitwiseAND(F.lit((1 << 32) - 1))))), lambda e: e.isNotNull())
    return df.withColumn(out, F.when(F.size(tuples) == 0, F.array().cast("array<long>")).otherwise(elems)).drop(t)


def fingerprint(sig: Column) -> Column:
    """A signature as text: for each filled part two hex digits of its number and eight of its hash."""
    return F.array_join(F.transform(sig, lambda e: F.lpad(F.lower(F.hex(e)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing parts among the parts filled in either signature."""
    parts = F.array_union(F.transform(a, lambda e: F.shiftright(e, 32)), F.transform(b, lambda e: F.shiftright(e, 32)))
    return F.when(F.size(parts) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(parts)).cast("double")


def _search(bounds: list[int], x: Column) -> Column:
    """Number of ``bounds`` (ascending) at or below ``x``, by halving."""
    arr = F.lit(bounds)
    steps = max(1, len(bounds).bit_length())

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        up = (acc["lo"] < acc["hi"]) & (F.get(arr, mid) <= x)
        return F.struct(F.when(up, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when((acc["lo"] < acc["hi"]) & ~up, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]


def with_next(docs: DataFrame, buckets_per_partition: int = 4) -> DataFrame:
    """Add ``next_text``: the whole text of the document with the next smaller id (after the last: the first).

    The ids are cut into ranges; each text is shuffled once, to its range, where ``lead`` finds the successor.
    The first document of each range is also sent to the range before it as a guest.
    Returns ``doc_id, text, __bucket, __guest, next_text``; the guests stay, marked, for a later ``lead`` over the
    same order, which needs no further shuffle or sort.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(2, buckets_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    bounds = sorted(set(marks))
    # null ids form a range of their own below all others
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(
        _search(bounds, F.col("doc_id")) if bounds else F.lit(0)).cast("int")
    ends = base.select("doc_id", bucket.alias("b")).groupBy("b").agg(F.max("doc_id").alias("top")).collect()
    tops = sorted(((r["b"], r["top"]) for r in ends), reverse=True)  # one row per range, in the order of reading
    # the first document of range i is the guest of the range read before it; the very first one, of the last
    guests = [(tops[i][0], tops[i][1], tops[i - 1][0]) for i in range(len(tops))]
    to = spark.createDataFrame(guests, "g_bucket int, g_top long, g_to int")
    placed = base.withColumn("__bucket", bucket)
    # the first row in reading order among equal ids: the smallest text
    first = (placed.join(F.broadcast(to), (F.col("__bucket") == F.col("g_bucket"))
                         & F.col("doc_id").eqNullSafe(F.col("g_top")))
             .groupBy("g_to").agg(F.min(F.struct("doc_id", "text")).alias("g"))
             .select(F.col("g.doc_id").alias("doc_id"), F.col("g.text").alias("text"),
                     F.col("g_to").alias("__bucket"), F.lit(1).alias("__guest")))
    rows = placed.withColumn("__guest", F.lit(0)).unionByName(first)
    order = Window.partitionBy("__bucket").orderBy("__guest", F.col("doc_id").desc_nulls_last(), "text")
    return rows.withColumn("next_text", F.lead("text").over(order))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text (see the module), with their likenesses, over the k-mers of ``width`` code
    points.

    The edited text keeps the first ``n_chars - floor(n_chars / 2)`` code points and ends with the first
    ``floor(n_chars / 2)`` (or all) of the next document in descending id order.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    n, half = F.col("n_chars"), F.floor(F.col("n_chars") / 2).cast("int")
    head = (n - half).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), head), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("next_text").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = rows.withColumn("k", kmers(F.col("text"), n, F.lit(0), width)).drop("text")
    # the k-mers that end in the kept part are the text's own
    kept = F.greatest(head - (width - 1), F.lit(0))
    rows = rows.withColumn("m", F.char_length("edited"))
    own = F.when(F.col("m") >= width, kept).otherwise(F.lit(0))
    rows = rows.withColumn("e", F.concat(F.slice("k", F.lit(1), own), kmers(F.col("edited"), F.col("m"), own, width))).drop("edited", "m")
    rows = with_signature(rows, "k", "sig").drop("k")
    rows = with_signature(rows, "e", "edited_sig").drop("e")
    order = Window.partitionBy("__bucket").orderBy("__guest", F.col("doc_id").desc_nulls_last())
    rows = rows.withColumn("next_sig", F.lead("sig").over(order))
    return rows.where("__guest = 0").select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.coalesce("next_sig", "sig")).alias("near_next"))
