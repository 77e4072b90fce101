"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources, in the order of their names' code points (null last), weigh 3, 1, 2, 3, 1, 2, ... and share 150 % of all words.  A
source's target stops at twice its words; what is left over goes to the others by weight until none is above (``targets``).

The corpus is cut into blocks of near equal numbers of words.  A source's documents are dealt by hash into shards of about
``SHARD_ROWS`` rows and lie there in a seeded order; a shard's words are cut into ``n_blocks`` blocks that differ by one
word at most.  Blocks are the seats: first all sources compete for them with their targets as votes, then the shards of
each source compete for its blocks with their words as votes, each time by the highest quotients ``votes / (2 k + 1)``
(``apportion``).  No shard may win more than twice its blocks.  A shard with the integer quota ``q`` takes each of its blocks
``q div n_blocks`` times, and the ``q mod n_blocks`` blocks with the smallest seeded hashes once more.  A document's ``taken``
is the sum of its words in the blocks taken, each as often as it is taken: at most twice its size.

A block has ``words / BLOCKS`` words, at least 1 and at most ``BLOCK_WORDS``; a source's words miss its target by about a
block.  No task holds a source: a hot source has more shards, not larger ones; sources are numbered, filled and ranked by
running totals over ranges.

Defined results: a null text has size 0, takes nothing and keeps its row; a null source is a source; repeated rows take
part as often as they are there (rows equal in id and text share a shard); a null id is hashed as such; an empty table, or one
without words, has targets of 0; columns other than ``doc_id, text, source`` are ignored.  Hashes and orders depend on the rows
alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonality.llm.common import cut
from tonality.operators.ranges import running
from tonality.session import sized_broadcast

WEIGHTS = (3, 1, 2)
SHARE = 1.5         # words of the mix for each word of the corpus
MOST = 2            # how often a word may be taken
SEED = 17
SHARD_ROWS = 4096
BLOCKS = 1 << 16
BLOCK_WORDS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def records(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size`` and the seeded hash ``h`` of each document."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources(source, source_size, ...)`` with ``target``.

    In the order of ``most * size / weight`` the sources that reach their limit come first.  With ``level`` the words
    left by the sources before one, divided by the weights from it on, the level at which all words are given out is the
    largest of them.
    """
    numbered = running(sources, [F.col("source").isNull(), F.col("source")], {"_index": F.lit(1)})
    weight = F.element_at(F.lit(list(weights)), (F.col("_index") % len(weights) + 1).cast("int"))
    weighed = numbered.withColumn("_weight", weight.cast("long")).withColumn("_cap", most * F.col("source_size"))
    filled = running(weighed.withColumn("_full", F.col("_cap") / F.col("_weight")),
                     ["_full", "_index"], {"_given": F.col("_cap"), "_used": F.col("_weight")})
    words, weight_sum = weighed.agg(F.sum("source_size"), F.sum("_weight")).first()
    left = (share * (words or 0) - F.col("_given")) / (F.lit(weight_sum or 0) - F.col("_used"))
    level = max(0.0, filled.agg(F.max(left)).first()[0] or 0.0)
    return weighed.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_weight") * level)).drop(
        "_index", "_weight", "_cap")


def apportion(parties: DataFrame, votes: str, seats: Column, most: Column, by: str | None, key: list[Column]) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` shared by the highest quotients ``votes / (2 k + 1)``, ties by ``key``; a party wins at
    most ``most``.  ``seats`` is one number for all parties, or with ``by`` for each group of it.

    With n parties the divisor lies within ``seats / (seats +- n / 2)`` of the ideal one, so a party's quota is within
    ``1 + share * n / 2`` of its ideal share of seats: only these quotients are ranked, about four for each party.
    """
    def of_all(rows: DataFrame, **sums: Column) -> DataFrame:
        """``rows`` with sums over all of them, or over their group."""
        aggs = [c.alias(k) for k, c in sums.items()]
        if not by:
            return rows.withColumns({k: F.lit(v) for k, v in rows.agg(*aggs).first().asDict().items()})
        totals = sized_broadcast(rows.groupBy(F.col(by).alias("_by")).agg(*aggs))
        return rows.join(totals, rows[by].eqNullSafe(totals["_by"])).drop("_by")

    known = of_all(parties, _votes=F.sum(votes).cast("double"), _n=F.count(F.lit(1)))
    share = F.coalesce(F.try_divide(F.col(votes).cast("double"), F.col("_votes")), F.lit(0.0))
    known = known.withColumns({"_seats": seats.cast("long"), "_most": most.cast("long"), "_share": share})
    ideal, slack = F.col("_share") * F.col("_seats"), F.col("_share") * F.col("_n") / 2
    sure = F.least(F.col("_most"), F.greatest(F.lit(0).cast("long"), F.floor(ideal - slack + 0.5) - 1))
    open_to = F.least(F.col("_most"), F.floor(ideal + slack + 0.5) + 1)
    known = known.withColumn("_sure", F.when(F.col(votes) > 0, sure).otherwise(F.lit(0).cast("long"))).withColumn("_open", open_to)
    known = cut(of_all(cut(known), _kept=F.sum("_sure")))
    asked = known.where((F.col(votes) > 0) & (F.col("_open") > F.col("_sure"))).withColumn(
        "_k", F.explode(F.sequence(F.col("_sure"), F.col("_open") - 1)))
    asked = asked.withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    order = [F.col("_q").desc(), *key, F.col("_k")]
    if by:
        ranked = asked.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    else:
        ranked = running(asked, order, {"_place": F.lit(1)})
    won = ranked.where(F.col("_place") < F.col("_seats") - F.col("_kept"))
    # a row of each party and its won quotients, summed up by the party's own columns
    own = known.columns
    rows = known.withColumn("_won", F.col("_sure")).unionByName(won.select(*own, F.lit(1).cast("long").alias("_won")))
    out = rows.groupBy(*own).agg(F.sum("_won").alias("quota"))
    return out.drop("_votes", "_n", "_seats", "_most", "_share", "_sure", "_open", "_kept")


def plan(recs: DataFrame, seed: int = SEED, share: float = SHARE, most: int = MOST, blocks: int = BLOCKS,
         block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, weights: tuple[int, ...] = WEIGHTS
         ) -> tuple[DataFrame, DataFrame]:
    """The documents with their shards, and the shards with their quotas (``quota``, in blocks) and their sources' targets."""
    sums = recs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = cut(targets(cut(sums), share, most, weights).withColumn("shards", F.ceil(F.col("_rows") / shard_rows).cast("int")))
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, min(block_words, words // blocks))
    own = sources.select(F.col("source").alias("_source"), "shards")
    dealt = recs.join(sized_broadcast(own), recs["source"].eqNullSafe(own["_source"])).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.col("shards")).cast("int")).drop("_source", "shards")
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    shards = shards.withColumn("n_blocks", F.when(F.col("words") > 0, F.greatest(
        F.lit(1).cast("long"), F.round(F.col("words") / block).cast("long"))).otherwise(F.lit(0).cast("long")))
    shards = cut(shards)
    in_blocks = shards.groupBy(F.col("source").alias("_source")).agg(F.sum("n_blocks").alias("_blocks"))
    parties = sources.join(sized_broadcast(in_blocks), sources["source"].eqNullSafe(in_blocks["_source"])).drop("_source", "_rows", "shards")
    won = apportion(parties, "target", F.lit(round(share * words / block)), most * F.col("_blocks"), None,
                    [F.col("source").isNull(), F.col("source")])
    won = cut(won.drop("_blocks")).select(F.col("source").alias("_source"), "source_size", "target", F.col("quota").alias("_quota"))
    local = shards.join(sized_broadcast(won), shards["source"].eqNullSafe(won["_source"])).drop("_source")
    return dealt, apportion(local, "words", F.col("_quota"), most * F.col("n_blocks"), "source", [F.col("shard")]).drop("_quota")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["_source"]) & (a["shard"] == b["_shard"])


def block_hash(seed: int, source: Column, shard: Column, block: Column) -> Column:
    return F.xxhash64(F.lit(seed + 2), source, shard, block.cast("long"))


def mix(docs: DataFrame, seed: int = SEED, **parameters) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each document, and its source and shard."""
    recs = cut(records(docs, seed))
    dealt, quotas = plan(recs, seed, **parameters)
    quotas = cut(quotas)
    rest = F.col("quota") % F.col("n_blocks")
    # the last of the blocks that are taken once more: of each shard, the (quota mod n_blocks)-th smallest hash
    extra = quotas.where((F.col("n_blocks") > 0) & (rest > 0)).select(
        "source", "shard", rest.alias("_rest"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("_block"))
    hashed = extra.withColumn("_mark", F.struct(block_hash(seed, F.col("source"), F.col("shard"), F.col("_block")).alias("h"), "_block"))
    nth = F.row_number().over(Window.partitionBy("source", "shard").orderBy("_mark"))
    last = hashed.withColumn("_nth", nth).where(F.col("_nth") == F.col("_rest")).select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "_mark")
    shards = quotas.join(last, _same(quotas, last), "left").drop("_source", "_shard")
    shards = shards.withColumnsRenamed({"source": "_source", "shard": "_shard"})
    before = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    rows = placed.join(sized_broadcast(shards), _same(placed, shards))
    # block b has the shard's words from floor(b * words / n_blocks) on
    words, n, at = F.col("words"), F.col("n_blocks"), F.col("_at")

    def start(b: Column) -> Column:
        return F.call_function("div", b * words, n)

    def of_word(w: Column) -> Column:
        """The block of the shard's word ``w``, the last one that starts at or before it."""
        return F.call_function("div", (w + 1) * n - 1, words)

    end = at + F.col("size")

    def once_more(acc: Column, b: Column) -> Column:
        mark = F.struct(block_hash(seed, F.col("source"), F.col("shard"), b).alias("h"), b.alias("_block"))
        part = F.least(end, start(b + 1)) - F.greatest(at, start(b))
        return acc + F.when(F.col("_mark").isNotNull() & (mark <= F.col("_mark")), part).otherwise(F.lit(0)).cast("long")

    own = F.sequence(of_word(at), of_word(end - 1))
    taken = F.when(F.col("size") > 0, F.call_function("div", F.col("quota"), n) * F.col("size") + F.aggregate(own, F.lit(0).cast("long"), once_more))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), "source", "shard")
