"""Corpus pipeline: stages over ``documents``, each reading what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Documents with a lower quality score are rejected.
MIN_QUALITY = 0.5
#: Documents without a language, or whose best language has a lower mean probability, are rejected.
MIN_LANGUAGE = 0.3
#: Near-duplicates: words of a shingle, and the similarity in percent.
SHINGLE, SIMILARITY = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels``."""
    from tonality.llm.quality import fit, score

    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score(docs["text"], model) >= MIN_QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language (text without letters has score 0)."""
    from tonality.llm.crf import fit, identify

    return docs.where(identify(docs, fit(docs))["score"] >= MIN_LANGUAGE)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all documents without words, which are nobody's duplicates.

    A document is known by its id, which may be missing or repeated, and its text.
    """
    from pyspark.sql import functions as F

    from tonality.llm.common import cut
    from tonality.llm.minhash import BROADCAST_ROWS, near_duplicates
    from tonality.session import is_small

    marked = near_duplicates(docs, SHINGLE, SIMILARITY).where("first AND n_shingles > 0")
    kept = cut(marked.select(F.col("doc_id").alias("_id"), F.col("th").alias("_kept")))
    n, documents = kept.agg(F.count(F.lit(1)), F.count_distinct(F.struct("_id", "_kept"))).first()
    hashed = docs.withColumn("_th", F.xxhash64("text"))
    # texts are shuffled only for more documents than may be broadcast, or where rows are repeated
    side = F.broadcast(kept) if is_small(kept, BROADCAST_ROWS) else kept
    rows = hashed.join(side, (hashed["_th"] == side["_kept"]) & hashed["doc_id"].eqNullSafe(side["_id"]), "left_semi")
    rows = rows if n == documents else rows.dropDuplicates(["doc_id", "_th"])
    without = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return rows.where(~without).select(*docs.columns).unionByName(docs.where(without))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it replaced in their texts."""
    from pyspark.sql import functions as F

    from tonality.llm.pii import sanitise

    clean = sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048."""
    import public_tokenizers

    from tonality.llm.packing import pack, pieces

    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("language", language), ("minhash", dedup), ("pii", pii), ("packing", packing)]

#: No SQL: learned models and tokenizers take part.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; every stage's rows are written as Parquet in the shared folder and reread."""
    from tonality.llm.common import shared_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
