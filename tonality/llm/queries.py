"""Registered queries of the operators: ``opN_<name>(spark, sf_dir)`` over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(cols or ("doc_id", "text")))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 2048."""
    import public_tokenizers

    from tonality.llm import packing

    return packing.pack(packing.pieces(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text, and the terms that disclose it."""
    from tonality.llm.pii import report

    return report(_docs(spark, sf_dir))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates on three-word shingles from a similarity of 0.85."""
    from tonality.llm.minhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), width=3, percent=85).drop("th", "first")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in shards 0 to 7 of near equal bytes, by 4096 virtual slots and a stored slot map."""
    from tonality.llm import sharding
    from tonality.llm.common import shared_path

    recs = sharding.records(_docs(spark, sf_dir))
    path = shared_path(spark, "slot-map")
    sharding.store(sharding.first_map(sharding.slot_totals(recs)), path)
    return sharding.assign(recs, sharding.load(spark, path)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids by the transducer and of the text decoded from them."""
    import public_tokenizers

    from tonality.llm import bpe

    return bpe.round_trip(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by boosted trees learned outside the held-out fold."""
    from tonality.llm.quality import classify

    return classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of a label from a cosine of 0.98."""
    from tonality.llm.pivots import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by the random field learned outside the held-out fold."""
    from tonality.llm.crf import classify

    return classify(_docs(spark, sf_dir, "doc_id", "text", "lang"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tonality.llm.html import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of every text and of its edited text."""
    from tonality.llm.fingerprints import fingerprints

    return fingerprints(_docs(spark, sf_dir))


def op11_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    from tonality.llm.negatives import mine

    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's terms depart from the other sources of its language, and which terms do."""
    from tonality.llm.divergence import audit

    return audit(_docs(spark, sf_dir, "text", "lang", "source"))


def op13_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights takes from every document."""
    from tonality.llm.mixing import mix

    return mix(_docs(spark, sf_dir, "doc_id", "text", "source"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_pii, op3_minhash, op4_sharding, op5_byte_bpe, op6_quality, op7_pivot_index, op8_language, op9_html,
    op10_order_minhash, op11_segment_negatives, op12_source_divergence, op13_sainte_lague_mix)}


def _oracle() -> dict[str, str]:
    from tonality.llm import oracle, pii

    return {"op2_pii": oracle.pii(pii.RADIUS, pii.REMOVE, pii.GENERALISE, pii.SUPPORT),
            "op3_minhash": oracle.MINHASH, "op7_pivot_index": oracle.PIVOTS,
            "op11_segment_negatives": oracle.NEGATIVES, "op12_source_divergence": oracle.DIVERGENCE}


ORACLE: dict[str, str] = _oracle()
