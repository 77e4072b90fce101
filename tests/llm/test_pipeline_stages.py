"""The corpus pipeline: its stages on the small tables and on edge cases, and the operators' registration."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names


def test_stages_keep_clean_documents_and_their_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    left = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and all(i in left for i, q in labels.items() if q == 1)
    assert sum(i in left for i, q in labels.items() if q == 0) <= 2
    known = stages["language"](spark, docs, SF)
    assert known.columns == docs.columns and known.count() == docs.count()
    clean = stages["pii"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where(F.col("text").rlike("[a-z]@[a-z]+[.]com")).count() == 0


def test_dedup_keeps_one_of_each_group(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (3, text), (4, text), (5, None), (6, ""), (None, text), (7, "other words that are not the same at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["minhash"](spark, docs, SF).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 3), (False, 5), (False, 6), (False, 7)]


def test_dedup_against_all_pairs_with_repeated_and_missing_ids(spark):
    """No text is lost but for its near-duplicates, whatever the ids."""
    import random
    dedup, rng = dict(corpus_pipeline.STAGES)["minhash"], random.Random(21)
    first, second = (" ".join(f"{c}{i}" for i in range(12)) for c in "ab")
    few = spark.createDataFrame([(1, first), (1, second), (2, first), (3, second)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in dedup(spark, few, SF).collect()) == [(1, first), (1, second)]

    def words(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    bases = [words(rng.choice([3, 8, 40, 90])) for _ in range(25)]
    texts = []
    for _ in range(220):
        own = list(rng.choice(bases))
        if rng.random() < 0.5:
            own[rng.randrange(len(own))] = "changed"
        texts.append(rng.choice([" ".join(own).upper(), " ".join(own), "  ".join(own), " ".join(own)]) if rng.random() < 0.95 else rng.choice([None, "", " \n"]))
    rows = [(rng.choice([None, i, i % 40]), t) for i, t in enumerate(texts)]

    def shingles(t):
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want, by = [(i, t) for (i, t), s in zip(rows, sets, strict=True) if not s], {}
    for (i, t), s, g in zip(rows, sets, group, strict=True):
        if s:
            by.setdefault(g, []).append((i, t))
    got = [(r["doc_id"], r["text"]) for r in dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), SF).collect()]
    assert len(got) == len(want) + len(by)
    for own in by.values():
        least = min((i is None, i or 0) for i, _ in own)
        kept = [r for r in got if r in own]
        assert kept and (kept[0][0] is None, kept[0][0] or 0) == least
    assert sorted(map(repr, (r for r in got if not shingles(r[1])))) == sorted(map(repr, want))


def test_the_whole_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF)
    total = rows.agg(F.sum("length")).first()[0]
    assert rows.select("sequence_id").distinct().count() <= total // 2048 + 3
    assert set(rows.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
