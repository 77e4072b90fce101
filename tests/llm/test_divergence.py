"""The divergence audit against plain Python over all documents and all kept terms."""

import random
import re
from collections import Counter, defaultdict

from tonality.llm import divergence

SCHEMA = "text string, lang string, source string, doc_id long, item string, value double, n string, digest int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(divergence.UPPER, divergence.LOWER)


def frame(spark, rows):
    """Documents with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(t, lang, s, i, "x", 0.5, "y", 1) for i, (t, lang, s) in enumerate(rows)], SCHEMA)


def slow(rows, top=200):
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, lang, s in rows:
        lang, s, terms = lang or "", s or "", TERM.findall((t or "").translate(LOWER))
        groups[lang].add(s)
        held[lang].update(set(terms))
        counts[lang, s].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= 3]
        p = {}
        for s in sources:
            n = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10 ** 9 * (counts[lang, s][t] + 1) // (n + len(kept)) for t in kept}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10 ** 9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, values in (("pair", pair), ("term", term)):
                ranked = sorted(values, key=lambda v: (-v[1], v[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def audited(df, **parameters):
    rows = divergence.audit(df, **parameters).select("lang", "source", "part", "item", "value", "rank")
    return sorted(map(tuple, rows.collect()))


def corpus(rng, n):
    """Few texts with many copies in several sources, and others with terms of unequal frequency."""
    words = [f"{c}{'abcdefgh'[i % 8]}{'uvwxyz'[i % 6]}" for c in "äaÉbß漢" for i in range(24)]
    copies = [" ".join(rng.choices(words, k=30)) for _ in range(5)]
    out = []
    for _ in range(n):
        text = rng.choice(copies) if rng.random() < 0.4 else " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randrange(60)))
        out.append((text.upper() if rng.random() < 0.2 else text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])))
    return out


def test_against_plain_python(spark):
    rows = corpus(random.Random(9), 400) + [(None, "en", "none"), ("1 2 3 !", "en", "digits"), ("word " * 50_000, "en", "long"), ("x y", "fr", "a"), ("x z", "fr", "b"), ("only", "it", "a")]
    want = slow(rows)
    assert {(r[2], r[0]) for r in want} >= {("pair", "fr"), ("pair", ""), ("term", "de")} and ("fr", "a", "pair", "b", 0, 1) in want
    assert audited(frame(spark, rows)) == want
    assert audited(frame(spark, rows).repartition(9), top_terms=3) == slow(rows, 3)


def test_equal_texts_are_one_row_with_the_multiplicity_of_each_source(spark):
    rows = [("same text", "en", "a")] * 3 + [("same text", "en", "b"), ("same text", "de", "b"), ("other", "en", None), (None, "en", "a"), ("", "en", "a")]
    got = {(r["lang"], r["text"]): sorted(map(tuple, r["by_source"])) for r in divergence.collapsed(frame(spark, rows)).collect()}
    assert got == {("en", "same text"): [("a", 3), ("b", 1)], ("de", "same text"): [("b", 1)], ("en", "other"): [("", 1)], ("en", ""): [("a", 2)]}


def test_nothing_and_terms_that_only_copies_hold(spark):
    assert audited(frame(spark, [])) == []
    rows = [("rare word", "en", "a")] * 3 + [("else", "en", "b")]
    assert audited(frame(spark, rows)) == slow(rows)


def test_tasks_pass_on_what_they_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 20)
    import pyarrow as pa
    texts = [("en", [{"source": "a", "n": 2}, {"source": "b", "n": 1}], "Ab ab c\x00d é".encode()), ("en", [{"source": "a", "n": 1}], " ".join(
        chr(97 + i) * 3 for i in range(25)).encode()), ("de", [{"source": "a", "n": 1}], b"")]
    batch = pa.RecordBatch.from_pylist([{"lang": x, "by_source": y, "bytes": z} for x, y, z in texts] * 2)
    got = Counter()
    parts = list(divergence.count_terms(iter([batch])))
    for part in parts:
        for r in part.to_pylist():
            got[r["lang"], r["source"], r["term"]] += r["count"] * 1000 + r["docs"]
    assert len(parts) > 4 and got["en", "a", "ab"] == 8004 and got["en", "b", "é"] == 2002 and got["en", "a", "ccc"] == 2002 and len(got) == 33


def test_large_counts_do_not_overflow(spark):
    one = spark.range(1).selectExpr("20000000000 AS c", "60000000000 AS n", "5 AS v")
    got = one.select(divergence._share(one.c, one.n, one.v).alias("p")).first()["p"]
    assert got == 1 + 10 ** 9 * (20_000_000_001) // 60_000_000_005


def test_the_query_against_plain_python(spark):
    from tonality.llm.queries import op12_source_divergence
    rows = [(r["text"], r["lang"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = op12_source_divergence(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == slow(rows)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
