"""The ten operators against brute force, libraries or held-out labels, and their edge cases."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
WORDS = "alpha beta gamma delta rho sigma tau phi chi psi omega kappa lambda mu nu xi zeta eta theta iota".split()
EDGE = [None, "", " ", "\n\t ", "x", "one two", "?!", "é漢字🙂 ok", "a" * 30_000, "word " * 8_000, "same text here now", "same text here now"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, base int"


def frame(spark, texts, first=0):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(first + i, t, "en", "s", len(t or ""), 0.5, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


# --- packing ------------------------------------------------------------------------------------------------------------
PATH = P.path("word_bpe_49k.json")


def library_ids(text):
    """The ids of the tokenizer as it is loaded, apart from the operator."""
    import tokenizers
    if not hasattr(library_ids, "own"):
        library_ids.own = tokenizers.Tokenizer.from_file(PATH)
    return library_ids.own.encode(text, add_special_tokens=False).ids


def test_chunks_give_the_tokenizers_ids():
    from tonality.llm.packing import ChunkTokenizer
    own, rng = ChunkTokenizer(PATH, entries=50), random.Random(3)
    alphabet = "aab  e\n\t  r'stéßÀΣσİ漢🙂  　.!?$12\x1c\x85 <|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += ["see <|endoftext|> here", "<|startoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <|endoftext", "x <| y", "é<|startoftext|><|endoftext|>漢"]
    for text in texts:
        ids = library_ids(text)
        assert own(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
    assert library_ids("see <|endoftext|> here") == [862, 49407, 763]


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_edge_cases(spark):
    from tonality.llm import packing
    own = packing.ChunkTokenizer(PATH)
    docs = frame(spark, EDGE)
    rows = packing.pack(packing.pieces(docs, PATH)).collect()
    check_packed(rows, 2048)
    for i, t in enumerate(EDGE):
        ids = own(t or "") + struct.pack("<I", 0)
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == [2048 * k for k in range(len(mine))]
        assert sum(r["length"] for r in mine) == len(ids) // 4
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(ids[8192 * k:8192 * (k + 1)]) for k in range(len(mine))]
    assert packing.pack(packing.pieces(docs.where("false"), PATH)).count() == 0


def test_packing_is_dense_and_gives_sequences(spark):
    from tonality.llm import packing
    rng = random.Random(5)
    docs = frame(spark, [prose(rng, rng.randint(1, 400)) for _ in range(300)])
    pieces = packing.pieces(docs, PATH, with_ids=True)
    packed = packing.pack(pieces.drop("ids"), group_pieces=120)
    rows = packed.collect()
    total = sum(r["length"] for r in rows)
    assert check_packed(rows, 2048) <= -(-total // 2048) + 6
    seqs = packing.sequences(packed, pieces).collect()
    assert sum(len(r["ids"]) for r in seqs) == total
    ids = {r["sequence_id"]: r["ids"] for r in seqs}
    for r in pieces.join(packed, ["doc_id", "piece", "ids_crc32"]).select("sequence_id", "offset", "ids").limit(50).collect():
        assert ids[r["sequence_id"]][r["offset"]:r["offset"] + len(r["ids"])] == r["ids"]


def test_pieces_against_a_packing_in_plain_python(spark):
    """Every group's bins, by a version that looks through all open bins, on texts that make a small bound bite."""
    from tonality.llm import packing
    rng = random.Random(15)
    rows = [(i if i % 9 else None, prose(rng, rng.choice([1, 5, 30, 120]))) for i in range(250)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string")
    pieces = packing.pieces(docs, PATH, capacity=256)
    got = packing.pack(pieces, 256, open_bins=6, group_pieces=90)
    placed = got.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(-(-pieces.count() // 90)))).collect()
    assert sum(r["length"] for r in placed) == sum(len(library_ids(t)) + 1 for _, t in rows + rows[:20])
    closed = 0
    for g in {r["grp"] for r in placed}:
        own = sorted((r for r in placed if r["grp"] == g), key=lambda r: (-r["length"], r["doc_id"] is not None, r["doc_id"] or 0, r["piece"]))
        left, want = {}, []
        for n in (r["length"] for r in own):
            roomy = [b for b in left if left[b] >= n]
            if not roomy:
                if len(left) >= 6:
                    closed += 1
                    del left[min(left, key=lambda b: left[b])]
                b = max([x for x, _, _ in want], default=-1) + 1
                left[b] = 256
            else:
                b = min(roomy, key=lambda b: left[b])
            want.append((b, 256 - left[b], n))
            left[b] -= n
            if not left[b]:
                del left[b]
        # bins of equal room may be taken in any order: what is compared is how full they get
        full = lambda rows: sorted(Counter(rows).items())
        sums, theirs = Counter(), Counter()
        for r in own:
            sums[r["sequence_id"]] += r["length"]
        for b, _, n in want:
            theirs[b] += n
        assert full(sums.values()) == full(theirs.values())
    assert closed > 20
    check_packed(placed, 256)


def test_best_fit_closes_the_fullest():
    from tonality.llm.packing import BestFit
    fit = BestFit(capacity=10, open_bins=2)
    assert [fit.place(n) for n in (6, 7, 3, 8, 4, 2)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 8)]
    fit = BestFit(capacity=10, open_bins=2)
    assert [fit.place(n) for n in (6, 8, 5, 2, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 5)]  # bin 1 was closed


# --- personal data ------------------------------------------------------------------------------------------------------
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) \
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_follow_the_patterns(spark):
    from tonality.llm.pii import report
    rng = random.Random(2)
    bits = ["a@b.c", "@", ".", "x_y@z-q.com", "1.2.3.4", "256.1.1.1", "0007.008.1.2", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999",
            "+44", " ", "-", "é🙂", "12", "1", "_x", "a.b", "%+-", ")", "(", "\n"]
    texts = EDGE + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(600)] + ["1.2.3.4.5.6.7.8.9", "a@b.com_x@y.org", "1" * 20_000,
                                                                                                         "a@" + "b." * 9_000 + "c"]
    for r in report(frame(spark, texts)).collect():
        own = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest(), repr(texts[r["doc_id"]][:200])
        assert r["spans"].split(",")[:len(own)] == (own or [""])[:len(own)]
    assert report(frame(spark, [None]).where("false")).count() == 0


def test_disclosing_terms_are_added_and_replaced(spark):
    from tonality.llm.pii import report, sanitise
    # "writes" stands only near one address, "Zorblax" once elsewhere too; "hello" is everywhere; the copies count once
    texts = [f"hello number {i} Zorblax writes from jo@ex.org today" for i in range(4)] + [f"hello other text {i}" for i in range(60)]
    texts += ["the Zorblax again, alone"] + ["unique Qwerty near al@ex.org"] * 5
    docs = frame(spark, texts)
    rows = {r["doc_id"]: r["spans"] for r in report(docs).collect()}
    assert rows[0] == "email:35:44,hint:15:22,term:6:12,term:23:29,term:30:34,term:45:50" and rows[64] == "hint:4:11"
    assert rows[10] == "" and rows[65].startswith("email:19:28") and "term" not in rows[65]
    out = {r["doc_id"]: r for r in sanitise(docs).collect()}
    assert out[64]["text"] == "the [Name] again, alone" and out[10]["text"] == texts[10] and out[3]["base"] == 1
    assert out[65]["text"] == "unique Qwerty near [EMAIL]"
    assert sanitise(docs).columns == docs.columns
    assert_sql(spark, docs, "documents", "op2_pii", report(docs))


def assert_sql(spark, table, name, query, result):
    """The operator's rows equal those of its SQL."""
    import duckdb

    from tonality.llm.queries import ORACLE
    con = duckdb.connect()
    con.register(name, table.toPandas())
    want, got = con.sql(ORACLE[query]).df(), result.toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = [sorted(map(tuple, x[columns].astype(str).values.tolist())) for x in (want, got)]
    assert rows[0] == rows[1]


# --- near-duplicates ----------------------------------------------------------------------------------------------------
def word_sets(texts, width):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def linked(sets, percent):
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, width, percent, monkeypatch):
    from tonality.llm import minhash
    rng = random.Random(width)
    texts = list(EDGE)
    for _ in range(12):
        words = prose(rng, rng.randint(4, 150)).split()
        for _ in range(rng.randint(1, 20)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(WORDS).upper()
            texts.append(rng.choice([" ", "\n"]).join(own))
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 6)  # several blocks a group
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts), width, percent).collect()}
    sets = word_sets(texts, width)
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [rows[i]["component_id"] for i in range(len(texts))] == linked(sets, percent)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in rows.items())


def test_near_duplicates_that_no_block_joins_by_itself(spark, monkeypatch):
    """Chains in which only neighbours are alike, and many copies of one text beside a few that hang on one of them."""
    from tonality.llm import minhash
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base[6 * i:6 * i + 160]) for i in range(40)]
    own = [f"v{i}" for i in range(150)]
    for i in range(60):
        words = list(own)
        words[rng.randrange(150)] = f"x{i}"
        texts.append(" ".join(words))
    far = texts[-1].split()
    for i in range(8):
        far = [*far[5:], *(f"y{i}{j}" for j in range(5))]
        texts.append(" ".join(far))
    rng.shuffle(texts)
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 4)
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts), 3, 85).collect()}
    groups = linked(word_sets(texts, 3), 85)
    assert len(set(groups)) < 5
    assert [rows[i]["component_id"] for i in range(len(texts))] == groups


def test_near_duplicates_of_nothing_and_null_ids(spark):
    from tonality.llm.minhash import near_duplicates
    docs = frame(spark, ["a b c d", "a b c d"])
    assert near_duplicates(docs.where("false")).count() == 0
    nulls = docs.withColumn("doc_id", F.when(F.col("doc_id") == 0, F.col("doc_id")))
    assert sorted((r["doc_id"] is None, r["component_id"], r["kept"]) for r in near_duplicates(nulls).collect()) == [
        (False, 0, True), (True, 0, False)]
    # one id with two texts: two documents
    one = frame(spark, ["a b c d", "e f g h", "a b c d"]).withColumn("doc_id", F.when(F.col("doc_id") < 2, 1).otherwise(5).cast("long"))
    assert sorted((r["doc_id"], r["component_id"], r["kept"], r["first"]) for r in near_duplicates(one).collect()) == [
        (1, 1, True, True), (1, 1, True, True), (5, 1, False, False)]
    nobody = frame(spark, ["a b c d", "a b c d", ""]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r["component_id"], r["kept"]) for r in near_duplicates(nobody).collect()] == [(None, False)] * 3


def test_shingles_do_not_depend_on_windows(monkeypatch):
    from tonality.llm import minhash
    rng = random.Random(9)
    texts = [prose(rng, n).encode() for n in (0, 1, 2, 3, 50, 700)] + [b"", b"  ", b"x" * 500, b"\n a b c \t"]
    whole = minhash.shingle_sets(texts, 3)
    monkeypatch.setattr(minhash, "WINDOW", 64)
    small = minhash.shingle_sets(texts, 3)
    assert all(np.array_equal(a, b) for a, b in zip(whole, small, strict=True))


def test_components(spark):
    from tonality.llm.common import components
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1, 40)] + [(5, 5), (None, 3), (500, 499)]
    rows = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {**{i: 100 for i in range(100, 161)}, **{k: 1 for k in range(1, 40)}, 499: 499, 500: 499}


# --- sharding -----------------------------------------------------------------------------------------------------------
def test_shards_are_even_gapless_and_grow_into_the_new_one_only(spark, tmp_path):
    from tonality.llm import sharding
    rng = random.Random(1)
    texts = EDGE[:8] + [prose(rng, rng.randint(1, 60)) for _ in range(3000)]
    recs = sharding.records(frame(spark, texts))
    path = str(tmp_path / "map")
    sharding.store(sharding.first_map(sharding.slot_totals(recs)), path)
    rows = sharding.assign(recs, sharding.load(spark, path)).collect()
    assert len(rows) == len(texts)
    sizes, places = [0] * 8, [[] for _ in range(8)]
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        sizes[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places)
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 8
    sharding.store(sharding.grown(sharding.load(spark, path, 1)), path)
    new = {r["doc_id"]: r["shard"] for r in sharding.assign(recs, sharding.load(spark, path)).collect()}
    old = {r["doc_id"]: r["shard"] for r in rows}
    assert all(new[i] in (old[i], 8) for i in old)
    grown = [sum(r["size"] for r in rows if new[r["doc_id"]] == s) for s in range(9)]
    assert max(grown) - min(grown) <= 0.03 * sum(grown) / 9
    assert sharding.load(spark, path, 1).select("shard").distinct().count() == 8  # the old version is still there


def test_sharding_of_nothing(spark):
    from tonality.llm import sharding
    recs = sharding.records(frame(spark, ["x"]).where("false"))
    assert sharding.assign(recs, sharding.first_map(sharding.slot_totals(recs))).count() == 0


# --- byte-level BPE -----------------------------------------------------------------------------------------------------
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_transducer_agrees_with_the_library():
    import tiktoken

    from tonality.llm.bpe import Decoder, Encoder, read_ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    own, back, rng = Encoder(RANKS, P.PATTERN), Decoder(RANKS), random.Random(4)
    alphabet = "aab  e\n\t  r'stéß漢字🙂  　.!?$123\x1c\x85the ing"
    texts = [t or "" for t in EDGE] + ["ab" * 20_000, "漢" * 5_000] + [
        "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text in texts:
        ids = np.frombuffer(own(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text), repr(text[:100])
        assert "".join(back.stream(ids, block=3)) == text


def test_tokens_stay_apart_where_merging_gives_just_the_two():
    from tonality.llm.bpe import Transducer, read_ranks
    ranks = read_ranks(RANKS)
    machine, rng, found = Transducer(ranks), random.Random(6), set()
    by_first = {}
    for t in ranks:
        by_first.setdefault(t[:1], []).append(t)
    for _ in range(3000):
        last = rng.choice(list(by_first[rng.choice([b"a", b"t", b" ", b"e", "漢".encode()[:1]])]))
        new = rng.choice(by_first[rng.choice([b"a", b"t", b"h", b"e", b"s"])])
        parts = [bytes([b]) for b in last + new]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        found.add(parts == [last, new])
        assert machine._stay_apart(ranks[last], ranks[new]) == (parts == [last, new]), (last, new)
    assert found == {True, False}


def test_a_table_with_a_token_that_its_bytes_never_merge_into():
    from tonality.llm.bpe import Transducer
    machine = Transducer({b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"abc": 4, b"ab": 5, b"cab": 6})
    assert [machine(p) for p in (b"abc", b"abab", b"cabc", b"bcab")] == [[4], [5, 5], [2, 4], [3, 5]]
    assert not machine._stay_apart(0, 3)


def test_a_word_is_remembered_once():
    from tonality.llm.bpe import Encoder
    own = Encoder(RANKS, P.PATTERN)
    own("zwolf quandrel, zwolf")
    assert set(own.memo) == {"", "zwolf", " quandrel,", " quandrel", ",", " zwolf"}


def test_incomplete_characters_wait_and_bad_bytes_are_replaced():
    from tonality.llm.bpe import Utf8Stream
    machine = Utf8Stream()
    assert [machine.feed(bytes([b])) for b in "é🙂".encode()] == ["", "é", "", "", "", "🙂"]
    assert machine.feed(b"\xe6\xbc") == "" and machine.flush() == "�"
    assert machine.feed(b"a\xffb") == "a�b"


def test_bpe_round_trip_in_spark(spark):
    from tonality.llm import bpe
    docs = frame(spark, EDGE)
    tokens = bpe.encode(docs, RANKS, P.PATTERN)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(tokens, RANKS, P.PATTERN).collect()} == {i: t or "" for i, t in enumerate(EDGE)}
    ids = {r["doc_id"]: r["ids"] for r in tokens.collect()}
    for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect():
        own = ids[r["doc_id"]]
        assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((EDGE[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.round_trip(docs.where("false"), RANKS, P.PATTERN).count() == 0


# --- quality ------------------------------------------------------------------------------------------------------------
def test_quality_on_the_held_out_fold(spark):
    from tonality.llm.quality import classify
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 100 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)


def test_quality_of_edge_cases(spark):
    from tonality.llm.quality import classify
    docs, none = frame(spark, EDGE), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in classify(docs, none).collect()] == [0.5] * len(EDGE)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(EDGE))] + [(None, 1, 0), (3, None, 0)], none.schema)
    rows = {r["doc_id"]: r["score"] for r in classify(docs, labels).collect()}
    assert len(rows) == len(EDGE) and all(0 <= s <= 1 for s in rows.values()) and rows[0] == rows[1] and rows[10] == rows[11]
    assert classify(docs.where("false"), labels).count() == 0


def test_flattened_trees_separate_what_one_threshold_cannot():
    from tonality.llm.quality import grow
    x = np.random.default_rng(0).uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = grow(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95


# --- vectors ------------------------------------------------------------------------------------------------------------
def test_pivot_index_against_all_pairs(spark, monkeypatch):
    from tonality.llm import pivots
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24))
    rows = []
    for c in centres:
        for _ in range(int(rng.integers(1, 12))):
            rows.append((c + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12, 0.2])).astype(np.float32).tolist())
    rows += [(np.array(rows[0]) * 2).tolist()] * 40  # one crowd of equal vectors, with a different length
    rows += [None, [0.0] * 24, [], [float("nan")] * 24, [1.0, None] + [0.0] * 22, [float("inf")] + [1.0] * 23, [3.0, 4.0], [6.0, 8.0]]
    labels = [None if i % 17 == 0 else i % 2 for i in range(len(rows))]
    labels[-2:] = [0, 0]
    table = spark.createDataFrame([Row(vec_id=i, embedding=v, label=k, component_id="x") for i, (v, k) in enumerate(zip(rows, labels, strict=True))],
                                  "vec_id long, embedding array<float>, label int, component_id string")
    got = {r["vec_id"]: r for r in pivots.near_duplicates(table).collect()}
    ok = [k is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for v, k in zip(rows, labels, strict=True)]
    links, group = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(rows[i]) == len(rows[j]):
                a, b = np.array(rows[i], float), np.array(rows[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    lo, hi = sorted((group[i], group[j]))
                    group = [lo if g == hi else g for g in group]
    found = [got[i]["n_links"] for i in range(len(rows))]
    assert all(f <= n for f, n in zip(found, links, strict=True)) and sum(found) >= 0.98 * sum(links)
    assert np.mean([got[i]["component_id"] == g for i, g in enumerate(group)]) >= 0.98
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(len(rows)) if not ok[i])
    assert pivots.near_duplicates(table.where("false")).count() == 0


# --- language -----------------------------------------------------------------------------------------------------------
def test_language_on_the_held_out_fold(spark):
    from tonality.llm.crf import classify
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = classify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)


def test_language_of_edge_cases_and_words(spark):
    from tonality.llm import crf
    en, de = "the thing was there with this other one that they have", "der mann ist nicht hier und das haus wird sehr schön sein"
    docs = frame(spark, [en, de] * 40).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = crf.fit(docs)
    edge = frame(spark, EDGE, 1000)
    rows = {r["doc_id"] - 1000: r["r"] for r in edge.select("doc_id", crf.identify(edge, model).alias("r")).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, 3, 6)] == ["und"] * 5 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[4]["lang_pred"] in ("en", "de")
    mixed = frame(spark, [en + " " + de, None])
    words = crf.label_words(mixed, model).orderBy("doc_id").collect()
    langs = [w["lang"] for w in words[0]["words"]]
    assert langs == ["en"] * 11 + ["de"] * 12 and words[1]["words"] == []
    assert {r["lang_pred"] for r in crf.classify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert crf.classify(edge.where("false")).count() == 0


def test_language_fits_on_whole_texts(spark, monkeypatch):
    """Words after the first few thousand teach too, a language whose texts are all long is learned, and refits agree."""
    from tonality.llm import crf
    filler = "12345 " * 2500
    rows = [(i, (filler if i % 2 else "") + " ".join(["sol mar luz", "bok hus tre"][i % 2].split() * 4), ["aa", "bb"][i % 2])
            for i in range(1, 121)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    monkeypatch.setattr(crf, "SAMPLE_CHARS", 10_000)
    model = crf.fit(docs)
    assert model.langs == ["aa", "bb"] and model.key == crf.fit(docs.repartition(3)).key
    asked = spark.createDataFrame([(1, "hus bok tre"), (2, "luz sol"), (3, filler + "hus tre")], "doc_id long, text string")
    got = {r["doc_id"]: r["r"]["lang_pred"] for r in asked.select("doc_id", crf.identify(asked, model).alias("r")).collect()}
    assert got == {1: "bb", 2: "aa", 3: "bb"}


def test_forward_backward_against_enumeration():
    from itertools import product

    from tonality.llm.crf import forward_backward
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    mask = np.array([[True] * 4, [True, True, True, False]])
    p, moves = forward_backward(e, t, mask)
    want_moves = np.zeros((3, 3))
    for c in range(2):
        n = mask[c].sum()
        want, total, own_moves = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            w = np.exp(sum(e[c, i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            for i, y in enumerate(path):
                want[i, y] += w
            for a, b in zip(path, path[1:], strict=False):
                own_moves[a, b] += w
        assert np.allclose(p[c, :n], want / total)
        want_moves += own_moves / total
    assert np.allclose(moves, want_moves)


# --- HTML ---------------------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no, no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use, cookies, and, more, of them.</div>
<div id="wrap"><div class="post"><h2>A title</h2><p>First paragraph, with some   text &amp; more, <b>bold<br>words</b> &#233;.<p>Second one, also, long enough to count.
</p><ul><li>item one</li><li>item two</ul></div><div class="post"><p>Third part, of the same, story, with more words in it.</p></div>
<div id="comments"><p>I, too, have, much, to, say, about, this, text, and, that.</p></div><aside><p>Other, stories, for, you</p></aside></div>
<form><p>Your name, please</p></form><footer>&copy; us, 2024</footer></body></html>"""


def test_main_text_of_a_page():
    from tonality.llm.html import main_text
    assert main_text(PAGE) == ("A title\nFirst paragraph, with some text & more, bold words é.\nSecond one, also, long enough to count.\n"
                               "item one\nitem two\nThird part, of the same, story, with more words in it.")
    article = "<body><div><p>x, y, z, long text of a teaser, with commas, many</p></div><article><section><p>One, two.</p></section><p>Three.</p></article>"
    assert main_text(article).endswith("One, two.\nThree.")


LONG = "<p>Paragraph {} of the text, with commas, and with words enough to be taken for prose, surely.</p>"
STORY = "<h1>Title</h1>" + "".join(map(LONG.format, range(5)))
SIDE = f'<div class="sidebar">{LONG.format("S")}</div>'


@pytest.mark.parametrize("page", [
    '<nav><a href="x">Home</a></nav><form id="aspnetForm"><input name="v"><div id="main">{story}</div><button>Go</button></form>',
    '<form>{side}<article>{story}</article></form><footer>us</footer>',
    '<div class="layout has-sidebar"><div class="content">{story}</div>{side}</div>',
    '<div class="wrapper no-sidebar"><article>{story}</article></div>',
    '<div class="banner-page"><div class="sidebar-layout"><div>{story}</div>{side}</div></div>',
    '<div class="sidebar-layout"><div>{story}</div><div id="comments">{story}{story}{story}</div></div>',
    '<article>{story}</article><div class="cookie-notice">{side}{story}</div><div id="comments">{story}{story}{story}</div>',
    '<article>{story}<form><label>Mail</label><p>Sign up</p></form><div class="related"><a href="x">More</a></div>'
    '<section class="comments">{story}</section></article>'])
def test_names_and_forms_that_wrap_a_page(page):
    from tonality.llm.html import main_text
    want = main_text(f"<article>{STORY}</article>")
    assert len(want.split("\n")) == 6
    assert main_text("<body>" + page.format(story=STORY, side=SIDE)) == want


def test_named_sections_of_an_article():
    from tonality.llm.html import main_text
    sections = (f'<section id="discussion"><h2>Discussion</h2>{LONG.format("D")}</section><form>{LONG.format("F") * 2}</form>'
                '<div class="related-work"><h2>Work</h2><p>Short.</p></div><div class="social-history"><p>Smoker.</p></div>')
    plain = re.sub("<(/?)(?:section|div|form)[^>]*>", "", STORY + sections)
    assert main_text(f"<article>{STORY}{sections}</article>") == main_text(f"<article>{plain}</article>")


def test_sections_without_an_article():
    from tonality.llm.html import main_text
    long = "A long section, of many, many words, that goes on and on, and wins over its parent. " * 8
    page = f"<body><div><h1>T</h1><div>{long}</div><h2>H</h2><div>Short one.</div></div>"
    assert main_text(page).split("\n") == ["T", long.strip(), "H", "Short one."]


def test_pages_without_article_against_their_parts():
    """Random texts of headings, paragraphs, lists, quotes, code and sections in wrappers, with menus and adverts between."""
    from tonality.llm.html import main_text
    rng, number = random.Random(11), iter(range(10**9))
    for _ in range(400):
        want = []

        def say(n, want=want):
            want.append(f"{next(number)} " + " ".join(rng.choice(WORDS) + rng.choice(["", "", ","]) for _ in range(n)))
            return want[-1]

        def part(say=say):
            kind = rng.randrange(8)
            return [
                lambda: f"<p>{say(40)}</p>", lambda: f"<p>{say(4)}</p>", lambda: f"<pre>{say(6)}</pre>",
                lambda: f"<blockquote>{say(12)}</blockquote>", lambda: f"<div>{say(30)}</div>",
                lambda: f"<ul><li>{say(3)}</li><li>{say(5)}</li></ul>",
                lambda: f"<figure><figcaption>{say(5)}</figcaption></figure>", lambda: f"<p>{say(25)}</p>"][kind]()

        def junk():
            return rng.choice(["", "", "<nav><a href='/'>Home</a></nav>", "<div class='ad'>Buy, now, and, more</div>"])

        page, wrap = f"<h1>{say(3)}</h1><p>{say(40)}</p>", rng.random() < 0.5
        for _ in range(rng.randint(1, 5)):
            head, body = f"<h2>{say(2)}</h2>", "".join(part() for _ in range(rng.randint(1, 4)))
            if rng.random() < 0.4:
                body = f"<div>{body}</div>"
            page += junk() + (f"<div class='part'>{head}{body}</div>" if wrap else head + body)
        page = rng.choice(["<body>{}", "<body><div id='a'><div>{}</div></div>", "<body><div id='a'>{}</div>"]).format(page)
        assert main_text(f"{page}<footer>us</footer>").split("\n") == want, page


def test_broken_pages(spark):
    from tonality.llm.html import extract, main_text
    assert [main_text(x) for x in (None, "", "<", "<p", "<!--", "<script>x", "</p></p>", "<a href='")][:2] == ["", ""]
    assert main_text("just text &lt; here") == "just text < here"
    for odd in ("<div>" * 5_000 + "x", "<a href=\"" * 5_000, "<" * 50_000, "<p>a,b" * 5_000, "</p>" * 5_000 + "</b>" * 5_000):
        main_text(odd)
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, PAGE, "x"), (None, "u", None, None)], "page_id long, url string, html string, text string")
    got = extract(rows).collect()
    assert sorted(r["n_chars"] for r in got) == sorted([0, len(main_text(PAGE)), len(main_text(PAGE))])
    assert extract(rows.where("false")).count() == 0


# --- fingerprints -------------------------------------------------------------------------------------------------------
def brute_signature(spark, text, width=8):
    """The selected tuples over the k-mers at every code point, step by step; hashes come from Spark."""
    kmers = [text[i:i + width] for i in range(max(1, len(text) - width + 1))] if text else []
    if not kmers:
        return []
    low, seen, numbered = (1 << 37) - 1, {}, []
    firsts = [r[0] for r in spark.createDataFrame([(bytearray(x.encode("utf-32-be")),) for x in kmers], "a binary").select(F.xxhash64("a")).collect()]
    for i, h in enumerate(firsts):
        h = h >> 26 & low
        seen[h] = seen.get(h, -1) + 1
        numbered.append((h, seen[h], i))
    again = [r[0] for r in spark.createDataFrame([(h, o) for h, o, _ in numbered], "h long, o int").select(F.xxhash64("h", "o")).collect()]
    parts = {}
    for g, (h, o, i) in zip(again, numbered, strict=True):
        h = g & low if o else h
        parts.setdefault(h >> 31, []).append((h, i))
    out = []
    for part in sorted(parts):
        own = sorted(sorted(parts[part])[:2], key=lambda x: x[1])
        out.append((part, own[0][0], own[1][0] if len(own) > 1 else None))
    hashed = [r[0] for r in spark.createDataFrame(out, "p long, a long, b long").coalesce(1).select(F.xxhash64("a", "b")).collect()]
    return [f"{(p << 32) | (h & 0xFFFFFFFF):010x}" for (p, _, _), h in zip(out, hashed, strict=True)]


def test_fingerprints_against_brute_force(spark):
    from tonality.llm.fingerprints import fingerprints
    rng = random.Random(6)
    texts = EDGE + [prose(rng, 120), "a" * 300, "go " * 40 + "stop\n " * 5, "🙂é漢" * 9, "短い" * 3, "abcdefgh", "abcdefg", prose(rng, 300)]
    rows = {r["doc_id"]: r for r in fingerprints(frame(spark, texts)).collect()}
    full, prints = [t or "" for t in texts], {}
    for i, t in enumerate(full):
        after, n = full[i - 1], len(t)  # descending ids: the next is the one before, after the first comes the last
        edited = t[:n - n // 2] + after[:n // 2]
        assert rows[i]["n_chars"] == n and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for s, name in ((t, "fingerprint"), (edited, "edited_fingerprint")):
            if len(s) <= 30_000:
                prints[i, name] = brute_signature(spark, s)
                assert rows[i][name] == "".join(prints[i, name]), (i, name)
    assert rows[10]["fingerprint"] == rows[11]["fingerprint"] and rows[0]["fingerprint"] == ""

    def like(a, b):
        both = {x[:2] for x in a + b}
        return len(set(a) & set(b)) / len(both) if both else 1.0

    for i in range(len(texts)):
        if (i, "fingerprint") in prints and (i, "edited_fingerprint") in prints:
            assert rows[i]["near_edited"] == pytest.approx(like(prints[i, "fingerprint"], prints[i, "edited_fingerprint"]))
        if (i, "fingerprint") in prints and ((i - 1) % len(texts), "fingerprint") in prints:
            assert rows[i]["near_next"] == pytest.approx(like(prints[i, "fingerprint"], prints[(i - 1) % len(texts), "fingerprint"]))


def test_fingerprints_follow_edits(spark):
    """One more character in a text without blanks leaves most of it alike; white space counts."""
    from tonality.llm.fingerprints import likeness, with_text_signature
    rng = random.Random(9)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3_000))
    pairs = [(text, text[:5] + "x" + text[5:]), (text, text[::-1]), ("one two three four", "one  two  three  four"), (text, text[1500:] + text[:1500])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for c in "ab":
        df = with_text_signature(df, c, f"s{c}")
    got = {r[0]: r[1] for r in df.select("i", likeness(F.col("sa"), F.col("sb"))).collect()}
    assert got[0] > 0.9 and got[1] < 0.1 and got[2] < 1 and 0.2 < got[3] < 0.8


def test_fingerprints_of_few_rows(spark):
    from tonality.llm.fingerprints import fingerprints
    one = fingerprints(frame(spark, ["abcdef"])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one[0]["near_next"] == 1.0
    assert fingerprints(frame(spark, ["x"]).where("false")).count() == 0
    nulls = frame(spark, ["some words here", "other words there", "third"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert fingerprints(nulls).count() == 3
    twice = frame(spark, ["same text here", "same text here", None]).withColumn("doc_id", F.lit(5).cast("long"))
    assert sorted(r["near_next"] for r in fingerprints(twice).collect())[-1] == 1.0
