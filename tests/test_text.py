from pyspark.sql import functions as F

from tonality.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first().o


def test_strip_dashes_fuses_words(spark):
    assert one(spark, T.strip_dashes, "well-known - x") == "wellknown  x"


def test_clean_text_full_chain(spark):
    raw = "Café 😀 — don't   go!!!\r\n\r\n  Straße  "
    assert one(spark, T.clean_text, raw) == "cafe - don't go!!!\nstrasse"


def test_fold_ascii_quotes_ligatures(spark):
    assert one(spark, T.fold_ascii, "“Œuvre” naïve ‘x’ …") == '"OEuvre" naive \'x\' ...'


def test_emoji_removed(spark):
    assert one(spark, T.strip_emoji, "hi😀☀️!") == "hi!"


def test_tokenize_contractions_and_punctuation(spark):
    toks = one(spark, lambda c: T.tokenize(T.clean_text(c)), "Don't stop, it's fine?!")
    assert toks == ["do", "n't", "stop", ",", "it", "'s", "fine", "?", "!"]


def test_extract_words_ascii(spark):
    assert one(spark, T.extract_words, "a_b, c1! d") == ["a_b", "c1", "d"]


def test_null_text_stays_null(spark):
    assert one(spark, T.clean_text, None) is None


def test_other_scripts_are_spelled_or_kept(spark):
    assert one(spark, T.clean_text, "Привет мир!") == "privet mir!"
    assert one(spark, T.clean_text, "Ελλάδα") == "ellada"
    assert one(spark, T.clean_text, "안녕 하세요") == "annyeong haseyo"
    assert one(spark, T.clean_text, "漢字 עברית") == "漢字 עברית"
    assert one(spark, T.extract_words, "안녕 하세요, ok") == ["안녕", "하세요", "ok"]


def column(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in df.select("i", fn("t").alias("o")).orderBy("i").collect()]


def test_broken_unicode_is_repaired(spark):
    whole = ["café", "don’t “stop” – now…", "Là où ça été", "Größe Öl Äpfel", "naïve 😀 漢字", "Ελλάδα", "Привет мир", "žluťoučký kůň", "100 € £5 ½", "ÉCOLE À PARIS", "CIÓN DIPLÔME ESPAÑA",
             "plain", "", None]
    cp1252 = [t and t.encode().decode("cp1252", "replace") for t in whole]
    broken = [t and "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in t.encode()) for t in whole]
    latin = [t and t.encode().decode("latin-1") for t in whole]
    assert broken != whole and cp1252 != whole
    assert column(spark, broken, T.repair_unicode) == whole
    assert column(spark, latin, T.repair_unicode) == whole


def test_clean_text_is_not_repaired(spark):
    clean = ["« café »", "«café»\u00a0!", "CAFÉ» « À »", "É», Ñ» Ç” É’", "über – straße…", "Ã", "IRMÃ» É°", "x² + é³", "año’ ñ“ ö»\u00a0", "日本語 한글", "1°–2°", "Çà et là »"]
    assert column(spark, clean, T.repair_unicode) == clean
    assert column(spark, ["CafÃ©  -A", "ＡB"], T.clean_text)[0] == "cafe a"


def test_kana_and_hangul_are_spelled(spark):
    texts = ["ひらがな カタカナ", "ッしゃー", "한글 서울 닭", "ㄱㅏ ｶﾅ", "漢か字", "ᄒ", "ゝヽ゛ゟヿ"]
    assert column(spark, texts, T.fold_ascii) == ["hiragana katakana", "tusiya", "hangeul seoul dalg", "ga kana", "漢ka字", "h", "yorikoto"]
    every = "".join(chr(c) for lo, hi in ((0x1100, 0x11FF), (0x3041, 0x318E), (0x31F0, 0x31FF), (0xA960, 0xA97C), (0xAC00, 0xD7FB), (0xFF66, 0xFFDC)) for c in range(lo, hi + 1))
    import unicodedata
    left = column(spark, [every], T.fold_ascii)[0]
    assert not [c for c in left if any(x in unicodedata.name(c, "") for x in ("HANGUL", "HIRAGANA", "KATAKANA"))]


def test_signs_are_folded_by_one_table(spark):
    """Every sign that takes several letters of ASCII has its place in the table, beside kana and Hangul; others stay."""
    first, signs = T.sign_table()
    _, _, multi, letters = T.fold_tables()
    for ch, spelling in [*multi, *letters, *T.spelled_syllables().items(), ("한", "han"), ("漢", "漢")]:
        assert signs[ord(ch) - first] == spelling
    text = "".join(ch for ch, _ in [*multi, *letters]) + "かッ글닭漢字aé\U00020000Ω"
    row = spark.createDataFrame([(text,)], "t string").select(T.fold_ascii("t"), T.fold_ascii(F.concat(F.lit("x"), "t"))).first()
    rest = "".join(s for _, s in [*multi, *letters])
    assert row[0] == f"{rest}katsugeuldalg漢字ae\U00020000O" or row[0].startswith(rest) and row[1] == "x" + row[0]


def test_loose_space_is_seen(spark):
    """Texts of blanks and line breaks in every order, the guarded form against the whole one."""
    import itertools
    texts = ["".join(p) for n in range(5) for p in itertools.product("a \n\r\t\u2028", repeat=n)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~T.normalize_space("t").eqNullSafe(T._tight_space(F.col("t")))).count() == 0
