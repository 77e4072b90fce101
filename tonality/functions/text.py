"""Text cleaning and tokenising as Column -> Column functions (JVM-side, no UDF).

The cleaning order is: delete ASCII '-', repair broken Unicode, lower-case, remove
emoji, fold to ASCII, normalise white space.  Tokenising splits contractions ("don't" ->
"do", "n't") and keeps punctuation marks as tokens.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonality.functions.lookup import let

ColumnOrName = Column | str

# FIXED VALUES — emoji / pictograph code point ranges removed by strip_emoji.
EMOJI_PATTERN = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{200D}\x{20E3}]"

# FIXED VALUES — characters without a canonical decomposition: code point -> ASCII.
FOLD_SPECIAL: list[tuple[str, str]] = [
    ("ß", "ss"), ("ẞ", "SS"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"),
    ("ø", "o"), ("Ø", "O"), ("đ", "d"), ("Đ", "D"), ("ð", "d"), ("Ð", "D"),
    ("ł", "l"), ("Ł", "L"), ("þ", "th"), ("Þ", "TH"), ("ı", "i"), ("ħ", "h"), ("Ħ", "H"),
    ("‘", "'"), ("’", "'"), ("‚", "'"), ("‛", "'"), ("′", "'"),
    ("“", '"'), ("”", '"'), ("„", '"'), ("‟", '"'), ("″", '"'),
    ("«", '"'), ("»", '"'),
    ("‐", "-"), ("‑", "-"), ("‒", "-"), ("–", "-"), ("—", "-"),
    ("―", "-"), ("−", "-"),
    ("…", "..."), ("\u00a0", " "), ("\u2009", " "), ("\u202f", " "), ("\u3000", " "),
]

# Letters folded by rule: every code point of Latin-1 Supplement and Latin
# Extended-A/B whose canonical decomposition is one ASCII letter followed by
# combining marks maps to that letter.
_FOLD_RANGES = ((0x00C0, 0x024F), (0x1E00, 0x1EFF))

# Letters of these scripts are spelled by a rule from their Unicode names (see ``spelled``).
_SPELLED_RANGES = ((0x0370, 0x03FF), (0x0400, 0x052F))

# Letters of these scripts are spelled by their Unicode names, a syllable at a time (see ``spelled_syllables``).
_KANA_RANGES = ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))
_JAMO_RANGES = ((0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2), (0x3131, 0x318E), (0xFFA1, 0xFFDC))
SYLLABLE_CLASS = r"[\x{1100}-\x{11FF}\x{3041}-\x{318E}\x{31F0}-\x{31FF}\x{A960}-\x{A97C}\x{AC00}-\x{D7FB}\x{FF66}-\x{FFDC}]"

#: Letters of these scripts may take several letters of ASCII.
SCRIPT_CLASS = rf"[\x{{370}}-\x{{52F}}{SYLLABLE_CLASS[1:-1]}]"

# FIXED VALUES - romanised Hangul letters by their place in a syllable: initial, medial, final.
HANGUL_INITIAL = "g kk n d tt r m b pp s ss - j jj ch k t p h".replace("-", "").split(" ")
HANGUL_MEDIAL = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
HANGUL_FINAL = " g kk gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j ch k t p h".split(" ")

ASCII_PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
LETTERS = r"\p{L}\p{M}\p{N}_"
ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_"  # one by one: a table of bits, the commonest signs first
TOKEN_PATTERN = rf"n't|'[a-z]+|[{ASCII_LETTERS}]+[{LETTERS}]*|[{LETTERS}]+|[^\s{LETTERS}]"
#: ``TOKEN_PATTERN`` for text of ASCII only; each sign named, for a table of bits.
ASCII_WORD = ASCII_LETTERS + ASCII_LETTERS[:26].upper()
ASCII_TOKEN_PATTERN = rf"[{ASCII_WORD.replace('n', '')}][{ASCII_WORD}]*|n't|[{ASCII_WORD}]+|'[a-z]+|[^ \t\n\x0B\f\r{ASCII_WORD}]"
WORD_PATTERN = rf"[{ASCII_LETTERS}]+[{LETTERS}]*|[{LETTERS}]+"
#: What folding removes: signs outside ASCII.  Letters without a known ASCII form stay as they are.
UNFOLDED_PATTERN = rf"[^\x00-\x7F{LETTERS}]"


def spelled(ch: str) -> str | None:
    """ASCII spelling of a Greek or Cyrillic letter from its Unicode name: a consonant's name without the vowel that
    makes it a syllable (``BE`` -> b, ``EL`` -> l, ``ZHE`` -> zh), a vowel's first letter, nothing for a sign."""
    base = unicodedata.normalize("NFD", ch)[0]
    name = unicodedata.name(base, "")
    m = re.fullmatch(r"(GREEK|CYRILLIC) (CAPITAL|SMALL) LETTER (?:FINAL |SHORT )?([A-Z]+)( SIGN)?", name)
    if not m:
        return None
    if m[4]:
        return ""
    word = m[3].lower()
    if m[1] == "GREEK":
        out = word[:2] if word[:2] in ("th", "ph", "ch", "ps") else word[0]
    elif word[0] == "y":
        out = word[:2] if len(word) == 2 else word[0]
    elif word[0] in "aeiou":  # a vowel, or a consonant named after one
        out = word[1:] if len(word) == 2 else word[0]
        out = word if word in ("i", "u") else out
    else:
        out = word.rstrip("aeiou").replace("gh", "g")
    return out.upper() if m[2] == "CAPITAL" else out


def spelled_syllables() -> dict[str, str]:
    """ASCII spelling of kana and of single Hangul letters: the last word of a kana's Unicode name (``HIRAGANA LETTER SMALL TU``
    -> tu), nothing for marks; a Hangul letter as in a syllable."""
    out = {}
    for lo, hi in _KANA_RANGES:
        for cp in range(lo, hi + 1):
            name = unicodedata.name(chr(cp), "")
            m = re.fullmatch(r"(?:HALFWIDTH )?(?:HIRAGANA|KATAKANA) (?:LETTER |DIGRAPH )(?:SMALL )?([A-Z]+)", name)
            if m:
                out[chr(cp)] = m[1].lower()
            elif "HIRAGANA" in name or "KATAKANA" in name:
                out[chr(cp)] = ""
    for lo, hi in _JAMO_RANGES:
        for cp in range(lo, hi + 1):
            base = unicodedata.normalize("NFKD", chr(cp))
            at = ord(base[0]) if len(base) == 1 else 0
            if 0x1100 <= at <= 0x1112:
                out[chr(cp)] = HANGUL_INITIAL[at - 0x1100]
            elif 0x1161 <= at <= 0x1175:
                out[chr(cp)] = HANGUL_MEDIAL[at - 0x1161]
            elif 0x11A8 <= at <= 0x11C2:
                out[chr(cp)] = HANGUL_FINAL[at - 0x11A7]
    return out


@lru_cache(maxsize=None)
def sign_table() -> tuple[int, list[str]]:
    """The first sign outside ASCII, and what becomes of each from it to the last one of ``SYLLABLE_CLASS``: letters that take several
    of ASCII, kana and Hangul letters spelled, old and rare ones left out, other signs as they are."""
    _, _, multi, letters = fold_tables()
    known = spelled_syllables() | dict(letters) | dict(multi)
    inside = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), SYLLABLE_CLASS))

    def one(cp: int) -> str:
        n = cp - 0xAC00
        if 0 <= n <= 0xD7A3 - 0xAC00:
            return HANGUL_INITIAL[n // 588] + HANGUL_MEDIAL[n % 588 // 28] + HANGUL_FINAL[n % 28]
        if 0xD800 <= cp <= 0xDFFF:  # halves of other signs, never signs themselves
            return ""
        return known.get(chr(cp), "" if inside.match(chr(cp)) else chr(cp))

    return 0x80, [one(cp) for cp in range(0x80, 0xFFDC + 1)]


def _fold_signs(c: Column) -> Column:
    """Signs replaced by ``sign_table``: one look into it by a sign's number, however many signs it has."""
    first, signs = sign_table()
    table = F.split(F.lit("\x00".join(signs)), "\x00")  # no entry is this sign; the optimizer folds it into an array

    def one(ch: Column) -> Column:
        return let(F.ascii(ch) - first, lambda n: F.when((n < 0) | (n >= len(signs)), ch).otherwise(F.get(table, n)))

    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.when(F.octet_length(ch) < 2, ch).otherwise(one(ch))), "")


# Bytes 0x80 to 0x9F as the signs that Windows-1252 shows for them, and as the control signs that Latin-1 has there.
_SIGNS = {ch: chr(b) for b in range(0x80, 0xA0) if (ch := bytes([b]).decode("cp1252", "ignore"))}
_AFTER = "\x80-\xBF" + "".join(_SIGNS)
_CLOSING = "\xA0«»‘’“”–—…‹›•°´·"
_INNER = "(?:(?![" + _CLOSING + "])[" + _AFTER + "])"
#: UTF-8 that was read as Windows-1252 or Latin-1: a first byte of a character and its further bytes, as letters.  Letters of clean
#: text with closing marks behind them do not match: a mark that ends a word does not follow capitals or other first letters.
BROKEN_PATTERN = (
    "[ð-ô][" + _AFTER + "]{3}"
    "|[à-ï](?=[" + _AFTER + "]{0,1}" + _INNER + ")[" + _AFTER + "]{2}"
    "|[ÂÃ]" + _INNER + "|(?<![A-ZÀ-Þ]{2})[ÂÃ][" + _CLOSING + "]|[ÂÃ](?:[‘“–—]|[" + _CLOSING + "](?=[A-Za-z]))"
    "|[Ä-ß]" + _INNER + "(?:[Â-ß][" + _AFTER + "])*"
    "|(?:[Ä-ß][" + _AFTER + "]){2,}")

#: What a text must hold for the repair, or for the letters of other scripts, to change it.
RARE_PATTERN = "[Â-ô][" + _AFTER + "]|" + SCRIPT_CLASS


#: Texts of ASCII and Latin-1 letters, which hold nothing of ``RARE_PATTERN``; each sign named, for a table of bits.
LATIN_PATTERN = "^[" + "".join(rf"\x{b:02X}" for b in (*range(0x80), *range(0xC0, 0x100))) + "]*+\\z"


def repair_unicode(c: ColumnOrName) -> Column:
    """UTF-8 that was decoded as Windows-1252 or Latin-1 (``cafÃ©``, ``donâ€™t``) decoded again; other text stays.

    Only the broken places are re-decoded.  A place that is not valid UTF-8 stays as it is.
    """
    text = _col(c)
    signs = "".join(_SIGNS)

    def mended(broken: Column) -> Column:
        raw = F.encode(F.translate(broken, signs, "".join(_SIGNS.values())), "ISO-8859-1")
        return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(broken)

    places = F.regexp_extract_all(text, F.lit(BROKEN_PATTERN), F.lit(0))
    whole = F.array_join(F.flatten(F.zip_with(
        F.split(text, BROKEN_PATTERN, -1), places, lambda between, broken: F.array(between, F.coalesce(mended(broken), F.lit(""))))), "")
    return F.when(text.rlike(BROKEN_PATTERN), whole).otherwise(text)


@lru_cache(maxsize=None)
def fold_tables() -> tuple[str, str, list[tuple[str, str]], list[tuple[str, str]]]:
    """(from, to) strings for ``translate``, the multi-character replacements, and those of spelled letters."""
    src, dst, multi, letters = [], [], [], []
    special = dict(FOLD_SPECIAL)
    for lo, hi in _FOLD_RANGES:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            if ch in special:
                continue
            dec = unicodedata.normalize("NFD", ch)
            if (len(dec) >= 2 and dec[0].isascii() and dec[0].isalpha()
                    and all(unicodedata.category(c) == "Mn" for c in dec[1:])):
                src.append(ch)
                dst.append(dec[0])
    for lo, hi in _SPELLED_RANGES:
        for cp in range(lo, hi + 1):
            out = spelled(chr(cp))
            if out is not None and len(out) == 1:
                src.append(chr(cp))
                dst.append(out)
            elif out is not None:
                letters.append((chr(cp), out))
    for ch, rep in FOLD_SPECIAL:
        if len(rep) == 1:
            src.append(ch)
            dst.append(rep)
        else:
            multi.append((ch, rep))
    return "".join(src), "".join(dst), multi, letters


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_dashes(c: ColumnOrName) -> Column:
    """Delete every ASCII '-' (words fuse: well-known -> wellknown)."""
    return F.replace(_col(c), F.lit("-"), F.lit(""))


def lower_text(c: ColumnOrName) -> Column:
    return F.lower(_col(c))


def strip_emoji(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), EMOJI_PATTERN, "")


def fold_ascii(c: ColumnOrName) -> Column:
    """Closest-ASCII folding: accents dropped, ligatures expanded, Greek, Cyrillic, kana and Hangul spelled, other signs
    removed.

    Letters of scripts without a spelling rule are kept: removing them would empty the text.
    """
    return F.when(_col(c).rlike(SCRIPT_CLASS), _fold(_col(c), True)).otherwise(_fold(_col(c), False))


def _fold(c: Column, scripts: bool) -> Column:
    """``fold_ascii``, with letters that take several of ASCII in ``scripts`` other than Latin."""
    src, dst, _, _ = fold_tables()
    out = F.translate(c, src, dst)
    if scripts:
        return F.regexp_replace(_fold_signs(out), UNFOLDED_PATTERN, "")
    return _or_if_ascii(out, _unfolded)


def _unfolded(c: Column) -> Column:
    """Text after ``translate``: letters that take several of ASCII replaced, other signs removed."""
    for ch, rep in fold_tables()[2]:
        c = F.replace(c, F.lit(ch), F.lit(rep))
    return _or_if_ascii(c, lambda x: F.regexp_replace(x, UNFOLDED_PATTERN, ""))


def is_ascii(c: Column) -> Column:
    """Whether a text has as many bytes as characters."""
    return F.octet_length(c) == F.char_length(c)


def _or_if_ascii(c: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a text that holds more than ASCII, of which it would change nothing."""
    return let(c, lambda x: F.when(is_ascii(x), x).otherwise(step(x)))


#: What a text must hold for ``normalize_space`` to change it.
LOOSE_SPACE_PATTERN = r"[ \n\r\t\f\x0B](?:[ \n]|$|(?<=[\r\t\f\x0B])|(?<=^[ \n]))"


def normalize_space(c: ColumnOrName) -> Column:
    """CR/LF -> LF, runs of blanks -> one space, blank lines collapsed, ends trimmed."""
    return let(_col(c), lambda x: F.when(x.rlike(LOOSE_SPACE_PATTERN), _tight_space(x)).otherwise(x))


def _tight_space(c: Column) -> Column:
    out = F.regexp_replace(c, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\f\x0B]+", " ")
    out = F.regexp_replace(out, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def clean_text(c: ColumnOrName) -> Column:
    """strip_dashes -> repair_unicode -> lower -> strip_emoji -> fold_ascii -> normalize_space.

    Text of ASCII only, which has as many bytes as characters, has nothing to repair, remove or fold.
    """
    def folded(text: Column) -> Column:
        lowered = lower_text(strip_dashes(text))
        whole = strip_emoji(lower_text(repair_unicode(strip_dashes(text))))
        src, dst, _, _ = fold_tables()
        # most texts need neither repair nor other scripts' letters: one look at the raw text tells
        return (F.when(is_ascii(text), lowered)
                .when(text.rlike(LATIN_PATTERN) | ~text.rlike(RARE_PATTERN),
                      _or_if_ascii(F.translate(lowered, src, dst), lambda x: _unfolded(strip_emoji(x))))
                .otherwise(_fold(whole, True)))

    return normalize_space(let(_col(c), folded))


def tokenize(c: ColumnOrName) -> Column:
    """Word tokens of cleaned text; punctuation marks are tokens, "n't" is split off."""
    split_neg = let(_col(c), lambda x: F.when(F.contains(x, F.lit("n't")), F.regexp_replace(x, r"n't\b", " n't")).otherwise(x))
    return let(split_neg, lambda x: F.when(is_ascii(x), F.regexp_extract_all(x, F.lit(ASCII_TOKEN_PATTERN), 0))
               .otherwise(F.regexp_extract_all(x, F.lit(TOKEN_PATTERN), 0)))


def extract_words(c: ColumnOrName) -> Column:
    """Runs of letters, digits and underscores (the words of cleaned text)."""
    return F.regexp_extract_all(_col(c), F.lit(WORD_PATTERN), 0)
