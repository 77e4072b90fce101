"""Tokens by the Penn Treebank convention, as one Column expression (JVM-side, no UDF).

* Double quotes become two backquotes where they open (at the start of the text, after white space or an opening bracket) and
  two apostrophes elsewhere.
* Runs of two or more dots, or of dashes, are one token; brackets and the signs ``; @ # $ % & ? ! *`` are tokens of their own.
* Commas and colons are tokens unless a digit follows (``1,000``, ``10:30``).
* The clitics ``n't 's 'm 'd 'll 're 've`` are split off the word that they end; other apostrophes belong to their word
  (``o'clock``) unless they end it (``dogs'``).
* A dot that ends a white-space-separated word, closing brackets and quotes aside, is a token; dots inside words stay, and so
  does the dot of an abbreviation.  The convention splits one sentence at a time; here every such dot ends a sentence.
* ``cannot``, ``gonna``, ``gotta``, ``wanna``, ``gimme``, ``lemme``, ``'tis`` and ``'twas`` are two tokens each.

Defined results: NULL gives NULL; empty text and white space give no tokens.  A text is passed once, however long its words.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonality.functions.text import ASCII_LETTERS

# FIXED VALUES - words of the convention that are two tokens: (first, second).
TWO_TOKENS: list[tuple[str, str]] = [
    ("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"), ("'t", "is"), ("'t", "was"),
]

#: Words that keep the dot after them; a caller's own list replaces these.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "st", "vs", "prof", "jr", "sr", "etc", "e.g", "i.e")

_LETTERS = r"\p{L}\p{M}\p{N}_"
_MARKS = r";@#$%&?!*\[\](){}<>"
_WORD_END = rf"(?![{_LETTERS}'])"
_OPENING_QUOTE = r"""(?=["'])(?<=^|[\s(\[{<])(?:"|'')"""


def treebank_pattern(abbreviations: Sequence[str] = ABBREVIATIONS) -> str:
    """The regular expression of one token, for lower-case text whose double quotes are told apart."""
    # longest first does not matter: each must begin where a word begins
    kept = "|".join(re.escape(a) for a in abbreviations)
    # cheap tests first: most places hold the inside of a plain word, and none of what follows begins there
    last_dot = r"\.(?=[\])}>']*(?:\s|$))" + (rf"(?<!(?:^|[^{_LETTERS}.])(?:{kept})\.)" if kept else "")
    marks = rf"\.{{2,}}|{last_dot}|[:,](?![0-9])|''|'(?:s|m|d|ll|re|ve){_WORD_END}|'(?![{_LETTERS}])|-{{2,}}|``"
    clitic = rf"n't{_WORD_END}"
    apart = rf"(?=[.:,'`-])(?:{marks})|{clitic}"
    begins = "".join(sorted({first[0] for first, _ in TWO_TOKENS}))
    halves = "|".join(rf"{first}(?={second}{_WORD_END})" for first, second in TWO_TOKENS)
    # possessive: a word is passed in a loop, not by recursion
    plain = ASCII_LETTERS.replace("n", "")
    word = rf"(?:[{plain}]+|[^\s{_MARKS}.:,'`n-]+|n(?!'t{_WORD_END})|(?!{marks})[.:,'`-])++"
    return rf"(?=\S)(?:{apart}|[{_MARKS}]|(?=[{begins}])(?<![{_LETTERS}'])(?:{halves})|{word})"


def treebank_tokens(c: Column | str, abbreviations: Sequence[str] = ABBREVIATIONS) -> Column:
    """``array<string>`` of the tokens of lower-case text."""
    text = F.regexp_replace(F.col(c) if isinstance(c, str) else c, _OPENING_QUOTE, "``")
    return F.regexp_extract_all(F.replace(text, F.lit('"'), F.lit("''")), F.lit(treebank_pattern(abbreviations)), F.lit(0))
