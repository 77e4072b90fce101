from tonality.functions.text import (  # noqa: F401
    clean_text, extract_words, fold_ascii, lower_text, normalize_space, strip_dashes,
    strip_emoji, tokenize,
)
from tonality.functions.labels import major_sentiment, softmax3  # noqa: F401
