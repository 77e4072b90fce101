"""tonality: utterance-sentiment analytics as Spark DataFrame plans.

Utterances (one row per spoken line) are cleaned, tokenised, scored by a
lexicon-and-rules scorer and by a pluggable model scorer, labelled with their
prevailing sentiment and summarised per (episode, speaker).  Every step is a
DataFrame transformation; all episodes run in one job.
"""

__version__ = "0.1.0"
