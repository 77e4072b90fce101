from tonality.streaming.scoring import start_scoring_stream  # noqa: F401
