"""DataFrame -> DataFrame operators of the utterance-sentiment pipeline."""
