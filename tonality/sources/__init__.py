from tonality.sources.dimensions import characters_df, episodes_df  # noqa: F401
from tonality.sources.utterances import (  # noqa: F401
    bind_conversations, bind_documents, read_utterances, utterances_from_table,
)
from tonality.sources.wordlists import (  # noqa: F401
    booster_df, lexicon_from_rows, negator_df, read_lexicon,
    read_wordlist,
)
