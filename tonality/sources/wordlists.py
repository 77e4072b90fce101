"""Word-list sources: stopword lists, sentiment lexicons, boosters, negators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.resources import BOOSTERS, IDIOMS, MINI_LEXICON, NEGATORS
from tonality.schema import BOOSTER, LEXICON


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, UTF-8, blanks stripped, duplicates and empty lines dropped."""
    return (spark.read.text(path)
            .select(F.trim(F.col("value")).alias("word"))
            .where(F.col("word") != "")
            .distinct())


def read_lexicon(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Lexicon file ``token<sep>valence[<sep>...]``; extra columns are ignored."""
    raw = spark.read.options(sep=sep, header="false", comment="#").csv(path)
    return (raw.select(F.trim(F.col("_c0")).alias("token"),
                       F.col("_c1").cast("double").alias("valence"))
            .where(F.col("token").isNotNull() & F.col("valence").isNotNull()))


def lexicon_from_rows(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(list(rows if rows is not None else MINI_LEXICON), LEXICON)


def booster_df(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(list(rows if rows is not None else BOOSTERS), BOOSTER)


def idiom_df(spark: SparkSession, rows=None) -> DataFrame:
    """Phrases of two or three words and their valences: ``phrase, valence``."""
    return spark.createDataFrame(list(rows if rows is not None else IDIOMS), "phrase string, valence double")


def negator_df(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame([(w,) for w in (rows if rows is not None else NEGATORS)],
                                 "token string")
