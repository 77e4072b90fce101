"""Speaker code handling: fill, cast and decode against the character dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.session import sized_broadcast

SECONDARY_CODE = 0.0


def fill_character(df: DataFrame, col: str = "Character") -> DataFrame:
    """Missing speaker code -> 0 (the bucket of lines without a main speaker)."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(SECONDARY_CODE)))


def cast_character(df: DataFrame, col: str = "Character", strict: bool = True) -> DataFrame:
    """Numeric code -> SMALLINT (fractions truncate) -> STRING code.

    Strict mode raises on values that do not fit (ANSI cast); lenient mode gives NULL.
    """
    cast = F.col(col).cast("smallint") if strict else F.try_cast(F.col(col), "smallint")
    return df.withColumn(col, cast.cast("string"))


def decode_character(df: DataFrame, dim: DataFrame, col: str = "Character",
                     strict: bool = False, keep_code: str | None = "CharacterCode") -> DataFrame:
    """Fill, cast and replace the code by the speaker name from ``dim(code, name)``.

    Unknown codes: strict mode fails the job, lenient mode leaves the name NULL.
    """
    coded = cast_character(fill_character(df, col), col)
    # a code listed twice with different names is an error in the dimension; listed twice with one name it counts once
    names = dim.groupBy(F.col("code").alias("_code")).agg(
        F.min("name").alias("_name"), F.count_distinct("name").alias("_n"))
    names = sized_broadcast(names.select("_code", F.when(F.col("_n") > 1, F.raise_error(
        F.concat(F.lit("two names for character code "), F.col("_code")))).otherwise(F.col("_name")).alias("_name")))
    out = coded.join(names, coded[col] == names["_code"], "left")
    name = F.col("_name")
    if strict:
        name = F.when(name.isNull(), F.raise_error(
            F.concat(F.lit("unknown character code: "), F.col(col)))).otherwise(name)
    cols = []
    for c in coded.columns:
        if c == col:
            if keep_code:
                cols.append(F.col(col).alias(keep_code))
            cols.append(name.alias(col))
        else:
            cols.append(F.col(c))
    return out.select(*cols)
