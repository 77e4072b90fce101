"""Prevailing-sentiment label and softmax as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonality.resources import LABELS


def major_sentiment(pos: Column | str, neu: Column | str, neg: Column | str) -> Column:
    """Arg-max over (pos, neu, neg) in that order; ties go to the earlier one.

    NaN counts as missing; a row whose three scores are all missing gets NULL.
    """
    p, u, n = (F.nanvl(F.col(c) if isinstance(c, str) else c, F.lit(None).cast("double"))
               for c in (pos, neu, neg))
    p0, u0, n0 = (F.coalesce(x, F.lit(float("-inf"))) for x in (p, u, n))
    return (F.when(p.isNull() & u.isNull() & n.isNull(), F.lit(None).cast("string"))
            .when((p0 >= u0) & (p0 >= n0), F.lit(LABELS[0]))
            .when(u0 >= n0, F.lit(LABELS[1]))
            .otherwise(F.lit(LABELS[2])))


def softmax3(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Numerically stable softmax of three logits."""
    m = F.greatest(a, b, c)
    ea, eb, ec = F.exp(a - m), F.exp(b - m), F.exp(c - m)
    s = ea + eb + ec
    return ea / s, eb / s, ec / s
