"""Cleaning of entity keys and scores, shared by the operators on paired-entity tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_key(key: Column) -> Column:
    """Key without surrounding blanks, in upper case; null, empty and ``NA`` become null."""
    k = F.upper(F.trim(key))
    return F.when((k != "") & (k != "NA"), k)


def finite(score: Column) -> Column:
    """The score as DOUBLE, null where it is null, NaN or infinite; -0.0 becomes 0.0."""
    s = score.cast("double") + F.lit(0.0)
    return F.when(~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))), s)
