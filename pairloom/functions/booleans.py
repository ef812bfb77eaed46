"""Text to values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_bool(c: Column) -> Column:
    """Explicit booleans only: true, false, 1, 0 in any case; anything else, null too, raises."""
    s = F.lower(c.cast("string"))
    return (
        F.when(s.isin("true", "1"), F.lit(True))
        .when(s.isin("false", "0"), F.lit(False))
        .otherwise(F.raise_error(F.lit("Expected explicit boolean values")).cast("boolean"))
    )


def stars(p: Column) -> Column:
    """Significance bucket of a p-value."""
    # fixed values: the usual thresholds
    return F.when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 0.05, "*").otherwise("ns")


def log_ratio_caps(x: Column, cap: float) -> Column:
    """Clip to [-cap, cap]."""
    return F.greatest(F.lit(-cap), F.least(F.lit(cap), x))
