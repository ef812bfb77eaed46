"""Top N items within every group (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.keys import finite
from pairloom.operators.positions import grouped_positions


def top_n(df: DataFrame, group: Column, score: Column, item: Column, n: int, partitions: int | None = None) -> DataFrame:
    """``group_key``, ``item_id``, ``score``, ``place`` of the first ``n`` items per group.

    Order: score descending, then item ascending. One global range-partitioned sort on
    (group, score, item); the counts of the groups at partition borders are prefix-summed
    into exact positions (:mod:`pairloom.operators.positions`), so a group of any size
    stays spread. Rows with a null group or item, or a score that is null, NaN or
    infinite, take no part. Rows equal in all three count once. An empty table, and n of
    zero or less, give no rows. Other columns of ``df`` are ignored, whatever their names.
    """
    s = finite(score)
    ready = df.filter(group.isNotNull() & item.isNotNull() & s.isNotNull())
    ranked = grouped_positions(
        ready, group, [(s, True), (item, False)], distinct=True, up_to=max(n, 0), partitions=partitions
    )
    return ranked.select(
        F.col("g").alias("group_key"), F.col("o1").alias("item_id"), F.col("o0").alias("score"), F.col("pos").alias("place")
    )
