"""Enrichment and recovery of labelled rows among the best-scored."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranks import fractional_top, top_fraction


def keyword_enrichment(df: DataFrame, group: str, score: str, row_id: str, flag: str, fraction: float) -> DataFrame:
    """Two rows, pooled and within groups that hold a flagged row: ``scope``, ``eligible_rows``,
    ``positives``, ``selected_rows``, ``selected_positives``, ``enrichment``.

    The top fraction is taken by score, ties by row id. Rows with a null flag or a score that
    is not finite are not eligible; without positives the enrichment is null.
    """
    scored = df.filter(F.col(flag).isNotNull() & F.col(score).isNotNull()).select(group, score, row_id, flag)
    hit = scored.filter(F.col(flag) == 1).select(group).distinct()
    parts = []
    for scope, rows, keys in (("pooled", scored, []), ("within_group", scored.join(hit, group, "left_semi"), [group])):
        top = top_fraction(rows, keys, F.col(score), F.col(row_id), fraction)
        a = rows.agg(F.count("*").alias("eligible_rows"), F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias("positives"))
        b = top.agg(F.count("*").alias("selected_rows"), F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias("selected_positives"))
        parts.append(a.crossJoin(b).withColumn("scope", F.lit(scope)))  # one row each
    out = parts[0].unionByName(parts[1])
    return out.withColumn(
        "enrichment",
        F.expr("try_divide(try_divide(CAST(selected_positives AS DOUBLE), selected_rows), try_divide(CAST(positives AS DOUBLE), eligible_rows))"),
    )


def recovery(
    df: DataFrame, outer: Sequence[str], group: str, score: str, evidence: Sequence[str], fractions: Sequence[float]
) -> DataFrame:
    """Evidence recovered among the fractional top: per outer group, ranking (pooled or within
    group), fraction and evidence column: ``n_rows``, ``positives``, ``selected``, ``hits``, ``expected``, ``recall``, ``enrichment``.

    Rows tied at a cutoff share its places. Expected hits are selected x positives / rows, of the whole or summed
    over the groups. Undefined ratios are null.
    """
    parts = [per_group_stats(df, outer, group, score, evidence, f) for f in fractions]
    stats = reduce(DataFrame.unionByName, parts)
    t = stats.groupBy(*outer, "ranking", "fraction", "evidence").agg(
        F.sum("n").alias("n_rows"), F.sum("pos").alias("positives"), F.sum("sel").alias("selected"), F.sum("hit").alias("hits"), F.sum("exp").alias("within")
    )
    t = t.withColumn(
        "expected", F.when(F.col("ranking") == "pooled", F.col("selected") * F.col("positives") / F.col("n_rows")).otherwise(F.col("within"))
    ).drop("within")
    return t.withColumn("recall", F.expr("try_divide(hits, CAST(positives AS DOUBLE))")).withColumn("enrichment", F.expr("try_divide(hits, expected)"))


def per_group_stats(df: DataFrame, outer: Sequence[str], group: str, score: str, evidence: Sequence[str], fraction: float) -> DataFrame:
    """Per group: rows, positives, selected weight, hit weight and expected hits; the resampling unit of recovery intervals."""
    out = []
    for mode, keys in (("pooled", list(outer)), ("within_group", [*outer, group])):
        w = fractional_top(df.select(*outer, group, score, *evidence), keys, F.col(score), fraction)
        long = w.select(
            *outer, group, "weight", F.explode(F.array(*[F.struct(F.lit(e).alias("evidence"), F.col(e).cast("long").alias("v")) for e in evidence])).alias("x")
        ).select(*outer, group, "weight", "x.*")
        g = long.groupBy(*outer, group, "evidence").agg(
            F.count("*").alias("n"), F.sum("v").alias("pos"), F.sum("weight").alias("sel"), F.sum(F.col("weight") * F.col("v")).alias("hit")
        )
        out.append(g.withColumn("exp", F.col("sel") * F.col("pos") / F.col("n")).withColumn("ranking", F.lit(mode)).withColumn("fraction", F.lit(float(fraction))))
    return out[0].unionByName(out[1])
