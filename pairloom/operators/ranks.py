"""Tie-aware ranks and top-k selection, built on exact distributed positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.keys import finite
from pairloom.operators.positions import grouped_positions


def _key(group: Sequence[str]) -> Column:
    if not group:
        return F.lit("all")
    return F.col(group[0]) if len(group) == 1 else F.to_json(F.struct(*group), {"ignoreNullFields": "false"})


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls match; the key columns come from the left side."""
    r = right.select(*[F.col(c).alias(f"{c}__r") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{c}__r"))
    return left.join(r, cond, how).drop(*[f"{c}__r" for c in on])


def tie_table(
    df: DataFrame, group: Sequence[str], score: Column, sums: dict[str, Column] | None = None, descending: bool = True
) -> DataFrame:
    """One row per group and distinct score: group, ``score``, ``n``, the ``sums``, and of each the running total ``cum_*``.

    Rows are first counted by (group, score), so only distinct scores are sorted. Scores that are
    not finite are left out. ``sums`` are non-negative LONGs.
    """
    sums = sums or {}
    rows = df.select(*group, finite(score).alias("score"), *[c.cast("long").alias(n) for n, c in sums.items()])
    counts = rows.filter("score IS NOT NULL").groupBy(*group, "score").agg(
        F.count("*").alias("n"), *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in sums]
    )
    names = ["n", *sums]
    out = grouped_positions(
        counts,
        _key(group),
        [(F.col("score"), descending)],
        carry={c: F.col(c) for c in [*group, *names] if c not in ("g", "pos")},
        sums={f"cum_{c}": F.col(c) for c in names},
    )
    return out.withColumnRenamed("o0", "score").select(*group, "score", *names, *[f"cum_{c}" for c in names])


def ranked(df: DataFrame, group: Sequence[str], score: Column, descending: bool = True) -> DataFrame:
    """``df`` with ``rank`` (average over ties), ``n_scored`` and ``rank_first`` in its group.

    Rows whose score is null, NaN or infinite keep a null rank and do not count in ``n_scored``.
    """
    t = tie_table(df, group, score, descending=descending)
    totals = t.groupBy(*group).agg(F.sum("n").alias("n_scored"))
    t = t.select(
        *group,
        F.col("score").alias("score__"),
        (F.col("cum_n") - F.col("n") + 1).alias("rank_first"),
        F.col("n").alias("peers"),
        (F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)).alias("rank"),
    )
    t = null_safe_join(t, totals, group) if group else t.crossJoin(F.broadcast(totals))
    return null_safe_join(df.withColumn("score__", finite(score)), t, [*group, "score__"], "left").drop("score__")


def percentile_rank(df: DataFrame, group: Sequence[str], score: Column) -> DataFrame:
    """Ascending average rank over count, as ``pct``."""
    r = ranked(df, group, score, descending=False)
    return r.withColumn("pct", F.col("rank") / F.col("n_scored")).drop("rank_first", "peers")


def rank_fraction(df: DataFrame, group: Sequence[str], score: Column) -> DataFrame:
    """(descending average rank - 0.5) / scored rows, as ``fraction``."""
    r = ranked(df, group, score)
    return r.withColumn("fraction", (F.col("rank") - 0.5) / F.col("n_scored")).drop("rank_first", "peers")


def top_size(n: Column, fraction: float) -> Column:
    """max(1, ceil(n x fraction)), computed in DOUBLE."""
    return F.greatest(F.lit(1), F.ceil(n.cast("double") * F.lit(float(fraction)))).cast("long")


def top_fraction(df: DataFrame, group: Sequence[str], score: Column, tie: Column, fraction: float) -> DataFrame:
    """The first ``top_size`` rows of each group by score descending, then ``tie`` ascending.

    Carries the columns of ``df``; adds ``place`` and ``group_rows``. Scores that are not finite take no part.
    """
    rows = df.withColumn("score__", finite(score)).filter("score__ IS NOT NULL")
    n = rows.groupBy(*group).agg(F.count("*").alias("group_rows"))
    placed = grouped_positions(rows, _key(group), [(F.col("score__"), True), (tie, False)], carry={"row__": F.struct(*df.columns)})
    out = placed.select(F.col("row__.*"), F.col("pos").alias("place"))
    out = null_safe_join(out, n, group) if group else out.crossJoin(F.broadcast(n))
    return out.filter(F.col("place") <= top_size(F.col("group_rows"), fraction))


def fractional_top(df: DataFrame, group: Sequence[str], score: Column, fraction: float) -> DataFrame:
    """``df`` with ``weight``: 1 above the cutoff of the top fraction, 0 below, and an equal
    part of the remaining places for rows tied at the cutoff; weights of a group sum to k."""
    r = ranked(df, group, score)
    k = top_size(F.col("n_scored"), fraction)
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - (F.col("rank_first") - 1)) / F.col("peers").cast("double")))
    return r.withColumn("weight", w).drop("rank", "rank_first", "peers")


def best_per_key(df: DataFrame, keys: Sequence[str], score: Column, tie: str) -> DataFrame:
    """The row of each key with the highest finite score, then the smallest ``tie``; one aggregate, no sort."""
    s = finite(score)
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(s.isNull(), -s, F.col(tie))).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, "b.*")
