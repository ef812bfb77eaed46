"""AUROC, average precision and rank correlation, pooled or within groups, from score counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranks import null_safe_join, ranked, tie_table


def binary_metrics(df: DataFrame, group: Sequence[str], label: Column, score: Column) -> DataFrame:
    """Per group: ``n``, ``n_pos``, ``auroc``, ``ap_pos``, ``ap_neg``, ``ap_symmetric``.

    ``ap_neg`` is the average precision of the other class by the negated score. Metrics are
    null for groups of one class. Rows without a finite score or with a null label are left out;
    ties count half in the AUROC and share a threshold in the average precision.
    """
    outer, group = list(group), [f"g{i}__" for i in range(len(group))]
    # own names, so that a group may have any
    rows = df.filter(label.isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(outer, group)], label.alias("y__"), score.alias("s__"))
    t = tie_table(rows, group, F.col("s__"), {"p": F.col("y__")})
    totals = t.groupBy(*group).agg(F.sum("n").alias("tn"), F.sum("p").alias("tp"))
    x = null_safe_join(t, totals, group) if group else t.crossJoin(F.broadcast(totals))
    p, n = F.col("p"), F.col("n")
    neg, cum_neg, tneg = n - p, F.col("cum_n") - F.col("cum_p"), F.col("tn") - F.col("tp")
    below = tneg - cum_neg
    up_neg, up_n = below + neg, F.col("tn") - F.col("cum_n") + n
    two = (F.col("tp") > 0) & (tneg > 0)
    agg = x.groupBy(*group).agg(
        F.max("tn").alias("n"),
        F.max("tp").alias("n_pos"),
        F.sum(F.when(two, p * (below + neg / F.lit(2.0)))).alias("u_stat"),
        F.sum(F.when(two, p / F.col("tp") * (F.col("cum_p") / F.col("cum_n")))).alias("ap_pos"),
        F.sum(F.when(two, neg / tneg * (up_neg / up_n))).alias("ap_neg"),
    )
    return agg.select(
        *[F.col(n).alias(c) for c, n in zip(outer, group)],
        "n",
        "n_pos",
        F.expr("try_divide(u_stat, CAST(n_pos AS DOUBLE) * (n - n_pos))").alias("auroc"),
        "ap_pos",
        "ap_neg",
        ((F.col("ap_pos") + F.col("ap_neg")) / 2).alias("ap_symmetric"),
    )


def conditional_auroc(df: DataFrame, outer: Sequence[str], identity: Sequence[str], label: Column, score: Column) -> DataFrame:
    """Mean AUROC of the two-class identity groups, per ``outer`` group, with coverage.

    ``auroc``, ``n_rows_used``, ``n_groups_used``, ``n_groups_skipped``, ``row_coverage``.
    Groups with a null identity do not count, their rows do in the coverage.
    """
    keyed = df
    for c in identity:
        keyed = keyed.filter(F.col(c).isNotNull())
    m = binary_metrics(keyed, [*outer, *identity], label, score)
    rows = df.groupBy(*outer).agg(F.count("*").alias("rows"))
    used = m.groupBy(*outer).agg(
        F.avg("auroc").alias("auroc"),
        F.sum(F.when(F.col("auroc").isNotNull(), F.col("n")).otherwise(0)).alias("n_rows_used"),
        F.count("auroc").alias("n_groups_used"),
        F.sum(F.col("auroc").isNull().cast("long")).alias("n_groups_skipped"),
    )
    x = null_safe_join(rows, used, outer, "left") if outer else rows.crossJoin(used)
    return x.select(
        *outer,
        "auroc",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows_used", "n_groups_used", "n_groups_skipped")],
        F.expr("coalesce(try_divide(coalesce(n_rows_used, 0), CAST(rows AS DOUBLE)), 0D)").alias("row_coverage"),
    )


def checkpoint_selection(
    df: DataFrame, outer: Sequence[str], identities: Sequence[str], label: Column, score: Column, least_groups: int = 8
) -> DataFrame:
    """``value``, ``fallback`` per outer group: the mean over ``identities`` of the conditional
    AUROC if each has at least ``least_groups`` two-class groups, else the pooled symmetric average precision."""
    x = binary_metrics(df, outer, label, score).select(*outer, "ap_symmetric")
    ok, mean = F.lit(True), F.lit(0.0)
    for i, c in enumerate(identities):
        part = conditional_auroc(df, outer, [c], label, score).select(*outer, F.col("auroc").alias(f"a{i}"), F.col("n_groups_used").alias(f"g{i}"))
        x = null_safe_join(x, part, outer) if outer else x.crossJoin(part)
        ok = ok & (F.col(f"g{i}") >= least_groups) & F.col(f"a{i}").isNotNull()
        mean = mean + F.col(f"a{i}") / len(identities)
    return x.select(*outer, F.when(ok, mean).otherwise(F.col("ap_symmetric")).alias("value"), (~ok).alias("fallback"))


def spearman(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """``n``, ``rho`` per group over rows with both scores finite; null if one is constant or n < 2."""
    from pairloom.operators.keys import finite

    rows = df.filter(finite(F.col(a)).isNotNull() & finite(F.col(b)).isNotNull()).select(*group, a, b)
    r = ranked(rows, group, F.col(a)).select(*group, a, b, F.col("rank").alias("ra"))
    r = ranked(r, group, F.col(b)).select(*group, "ra", F.col("rank").alias("rb"))
    s = r.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.sum("ra").alias("sa"), F.sum("rb").alias("sb"), F.sum(F.col("ra") * F.col("rb")).alias("sab"),
        F.sum(F.col("ra") * F.col("ra")).alias("saa"), F.sum(F.col("rb") * F.col("rb")).alias("sbb"),
    )
    num = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    da, db = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa"), F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    return s.select(*group, "n", F.when((da > 0) & (db > 0), num / F.sqrt(da) / F.sqrt(db)).alias("rho"))


def top_choice_agreement(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """``n``, ``agreement``: rows best in both scores over (rows best in a x rows best in b)."""
    best = df.groupBy(*group).agg(F.max(a).alias("ma"), F.max(b).alias("mb"))
    x = null_safe_join(df.select(*group, a, b), best, group)
    ia, ib = (F.col(a) == F.col("ma")).cast("long"), (F.col(b) == F.col("mb")).cast("long")
    return x.groupBy(*group).agg(
        F.count("*").alias("n"), (F.sum(ia * ib) / (F.sum(ia) * F.sum(ib)).cast("double")).alias("agreement")
    )
