"""Score cutoffs that keep a target fraction of every source (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.keys import finite
from pairloom.session import drop_stored, stored, written

PIVOTS = 63  # a round
SAMPLES = 128  # scores that a run offers as pivots


def sorted_runs(df: DataFrame, source: Column, score: Column, item: Column, run_rows: int = 65536) -> DataFrame:
    """Locally sorted score arrays: ``g``, ``run``, ``n``, ``scores``, ``items``, ascending by score.

    The items of a source are spread by hash over as many runs as it takes for about ``run_rows`` rows
    each, so that no array grows with the table. Written to the shared folder.
    """
    spark = df.sparkSession
    s = finite(score)
    rows = df.select(source.alias("g"), s.alias("s"), item.alias("i")).filter("g IS NOT NULL AND s IS NOT NULL AND i IS NOT NULL")
    # written, so that Spark knows the size of this side: few sources are broadcast, many are joined with splitting of hot ones
    large, sizes_path = stored(
        rows.groupBy("g").agg(F.count("*").alias("c")).filter(F.col("c") > run_rows).select("g", F.ceil(F.col("c") / run_rows).cast("int").alias("k")), "sizes"
    )
    spread = rows.join(large, "g", "left").select("g", "s", "i", F.pmod(F.xxhash64("i"), F.coalesce("k", F.lit(1))).cast("int").alias("run"))
    runs = (
        spread.repartition("g", "run")
        .dropDuplicates(["g", "run", "s", "i"])
        .groupBy("g", "run")
        .agg(F.sort_array(F.collect_list(F.struct("s", "i"))).alias("a"))
        .select("g", "run", F.size("a").alias("n"), F.col("a.s").alias("scores"), F.col("a.i").alias("items"))
    )
    out = written(runs, "runs")
    drop_stored(spark, sizes_path)
    return out


def fraction_cutoffs(runs: DataFrame, fraction: tuple[int, int] = (1, 5), min_items: int = 1) -> DataFrame:
    """``g``, ``n``, ``k``, ``cutoff``, ``kept`` per source with at least ``min_items`` items.

    k is n x fraction rounded up, the fraction given as (numerator, denominator) so that no
    rounding of doubles enters; the cutoff is the k-th highest score, and ``kept`` counts the scores at or above
    it, ties included. Multi-sequence selection: all runs of a source give evenly spaced
    scores of their open index range, some of these become pivots, each run answers with
    their ranks by ``searchsorted``, and the ranges shrink to the gap between the two pivots
    that enclose rank k, until the k-th score is itself a pivot. Sources of any size take this
    way. Only scores are read, and only pivots and ranks are exchanged.
    """
    num, den = fraction
    totals = runs.groupBy("g").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("runs")).filter(F.col("n") >= min_items)
    totals = totals.withColumn("k", F.greatest(F.lit(1), F.expr(f"(n * {num}L + {den - 1}L) div {den}L")))
    state = written(totals.select("g", "runs", "n", "k", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")), "ranges")
    done = []
    while not done or state.limit(1).count():
        narrowed = written(_narrow(runs, state), "ranges")
        done.append(narrowed.filter("found").select("g", "n", "k", F.col("low").alias("cutoff"), "kept"))
        state = narrowed.filter("NOT found").select("g", "runs", "n", "k", "low", "high")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _narrow(runs: DataFrame, state: DataFrame) -> DataFrame:
    """One round: pivots from the open ranges, their ranks from all runs, the new ranges.

    The open range holds the scores strictly between ``low`` and ``high``.
    """
    # one row per large source and run: few rows with long arrays
    open_runs = runs.select("g", "run", "scores").join(state, "g")

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, scores, low, high, n_runs in zip(b["g"], b["scores"], b["low"], b["high"], b["runs"]):
                a = np.asarray(scores)
                lo, hi = np.searchsorted(a, low, "right"), np.searchsorted(a, high, "left")
                if hi > lo:
                    at = np.unique(np.linspace(lo, hi - 1, min(SAMPLES, hi - lo)).astype(np.int64))
                    # the only run of a source needs no other to choose the pivots
                    rows.append((g, np.unique(a[at]) if n_runs == 1 else a[at], (hi - lo) / len(at), n_runs == 1))
            yield pd.DataFrame(rows, columns=["g", "v", "w", "alone"])

    def choose(df: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate([np.asarray(x) for x in df["v"]])
        w = np.concatenate([np.full(len(x), y) for x, y in zip(df["v"], df["w"])])
        o = np.argsort(v, kind="stable")
        cum = np.cumsum(w[o])
        at = np.searchsorted(cum, np.linspace(0, cum[-1], PIVOTS + 2)[1:-1])
        return pd.DataFrame({"g": [df["g"].iloc[0]], "pivots": [np.unique(v[o][np.minimum(at, len(v) - 1)])]})

    g_type = runs.schema["g"].dataType.simpleString()
    offered = written(open_runs.mapInPandas(sample, f"g {g_type}, v array<double>, w double, alone boolean"), "offered")
    merged = offered.filter("NOT alone").groupBy("g").applyInPandas(choose, f"g {g_type}, pivots array<double>")
    pivots = written(offered.filter("alone").select("g", F.col("v").alias("pivots")).unionByName(merged), "pivots")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, scores, p in zip(b["g"], b["scores"], b["pivots"]):
                a, p = np.asarray(scores), np.asarray(p)
                rows.append((g, p, len(a) - np.searchsorted(a, p, "right"), len(a) - np.searchsorted(a, p, "left")))
            yield pd.DataFrame(rows, columns=["g", "p", "above", "reach"])

    ranks = (
        runs.select("g", "scores").join(pivots, "g")
        .mapInPandas(count, f"g {g_type}, p array<double>, above array<long>, reach array<long>")
        .select("g", F.explode(F.arrays_zip("p", "above", "reach")).alias("x"))
        .groupBy("g", F.col("x.p").alias("p"))
        .agg(F.sum("x.above").alias("above"), F.sum("x.reach").alias("reach"))
    )
    met = (F.col("above") < F.col("k")) & (F.col("k") <= F.col("reach"))
    return (
        ranks.join(state, "g")
        .groupBy("g", "runs", "n", "k", "low", "high")
        .agg(
            F.max(F.when(met, F.col("p"))).alias("hit"),
            F.max(F.when(met, F.col("reach"))).alias("kept"),
            F.max(F.when(F.col("reach") < F.col("k"), F.lit(None)).when(F.col("above") >= F.col("k"), F.col("p"))).alias("up"),
            F.min(F.when(F.col("reach") < F.col("k"), F.col("p"))).alias("down"),
        )
        .select(
            "g", "runs", "n", "k",
            F.coalesce("hit", F.greatest("low", F.coalesce("up", "low"))).alias("low"),
            F.least("high", F.coalesce("down", "high")).alias("high"),
            F.col("hit").isNotNull().alias("found"),
            "kept",
        )
    )


def kept_at_cutoff(runs: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``g``, ``item_id``, ``score`` of the items at or above their source's cutoff.

    The sorted runs are cut, so the table of all rows is not shuffled again.
    """
    return (
        runs.join(cutoffs.select("g", "cutoff"), "g")
        .withColumn("m", F.size(F.filter("scores", lambda x: x >= F.col("cutoff"))))
        .filter("m > 0")
        .select("g", F.explode(F.arrays_zip(
            F.expr("slice(items, n - m + 1, m)").alias("i"), F.expr("slice(scores, n - m + 1, m)").alias("s"))).alias("x"))
        .select("g", F.col("x.i").alias("item_id"), F.col("x.s").alias("score"))
    )


def keep_fraction(
    df: DataFrame, source: Column, score: Column, item: Column, fraction: tuple[int, int] = (1, 5), min_items: int = 1, run_rows: int = 65536
) -> tuple[DataFrame, DataFrame]:
    """(cutoffs, kept items) for keeping ``fraction`` of every source; see :func:`fraction_cutoffs`.

    Rows with a null source or item or a score that is not finite take no part; rows equal
    in source, score and item count once; ties at the cutoff are all kept. An empty table
    gives two empty results. Other columns are ignored.
    """
    runs = sorted_runs(df, source, score, item, run_rows)
    cutoffs = written(fraction_cutoffs(runs, fraction, min_items), "cutoffs")
    return cutoffs, kept_at_cutoff(runs, cutoffs)
