"""Time series by segment: gaps, runs, stitching and schedules.

Window partitions are one series each (a leg, a run, a user), ordered by time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.session import shuffle_partitions, written


def gaps(df: DataFrame, keys: Sequence[str], at: str, limit: float) -> DataFrame:
    """``previous``, ``at``, ``gap`` where neighbours of a series are more than ``limit`` apart."""
    w = Window.partitionBy(*keys).orderBy(at)
    x = df.select(*keys, F.col(at).alias("at"), F.lag(at).over(w).alias("previous"))
    return x.withColumn("gap", F.col("at") - F.col("previous")).filter(F.col("gap") > limit)


def span_gap(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``n``, ``min``, ``max``, ``median``, ``span``, ``largest_gap``, ``gap_at`` of the sorted values; the first of equal gaps."""
    w = Window.partitionBy(*keys).orderBy(value)
    x = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").withColumn("p", F.lag("v").over(Window.partitionBy(*keys).orderBy("v"))).withColumn("g", F.col("v") - F.col("p"))
    return x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.median("v").alias("median"), (F.max("v") - F.min("v")).alias("span"),
        F.coalesce(F.max("g"), F.lit(0.0)).alias("largest_gap"), F.min_by("p", F.when(F.col("g").isNotNull(), F.struct((-F.col("g")).alias("a"), F.col("p").alias("b")))).alias("gap_at"),
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, bins: int = 12) -> DataFrame:
    """``bin``, ``n`` of equal bins from low to high, the last closed; values outside do not count."""
    v = F.col(value).cast("double")
    b = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return df.filter((v >= low) & (v <= high)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def zero_runs(df: DataFrame, keys: Sequence[str], step: str, value: str, expected: float) -> DataFrame:
    """``start``, ``end``, ``reason`` of the stretches in which the value is zero.

    A stretch ends at the next frame with another value (``recovered``), before a step of more than
    ``expected`` (``gap``), or with the series (``last``). A gap starts a new stretch.
    """
    w = Window.partitionBy(*keys).orderBy(step)
    x = df.select(*keys, F.col(step).alias("t"), (F.col(value) == 0).alias("zero"))
    x = x.withColumns({"p": F.lag("t").over(w), "pz": F.lag("zero").over(w), "nt": F.lead("t").over(w), "nz": F.lead("zero").over(w)})
    broken = F.col("t") - F.col("p") > expected
    x = x.withColumn("new", F.col("zero") & (F.coalesce(broken, F.lit(True)) | ~F.coalesce(F.col("pz"), F.lit(False))))
    x = x.filter("zero").withColumn("run", F.sum(F.col("new").cast("long")).over(w))
    g = x.groupBy(*keys, "run").agg(F.min("t").alias("start"), F.max("t").alias("last"), F.max_by(F.struct("nt", "nz"), "t").alias("n"))
    gap = F.col("n.nt") - F.col("last") > expected
    reason = F.when(F.col("n.nt").isNull(), "last").when(gap, "gap").otherwise("recovered")
    return g.select(*keys, "start", F.when(reason == "recovered", F.col("n.nt")).otherwise(F.col("last")).alias("end"), reason.alias("reason"))


def stitch(segments: DataFrame, rows: DataFrame, key: str, dt: float, tolerance: float = 1e-9) -> DataFrame:
    """``rows`` (``local_t``) of all segments on one time axis ``t``, cut at a segment's ``valid_to_step``
    (else ``end_step``), without rows less than ``tolerance`` after the last row that is kept.

    Of equal times the segment with the smallest key comes first. The axis is range-partitioned and sorted. After the first
    step of at least the tolerance a partition's choice depends on nothing before it; only the few
    rows up to there wait for what the partitions before have kept.
    """
    spark = rows.sparkSession
    lim = (F.coalesce("valid_to_step", "end_step") - F.col("start_step")) * F.lit(dt) + 1e-6
    x = rows.join(segments, key).filter(F.col("local_t") <= lim).withColumn("t", (F.col("start_step") * F.lit(dt) + F.col("local_t")).cast("double"))
    cols = ["t", *[c for c in rows.columns if c != "local_t"]]
    rest = [c for c in cols if c not in ("t", key)]
    x = x.select(*cols).repartitionByRange(shuffle_partitions(spark), "t", key).sortWithinPartitions("t", key, *rest).withColumn("pid__", F.spark_partition_id())
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in x.schema.fields], T.StructField("open__", T.BooleanType(), True)])

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, last, free = None, None, False
        for b in batches:
            chosen, waits = [], []
            for t in b["t"]:
                free = free or (before is not None and t - before >= tolerance)
                take = not free or last is None or t - last >= tolerance
                if free and take:
                    last = t
                chosen.append(take)
                waits.append(not free)
                before = t
            yield b.assign(open__=waits)[chosen]

    kept = written(x.mapInPandas(keep, schema), "stitched")
    ends = kept.filter("NOT open__").groupBy("pid__").agg(F.max("t").alias("t"))

    def settle(d: pd.DataFrame) -> pd.DataFrame:
        last, chosen = None, []
        for t, mark in zip(d["t"], d["mark__"]):
            take = mark or last is None or t - last >= tolerance
            if take:
                last = t
            chosen.append(take and not mark)
        return d[chosen].drop(columns="mark__")

    # the first rows of each partition and the last time that each keeps, in order
    heads = kept.filter("open__").withColumn("mark__", F.lit(False)).unionByName(
        ends.select("t", "pid__", F.lit(True).alias("mark__")), allowMissingColumns=True
    )
    heads = heads.withColumn("one__", F.lit(1)).groupBy("one__").applyInPandas(
        lambda d: settle(d.drop(columns="one__").sort_values(["pid__", "mark__", "t", key], kind="stable")), schema
    )
    return kept.filter("NOT open__").unionByName(heads).select(*cols)


def interpolate(df: DataFrame, schedule: DataFrame, at: str, step: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the schedule's columns at ``at``: linear between its steps, constant beyond its ends.

    The schedule is a short table; rows fall into its intervals by range.
    """
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(step)
    s = schedule.select(*keys, F.col(step).alias("s0"), F.lead(step).over(w).alias("s1"), *[F.col(c).alias(f"{c}0") for c in columns], *[F.lead(c).over(w).alias(f"{c}1") for c in columns], F.row_number().over(w).alias("k"))
    lo = F.when(F.col("s.k") == 1, F.lit(float("-inf"))).otherwise(F.col("s.s0").cast("double"))
    hi = F.when(F.col("s.s1").isNull(), F.lit(float("inf"))).otherwise(F.col("s.s1").cast("double"))
    cond = (F.col(f"d.{at}").cast("double") >= lo) & (F.col(f"d.{at}").cast("double") < hi)
    for c in keys:
        cond = cond & (F.col(f"d.{c}") == F.col(f"s.{c}"))
    f = F.when(F.col("s.s1").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (F.col(f"d.{at}") - F.col("s.s0")) / (F.col("s.s1") - F.col("s.s0")).cast("double")))
    return df.alias("d").join(s.alias("s"), cond).select("d.*", *[(F.col(f"s.{c}0") + f * (F.coalesce(F.col(f"s.{c}1"), F.col(f"s.{c}0")) - F.col(f"s.{c}0"))).alias(c) for c in columns])


def evenly_spaced(df: DataFrame, position: str, n: int, last: int | None = None) -> DataFrame:
    """The rows at the n places floor(i x last / (n - 1)) of a 0-based, gapless position."""
    last = last if last is not None else int(df.agg(F.max(position)).first()[0])
    picks = df.sparkSession.createDataFrame([(i, i * last // (n - 1)) for i in range(n)], "pick int, place long")
    return picks.join(df, picks["place"] == F.col(position)).select("pick", *df.columns)


def nearest_unused(df: DataFrame, targets: Sequence[float], value: str, order: str) -> list:
    """For each target in turn the ``order`` of the row of nearest value not yet taken, ties to the lower order.

    Sequential by definition; candidates for each target are its ``len(targets)`` nearest rows, more are never needed.
    """
    k, taken, out = len(targets), set(), []
    for t in targets:
        near = df.orderBy(F.abs(F.col(value) - F.lit(t)), order).limit(k).select(order).collect()
        pick = next(r[0] for r in near if r[0] not in taken)
        taken.add(pick)
        out.append(pick)
    return out


def stratum(protein_pairs: Column, site_pairs: Column) -> Column:
    return F.when(protein_pairs == 0, "no_protein_contact").when(site_pairs > 0, "site_contact").otherwise("other_surface_contact")
