"""Train, validation and test splits that keep related records together (problem 2)."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.graph import related_groups
from pairloom.session import drop_stored, stored, written

BINS = 200
GROUPS = 1 << 17  # groups that are balanced together in one task


def difference_merge(tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest-differencing: the two tuples of widest spread merge until one is left.

    ``tuples`` is n x K. Merging adds the largest entries of one to the smallest of the
    other. Returns the K sums and, n x K, the bin in which each entry ended.
    """
    n, k = tuples.shape
    values = {i: tuples[i].astype(np.float64) for i in range(n)}
    slots = {i: np.arange(i * k, (i + 1) * k) for i in range(n)}
    heap = [(-(v.max() - v.min()), i) for i, v in values.items()]
    heapq.heapify(heap)
    joins: list[tuple[np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        oa, ob = np.argsort(-values[a], kind="stable"), np.argsort(values[b], kind="stable")
        joins.append((slots[b][ob], slots[a][oa]))
        values[a], slots[a] = values[a][oa] + values[b][ob], slots[a][oa]
        del values[b], slots[b]
        heapq.heappush(heap, (-(values[a].max() - values[a].min()), a))
    label = np.zeros(n * k, dtype=np.int64)
    last = heap[0][1]
    label[slots[last]] = np.arange(k)
    for child, parent in reversed(joins):
        label[child] = label[parent]
    return values[last], label.reshape(n, k)


def balanced_bins(weights: np.ndarray, k: int, fine: int = 25) -> np.ndarray:
    """Bin 0..k-1 of every weight, the bins as equal as largest differencing makes them.

    Weights below 1 / (k x fine) of the total are first bundled to about that size, which bounds the
    number of tuples; larger ones stay alone, and each starts as a tuple with one entry.
    """
    order = np.argsort(-weights, kind="stable")
    w = weights[order]
    least = w.sum() / (k * fine)
    # a bundle closes when the running sum of small weights passes a multiple of the least size
    small = np.where(w < least, w, 0.0)
    n_large = int((w >= least).sum())
    run = np.cumsum(small) - small
    bundle = np.where(w >= least, np.arange(len(w)), n_large + (run // max(least, 1e-300)).astype(np.int64))
    _, bundle = np.unique(bundle, return_inverse=True)
    sums = np.bincount(bundle, w)
    tuples = np.zeros((len(sums), k))
    tuples[:, 0] = sums
    _, label = difference_merge(tuples)
    out = np.empty(len(weights), dtype=np.int64)
    out[order] = label[:, 0][bundle]
    return out


def allocate(sums: dict[int, float], shares: Sequence[float]) -> dict[int, int]:
    """Whole bins to splits: heaviest first, each to the split that lacks most."""
    total = sum(sums.values())
    lack = [total * s / sum(shares) for s in shares]
    out = {}
    for b, w in sorted(sums.items(), key=lambda x: (-x[1], x[0])):
        to = max(range(len(lack)), key=lambda i: (lack[i], -i))
        out[b] = to
        lack[to] -= w
    return out


def grouped_splits(
    df: DataFrame,
    row_id: Column,
    links: Sequence[Column],
    shares: dict[str, float] | None = None,
    bins: int = BINS,
) -> DataFrame:
    """``row_id``, ``group_label``, ``split`` for every distinct row id.

    Rows that share a link value, directly or through others, form a group
    (:func:`pairloom.operators.graph.related_groups`) and get one split. Group sizes are
    balanced by largest differencing: groups fall by the hash of their label into buckets of
    about GROUPS, each bucket merges its groups into ``bins`` nearly equal bins, the buckets' bins
    (one number per bucket and bin) are merged the same way on the driver, and whole bins go to the splits, each to the one
    that lacks most of its share. A group larger than a bin fills one alone; a share is
    missed only by what such a group forces. The splits depend on the rows alone, not on partitions or the
    cluster. An empty table gives no rows; shares need not sum to one.
    """
    spark = df.sparkSession
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    groups = written(related_groups(df, row_id, links), "groups")
    sizes, sizes_path = stored(groups.groupBy("group_label").agg(F.count("*").alias("w")), "sizes")
    buckets = 1 << max(0, (sizes.count() // GROUPS).bit_length())

    def local(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["w", "group_label"], ascending=[False, True], kind="stable")
        return df.assign(bin=balanced_bins(df["w"].to_numpy(dtype=np.float64), bins))

    located = written(
        sizes.withColumn("bucket", F.pmod(F.xxhash64("group_label"), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .applyInPandas(local, "group_label string, w long, bucket int, bin long"),
        "bins",
    )
    drop_stored(spark, sizes_path)
    sums = located.groupBy("bucket", "bin").agg(F.sum("w").alias("w")).collect()  # buckets x bins numbers
    if not sums:
        return groups.withColumn("split", F.lit(None).cast("string")).limit(0)
    row = {b: k for k, b in enumerate(sorted({r["bucket"] for r in sums}))}
    matrix = np.zeros((len(row), bins))
    for r in sums:
        matrix[row[r["bucket"]], r["bin"]] = r["w"]
    totals, label = difference_merge(matrix)
    to = allocate(dict(enumerate(totals.tolist())), list(shares.values()))
    names = list(shares)
    where = spark.createDataFrame(
        [(r["bucket"], r["bin"], names[to[int(label[row[r["bucket"]], r["bin"]])]]) for r in sums], "bucket int, bin long, split string"
    )
    split = located.join(where, ["bucket", "bin"]).select("group_label", "split")
    return groups.join(split, "group_label").select("row_id", "group_label", "split")


def report(splits: DataFrame, shares: dict[str, float] | None = None, bins: int = BINS) -> DataFrame:
    """``measure``, ``value`` of :func:`grouped_splits`: ``rows``; ``torn``, the groups in more than one split; ``off``,

    the splits whose share of the rows differs from the wanted one by more than a bin and the largest group."""
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    want = {k: v / sum(shares.values()) for k, v in shares.items()}
    groups = splits.groupBy("group_label").agg(F.count("*").alias("w"), F.count_distinct("split").alias("s"))
    total = groups.agg(F.sum("w").alias("rows"), F.count_if(F.col("s") > 1).alias("torn"), F.max("w").alias("largest"))
    per = splits.agg(*[F.count_if(F.col("split") == k).alias(f"n{i}") for i, k in enumerate(want)]).withColumn("one", F.lit(1))
    x = total.withColumn("one", F.lit(1)).join(per, "one")
    off = sum((F.abs(F.col(f"n{i}") - F.col("rows") * v) > F.col("rows") / bins + F.col("largest")).cast("long") for i, v in enumerate(want.values()))
    x = x.select(F.coalesce("rows", F.lit(0)).alias("rows"), "torn", F.coalesce(off, F.lit(0)).alias("off"))
    return x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in x.columns])).alias("x")).select("x.*")
