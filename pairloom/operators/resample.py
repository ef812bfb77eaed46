"""Cluster bootstrap, sign flips, Holm adjustment and signed-rank tests.

Rows are reduced to one row of sums per cluster in Spark. Draws are then made by NumPy from a
seed, for all statistics alike; a replicate is a product of draw counts and cluster sums and never touches rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_CLUSTERS = 200_000
EXACT_CLUSTERS = 12
EXACT_RANKS = 50  # values up to which signed ranks without ties get their exact distribution
MAX_CELLS = 4_000_000  # cluster pairs that the driver may hold
BLOCK_CELLS = 1 << 22  # replicates x clusters that are drawn at once
GROUP_CELLS = 1 << 20  # replicates x cells of groups that a task weighs at once


def cluster_sums(df: DataFrame, cluster: str, columns: Sequence[str], limit: int = MAX_CLUSTERS) -> tuple[list, np.ndarray]:
    """(clusters in order, their sums) on the driver; the number of clusters is checked first.

    A table with more clusters than the limit raises: its interval needs no resampling to be narrow.
    """
    g = df.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in columns])
    rows = sorted(g.limit(limit + 1).collect(), key=lambda r: r[cluster])
    if len(rows) > limit:
        raise ValueError("Too many clusters for resampling on the driver")
    return [r[cluster] for r in rows], np.array([[r[c] for c in columns] for r in rows]).reshape(-1, len(columns))


def drawn(clusters: int, replicates: int, seed: int, legacy: bool = False) -> Iterator[np.ndarray]:
    """How often each replicate draws each cluster, in blocks of replicates so that no block is large.

    Successive blocks of one generator are what a single call gives. ``legacy`` takes NumPy's older generator.
    """
    rng = np.random.RandomState(seed) if legacy else np.random.default_rng(seed)
    step = max(1, BLOCK_CELLS // max(1, clusters))
    for a in range(0, replicates, step):
        yield rng.multinomial(clusters, np.full(clusters, 1 / clusters), size=min(step, replicates - a))


def interval(values: np.ndarray, least: float = 0.95) -> tuple[float | None, float | None, int]:
    """2.5 % and 97.5 % quantiles and the number of finite replicates; no bounds if too few are finite."""
    ok = np.isfinite(values)
    n = int(ok.sum())
    if not n or n < least * len(values):
        return None, None, n
    lo, hi = np.quantile(values[ok], [0.025, 0.975])
    return float(lo), float(hi), n


def ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(bottom > 0, top / bottom, np.nan)


def bootstrap_ratio(df: DataFrame, cluster: str, numerator: str, denominator: str, replicates: int = 10_000, seed: int = 20260922) -> DataFrame:
    """One row: ``estimate``, ``ci_low``, ``ci_high``, ``valid_replicates`` of sum(numerator) / sum(denominator)."""
    spark: SparkSession = df.sparkSession
    _, sums = cluster_sums(df, cluster, [numerator, denominator])
    schema = "estimate double, ci_low double, ci_high double, valid_replicates long"
    if not len(sums):
        return spark.createDataFrame([], schema)
    w = np.concatenate([d @ sums for d in drawn(len(sums), replicates, seed)])
    lo, hi, n = interval(ratio(w[:, 0], w[:, 1]))
    t = sums.sum(axis=0)
    return spark.createDataFrame([(float(t[0] / t[1]) if t[1] else None, lo, hi, n)], schema)


def block_statistics(sums: np.ndarray, sizes: np.ndarray, replicates: int = 10_000, exact: int = EXACT_CLUSTERS, flips: int = 10_000, seed: int = 20261012) -> dict:
    """``delta``, ``ci_low``, ``ci_high``, ``p``, ``method`` of the mean of values that come in blocks, given each block's sum and size.

    The interval comes from replicates that draw as many blocks as there are; one generator
    serves these draws first and the sign flips after them. Up to ``exact`` blocks, the sums under all sign vectors are
    built up block by block; beyond, signs are drawn and one is added to both counts.
    """
    c, n = len(sums), sizes.sum()
    delta = float(sums.sum() / n)
    rng = np.random.default_rng(seed)
    step = max(1, BLOCK_CELLS // c)
    means = []
    for a in range(0, replicates, step):
        rows = min(step, replicates - a)
        picks = rng.integers(0, c, (rows, c)) + np.arange(rows)[:, None] * c
        times = np.bincount(picks.ravel(), minlength=rows * c).reshape(rows, c)
        means.append((times @ sums) / (times @ sizes))
    lo, hi = np.quantile(np.concatenate(means), [0.025, 0.975])
    far = abs(delta) * n - 1e-12 * n
    if c <= exact:
        every = np.zeros(1)
        for s in sums:
            every = np.concatenate([every - s, every + s])
        p, method = float((np.abs(every) >= far).mean()), "exact"
    else:
        hits = sum(int((np.abs(rng.choice([-1, 1], size=(min(step, flips - a), c)) @ sums) >= far).sum()) for a in range(0, flips, step))
        p, method = (hits + 1) / (flips + 1), "monte_carlo"
    return {"delta": delta, "ci_low": float(lo), "ci_high": float(hi), "p": p, "method": method}


def sign_flip(df: DataFrame, cluster: str, value: str, exact: int = EXACT_CLUSTERS, replicates: int = 10_000, seed: int = 20261012) -> DataFrame:
    """One row: ``n``, ``clusters``, ``delta``, ``p``, ``method`` for the mean of ``value`` under sign flips of whole clusters (:func:`block_statistics`)."""
    _, sums = cluster_sums(df.withColumn("one__", F.lit(1)), cluster, [value, "one__"])
    schema = "n long, clusters long, delta double, p double, method string"
    if not len(sums):
        return df.sparkSession.createDataFrame([], schema)
    x = block_statistics(sums[:, 0], sums[:, 1], replicates, exact, seed=seed)
    return df.sparkSession.createDataFrame([(int(sums[:, 1].sum()), len(sums), x["delta"], x["p"], x["method"])], schema)


def paired_roles(df: DataFrame, unit: Sequence[str], role: str, value: str) -> DataFrame:
    """One row per unit with ``candidate``, ``comparison``, ``delta``; raises unless each unit has exactly both roles."""
    from pairloom.operators.checks import require

    g = df.groupBy(*unit).agg(
        F.count("*").alias("n__"), *[F.max(F.when(F.col(role) == r, F.col(value).cast("double"))).alias(r) for r in ("candidate", "comparison")]
    )
    require({"Every unit needs one candidate and one comparison": g.filter((F.col("n__") != 2) | F.col("candidate").isNull() | F.col("comparison").isNull())})
    return g.drop("n__").withColumn("delta", F.col("candidate") - F.col("comparison"))


def discordance(paired: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of units in which the candidate only, the comparison only, both or neither succeeded."""
    a, b = F.col("candidate") == 1, F.col("comparison") == 1
    return paired.groupBy(*by).agg(
        *[F.sum(c.cast("long")).alias(n) for n, c in (("candidate_only", a & ~b), ("comparison_only", ~a & b), ("both", a & b), ("neither", ~a & ~b))]
    )


def holm(df: DataFrame, family: Sequence[str], p: str, tie: str, size: int | None = None) -> DataFrame:
    """``df`` with ``holm_p``: p times the hypotheses left, never below an earlier one, at most 1.

    A family is the tests made, a few rows; ``size`` sets its number when not all are in the table.
    """
    w = Window.partitionBy(*family).orderBy(p, tie)
    m = F.lit(size) if size else F.count("*").over(Window.partitionBy(*family))
    step = F.col(p) * (m - F.row_number().over(w) + 1)
    return df.withColumn("s__", step).withColumn("holm_p", F.least(F.lit(1.0), F.max("s__").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("s__")


def wilcoxon(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``n``, ``w_plus``, ``p`` of the signed-rank test.

    Zeros are dropped. Up to EXACT_RANKS values without ties the p is exact, else it is that of the normal approximation
    with tie correction. A group without other values than zero has no row.
    """
    from pairloom.operators.ranks import tie_table

    x = df.filter(F.col(value) != 0).select(*group, F.abs(value).alias("a__"), (F.col(value) > 0).cast("long").alias("up"))
    t = tie_table(x, group, F.col("a__"), {"up": F.col("up")}, descending=False)
    rank = F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)
    g = t.groupBy(*group).agg(
        F.sum("n").alias("m"), F.sum(F.col("up") * rank).alias("w_plus"), F.sum((F.pow(F.col("n"), F.lit(3)) - F.col("n"))).alias("ties")
    )
    m = F.col("m").cast("double")
    var = m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48
    z = F.abs(F.col("w_plus") - m * (m + 1) / 4) / F.sqrt(var)

    def exact(m: pd.Series, w: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(int(n), float(v)) if k else None for n, v, k in zip(m, w, whole)], dtype="float64")

    return g.withColumn("whole", (F.col("m") <= EXACT_RANKS) & (F.col("ties") == 0)).select(
        *group, F.col("m").alias("n"), "w_plus",
        F.when(F.col("whole"), F.pandas_udf(exact, "double")("m", "w_plus", "whole")).when(var > 0, erfc(z / math.sqrt(2))).alias("p"),
    )


def erfc(x: Column) -> Column:
    """1 - erf of a non-negative number, with a relative error below 1.2e-7 (a published Chebyshev fit, its coefficients are fixed values)."""
    t = 1 / (1 + 0.5 * x)
    fit = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + c
    return t * F.exp(fit - x * x)


@lru_cache(maxsize=64)
def _rank_sums(n: int) -> np.ndarray:
    """In how many of the 2^n sign vectors the positive ranks add up to each sum."""
    ways = np.ones(1)
    for k in range(1, n + 1):
        ways = np.concatenate([ways, np.zeros(k)]) + np.concatenate([np.zeros(k), ways])
    return ways


def signed_rank_p(n: int, w_plus: float) -> float:
    """Two-sided p of the sum of the positive ranks of ``n`` distinct magnitudes, by the distribution over all sign vectors."""
    ways = _rank_sums(n)
    low = int(min(w_plus, len(ways) - 1 - w_plus))
    return float(min(1.0, 2 * ways[: low + 1].sum() / ways.sum()))


def wilcoxon_exact(values: Sequence[float]) -> float:
    """:func:`signed_rank_p` of values of distinct magnitude; zeros are dropped."""
    x = sorted((v for v in values if v), key=abs)
    return signed_rank_p(len(x), sum(k + 1 for k, v in enumerate(x) if v > 0))


def cluster_pair_matrix(df: DataFrame, cluster: str, label: str, score: str) -> DataFrame:
    """``pos``, ``neg``, ``wins``: over all pairs of a positive row of one cluster and a negative row of
    another, the positives that score higher, ties half.

    AUROC under any cluster weights w is w'Mw / ((w.P)(w.N)). Scores are range-partitioned;
    inside a partition each positive is set against the running negatives per cluster, and
    whole partitions below enter by their negative counts. Meant for few clusters (families): the result has up to C x C rows.
    """
    from pairloom.session import shuffle_partitions, written

    spark = df.sparkSession
    counts = df.filter(F.col(score).isNotNull() & F.col(cluster).isNotNull()).groupBy(score, cluster).agg(
        F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("n")
    )
    kind = df.schema[cluster].dataType.simpleString()
    ordered = counts.select(F.col(score).alias("s"), F.col(cluster).alias("c"), "p", "n").repartitionByRange(shuffle_partitions(spark), "s").sortWithinPartitions("s")

    def local(batches):
        negatives: dict = {}
        positives: dict = {}
        wins: dict = {}
        last, block = None, []

        def close():
            for c, p, _ in block:
                if p:
                    positives[c] = positives.get(c, 0) + p
                    for d, n in negatives.items():
                        wins[c, d] = wins.get((c, d), 0.0) + p * n
                    for d, _, n in block:
                        if n:
                            wins[c, d] = wins.get((c, d), 0.0) + 0.5 * p * n
            for d, _, n in block:
                if n:
                    negatives[d] = negatives.get(d, 0) + n

        for b in batches:
            for s, c, p, n in zip(b["s"], b["c"], b["p"], b["n"]):
                if s != last:
                    close()
                    last, block = s, []
                block.append((c, p, n))
        close()
        rows = [("w", c, d, v) for (c, d), v in wins.items()] + [("p", c, None, float(v)) for c, v in positives.items()] + [("n", c, None, float(v)) for c, v in negatives.items()]
        yield pd.DataFrame(rows, columns=["kind", "c", "d", "v"])

    m = written(ordered.mapInPandas(local, f"kind string, c {kind}, d {kind}, v double").withColumn("pid", F.spark_partition_id()), "matrix")
    # whole partitions below: one number per partition and cluster, added up from the lowest scores on
    ends = m.filter("kind <> 'w'").groupBy("pid", "kind", "c").agg(F.sum("v").alias("v")).limit(MAX_CELLS + 1).collect()
    if len(ends) > MAX_CELLS:
        raise ValueError("Too many clusters for a matrix of cluster pairs")
    names = sorted({r["c"] for r in ends})
    at = {c: k for k, c in enumerate(names)}
    below, wins = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for _, rows in itertools.groupby(sorted(ends, key=lambda r: r["pid"]), key=lambda r: r["pid"]):
        own = np.zeros((2, len(names)))
        for r in rows:
            own[int(r["kind"] == "n"), at[r["c"]]] += r["v"]
        wins += np.outer(own[0], below)
        below += own[1]
    across = [(names[i], names[j], float(wins[i, j])) for i, j in zip(*np.nonzero(wins))]
    across = spark.createDataFrame(across, f"pos {kind}, neg {kind}, wins double")
    both = m.filter("kind = 'w'").select(F.col("c").alias("pos"), F.col("d").alias("neg"), F.col("v").alias("wins")).unionByName(across)
    return both.groupBy("pos", "neg").agg(F.sum("wins").alias("wins"))


def bootstrap_auroc_difference(df: DataFrame, cluster: str, label: str, a: str, b: str, replicates: int = 10_000, seed: int = 20260902) -> DataFrame:
    """One row: ``delta``, ``ci_low``, ``ci_high``, ``valid_replicates`` of the pooled AUROC of ``a`` minus that of ``b``; raises if fewer than 95 % of replicates are defined."""
    rows = df.select(cluster, label, a, b).dropna().withColumn("neg__", 1 - F.col(label))
    names, sums = cluster_sums(rows, cluster, [label, "neg__"], 2_000)
    at = {c: i for i, c in enumerate(names)}

    def wins(score: str) -> np.ndarray:
        m = np.zeros((len(names), len(names)))
        for r in cluster_pair_matrix(rows, cluster, label, score).collect():
            m[at[r["pos"]], at[r["neg"]]] = r["wins"]
        return m

    m = wins(a) - wins(b)
    boot = []
    for d in drawn(len(names), replicates, seed):
        d = d.astype(float)
        boot.append(ratio(((d @ m) * d).sum(axis=1), (d @ sums[:, 0]) * (d @ sums[:, 1])))
    point = m.sum() / (sums[:, 0].sum() * sums[:, 1].sum())
    return _difference(df.sparkSession, float(point), np.concatenate(boot))


def _difference(spark: SparkSession, point: float, boot: np.ndarray) -> DataFrame:
    lo, hi, n = interval(boot)
    if lo is None:
        raise ValueError("Fewer than 95% of bootstrap replicates are defined")
    return spark.createDataFrame([(point, lo, hi, n)], "delta double, ci_low double, ci_high double, valid_replicates long")


def bootstrap_within(df: DataFrame, cluster: str, identity: Sequence[str], label: str, a: str, b: str, replicates: int = 10_000, seed: int = 20260902) -> DataFrame:
    """Like :func:`bootstrap_auroc_difference` for the mean AUROC of the two-class groups of ``identity``.

    Where each group lies in one cluster, its AUROC is fixed and a replicate weighs it by its
    cluster's draws: sums per cluster are all that is needed. Where groups span clusters, a replicate
    weighs the rows, and a group's AUROC follows from its wins between each two clusters; these are
    counted and weighed in tasks.
    """
    from pairloom.operators.metrics import binary_metrics
    from pairloom.session import written

    rows = df.select(F.col(cluster).alias("c__"), *[F.col(c).alias(f"i{k}__") for k, c in enumerate(identity)], F.col(label).alias("y__"), F.col(a).alias("a__"), F.col(b).alias("b__")).dropna()
    cluster, identity, a, b = "c__", [f"i{k}__" for k in range(len(identity))], "a__", "b__"
    two = rows.groupBy(*identity).agg(F.min("y__").alias("lo__"), F.max("y__").alias("hi__"), F.min(cluster).alias("c0__"), F.max(cluster).alias("c1__")).filter("lo__ <> hi__")
    spread = two.filter("c0__ <> c1__").limit(1).count()
    names = [r[0] for r in rows.select(cluster).distinct().limit(MAX_CLUSTERS + 1).collect()]
    if len(names) > MAX_CLUSTERS:
        raise ValueError("Too many clusters for resampling on the driver")
    at = {c: i for i, c in enumerate(sorted(names))}
    if not spread:
        x = binary_metrics(rows, identity, F.col("y__"), F.col(a)).select(*identity, F.col("auroc").alias("ra__"))
        y = binary_metrics(rows, identity, F.col("y__"), F.col(b)).select(*identity, F.col("auroc").alias("rb__"))
        d = two.join(x, list(identity)).join(y, list(identity)).select("c0__", (F.col("ra__") - F.col("rb__")).alias("d__"), F.lit(1).alias("one__"))
        have, part = cluster_sums(d, "c0__", ["d__", "one__"])
        sums = np.zeros((len(at), 2))
        for c, v in zip(have, part):
            sums[at[c]] = v
        w = np.concatenate([d @ sums for d in drawn(len(at), replicates, seed)])
        t = sums.sum(axis=0)
        return _difference(df.sparkSession, float(t[0] / t[1]), ratio(w[:, 0], w[:, 1]))
    groups = written(_group_cells(rows, two, identity, cluster, a, b, at), "groups")
    ones = np.ones((1, len(at)), dtype=np.int64)
    point = _mean_of_groups(groups, ones)[0]
    boot = [_mean_of_groups(groups, d) for d in drawn(len(at), replicates, seed)]
    return _difference(df.sparkSession, float(point), np.concatenate(boot))


def _group_cells(rows: DataFrame, two: DataFrame, identity: Sequence[str], cluster: str, a: str, b: str, at: dict) -> DataFrame:
    """One row per two-class group: ``cells``, the wins of ``a`` minus those of ``b`` of the positives of a cluster against
    the negatives of another, and ``sides``, the positives and negatives of each cluster. Clusters are numbered by ``at``."""
    spark = rows.sparkSession
    numbered = spark.createDataFrame(list(at.items()), f"{cluster} {rows.schema[cluster].dataType.simpleString()}, at__ int")
    keyed = rows.join(two.select(*identity), list(identity)).join(F.broadcast(numbered), cluster).drop(cluster)
    sides = keyed.groupBy(*identity, "at__").agg(F.sum("y__").cast("double").alias("p"), F.sum(1 - F.col("y__")).cast("double").alias("n"))
    parts = []
    for score, sign in ((a, 1), (b, -1)):
        pos = keyed.filter("y__ = 1").groupBy(*identity, F.col("at__").alias("pos"), F.col(score).alias("s")).agg(F.count("*").alias("m"))
        neg = keyed.filter("y__ = 0").groupBy(*identity, F.col("at__").alias("neg")).agg(F.sort_array(F.collect_list(score)).alias("t"))
        # the negatives of one cluster in one group are few; each distinct score is compared with their sorted array
        won = F.size(F.filter("t", lambda x: x < F.col("s"))) + 0.5 * F.size(F.filter("t", lambda x: x == F.col("s")))
        parts.append(pos.join(neg, list(identity)).select(*identity, "pos", "neg", (sign * F.col("m") * won).alias("w")))
    cells = parts[0].unionByName(parts[1]).groupBy(*identity, "pos", "neg").agg(F.sum("w").alias("w"))
    cell, side = F.struct("pos", "neg", "w"), F.struct("at__", "p", "n")
    both = cells.select(*identity, cell.alias("cell"), F.lit(None).cast(sides.select(side.alias("x")).schema["x"].dataType).alias("side"))
    both = both.unionByName(sides.select(*identity, F.lit(None).cast(cells.select(cell.alias("x")).schema["x"].dataType).alias("cell"), side.alias("side")))
    return both.groupBy(*identity).agg(F.collect_list("cell").alias("cells"), F.collect_list("side").alias("sides")).select("cells", "sides")


def _mean_of_groups(groups: DataFrame, draws: np.ndarray) -> np.ndarray:
    """The mean over groups of the weighted difference of AUROCs for each row of ``draws`` (replicates x clusters).

    Tasks add up their groups; sums and counts per replicate are all that comes to the driver.
    """
    sent = groups.sparkSession.sparkContext.broadcast(draws.astype(np.int32))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.ascontiguousarray(sent.value.T).astype(float)
        total, valid = np.zeros(w.shape[1]), np.zeros(w.shape[1])
        step = max(1, GROUP_CELLS // w.shape[1])  # cells whose weights are held at once
        field = lambda x, name: x.field(name).to_numpy(zero_copy_only=False)
        sums = lambda k, x, rows: np.add.reduceat(x, np.searchsorted(k, np.arange(rows)), axis=0)
        for whole in batches:
            ends = np.cumsum(pc.list_value_length(whole["cells"]).to_numpy(zero_copy_only=False))
            first = 0
            while first < whole.num_rows:
                done = ends[first - 1] if first else 0
                b = whole.slice(first, max(1, int(np.searchsorted(ends, done + step, "right")) - first))
                first += b.num_rows
                g, e = (pc.list_parent_indices(b[c]).to_numpy(zero_copy_only=False) for c in ("cells", "sides"))
                x, y = b["cells"].flatten(), b["sides"].flatten()
                top = np.zeros((b.num_rows, w.shape[1]))
                for i in range(0, len(g), step):  # a group of very many cells takes several turns
                    k = g[i : i + step]
                    part = field(x, "w")[i : i + step, None] * w[field(x, "pos")[i : i + step]] * w[field(x, "neg")[i : i + step]]
                    top[k[0] : k[-1] + 1] += sums(k - k[0], part, k[-1] - k[0] + 1)
                p, n = np.zeros_like(top), np.zeros_like(top)
                for i in range(0, len(e), step):
                    k, c = e[i : i + step], w[field(y, "at__")[i : i + step]]
                    p[k[0] : k[-1] + 1] += sums(k - k[0], field(y, "p")[i : i + step, None] * c, k[-1] - k[0] + 1)
                    n[k[0] : k[-1] + 1] += sums(k - k[0], field(y, "n")[i : i + step, None] * c, k[-1] - k[0] + 1)
                v = ratio(top, p * n)
                ok = np.isfinite(v)
                total += np.where(ok, v, 0.0).sum(axis=0)
                valid += ok.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(valid)], names=["r", "v", "n"])

    out = np.full(len(draws), np.nan)
    for r in groups.mapInArrow(add, "r long, v double, n double").groupBy("r").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():
        if r["n"]:
            out[r["r"]] = r["v"] / r["n"]
    sent.destroy()
    return out
