"""Pair-level summaries of repeated observations, and exact contact consensus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.positions import _changes


def aggregate_observations(
    df: DataFrame, pair: Sequence[str], observation: str, source: str, features: dict[str, str], constant: Sequence[str] = (), flags: dict[str, Column] | None = None,
    means: dict[str, Column] | None = None, checked: bool = True,
) -> DataFrame:
    """One row per pair: ``observations``, ``sources``, each feature as the median of its medians per
    source, ``feature_complete``, the ``constant`` columns, ``flags`` (true for all rows) and ``means`` (as :func:`mean_of_source_means`).

    A feature with a missing or infinite value in any observation is null. Raises if a constant column varies or is missing;
    with ``checked`` false, which saves a pass over the rows, ``consistent`` says of each pair that none does, and the caller raises.
    Rows are sorted by pair and source; a task holds the observations of one pair besides its current batch.
    """
    from pairloom.operators.checks import inconsistent, require

    if constant and checked:
        require({"Inconsistent assignment": inconsistent(df, pair, constant)})
    flags, means = flags or {}, means or {}
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(flags.values())), F.lit(0).cast("long"))
    others = [c for c in constant if c not in pair]
    rows = df.select(
        *pair, F.col(source).alias("source__"), *[F.col(c).cast("double").alias(n) for n, c in features.items()],
        *others, *([bits.alias("flags__")] if flags else []), *[c.cast("double").alias(n) for n, c in means.items()],
    )
    ordered = rows.repartition(*pair).sortWithinPartitions(*pair, "source__")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    fields = [*[(c, kinds[c]) for c in pair], ("observations", T.LongType()), ("sources", T.LongType()), *[(n, T.DoubleType()) for n in features]]
    fields += [(c, kinds[c]) for c in others] + [(n, T.BooleanType()) for n in flags] + [(n, T.DoubleType()) for n in means]
    fields += [] if checked else [("consistent", T.BooleanType())]
    out = ordered.mapInArrow(_summaries(list(pair), list(features), others, list(flags), list(means), None if checked else list(constant)), T.StructType([T.StructField(n, t) for n, t in fields]))
    complete = F.lit(True)
    for n in features:
        complete = complete & F.col(n).isNotNull()
    return out.withColumn("feature_complete", complete)


def _summaries(pair: list[str], features: list[str], constant: list[str], flags: list[str], means: list[str], fixed: list[str] | None):
    """Rows in the order of pair and source to a row per pair; with ``fixed``, whether none of these columns varies or is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            starts = np.flatnonzero(_changes(b, pair, last))
            last = {c: b.column(c)[-1].as_py() for c in pair}
            if not len(starts):
                held.append(b)
                continue
            if done := [x for x in [*held, b.slice(0, starts[-1])] if x.num_rows]:
                yield one(pa.Table.from_batches(done).combine_chunks().to_batches()[0])
            held = [b.slice(starts[-1])]
        if held:
            yield one(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        new_pair = _changes(b, pair, None)
        new_source = new_pair | _changes(b, ["source__"], None)
        pairs, sources = np.flatnonzero(new_pair), np.flatnonzero(new_source)
        own = np.cumsum(new_pair)[sources] - 1  # the pair of each source
        first = np.searchsorted(own, np.arange(len(pairs)))
        group = np.cumsum(new_source) - 1
        out = [b.column(c).take(pa.array(pairs)) for c in pair]
        out += [pa.array(np.diff(np.append(pairs, b.num_rows))), pa.array(np.diff(np.append(first, len(sources))))]
        for n in features:
            x = b.column(n).to_numpy(zero_copy_only=False)  # null is NaN
            bad = np.logical_or.reduceat(~np.isfinite(x), pairs)
            per = _medians(x, sources, group)
            out.append(pa.array(_medians(per, first, own), mask=bad))
        out += [b.column(c).take(pa.array(pairs)) for c in constant]
        if flags:
            bits = np.bitwise_and.reduceat(b.column("flags__").to_numpy(), pairs)
            out += [pa.array((bits >> i & 1).astype(bool)) for i in range(len(flags))]
        for n in means:
            per, k = _means(b.column(n).to_numpy(zero_copy_only=False), b.column(n).is_valid().to_numpy(zero_copy_only=False), sources)
            mean, k = _means(per, k > 0, first)
            out.append(pa.array(mean.astype(np.float64), mask=k == 0))
        names = [*pair, "observations", "sources", *features, *constant, *flags, *means]
        if fixed is not None:
            bad = _changes(b, fixed, None) & ~new_pair
            for c in fixed:
                bad |= b.column(c).is_null().to_numpy(zero_copy_only=False)
            out.append(pa.array(~np.logical_or.reduceat(bad, pairs)))
            names.append("consistent")
        return pa.RecordBatch.from_arrays(out, names=names)

    return run


def _means(x: np.ndarray, known: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the number of the known values of each run that begins at ``starts``.

    Means are of more digits than a double, so that a mean of thirds does not miss a round value by the order of its terms.
    """
    k = np.add.reduceat(known.astype(np.int64), starts)
    return np.add.reduceat(np.where(known, x, 0.0).astype(np.longdouble), starts) / np.maximum(k, 1), k


def _medians(x: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The median of each run of ``group``, that begins at ``starts``."""
    x = x[np.lexsort((x, group))]
    n = np.diff(np.append(starts, len(x)))
    with np.errstate(invalid="ignore"):  # of infinite values, that make their pair null
        return 0.5 * x[starts + (n - 1) // 2] + 0.5 * x[starts + n // 2]


def mean_of_source_means(df: DataFrame, pair: Sequence[str], source: str, value: Column, name: str) -> DataFrame:
    return df.groupBy(*pair, source).agg(F.avg(value).alias("v__")).groupBy(*pair).agg(F.avg("v__").alias(name))


def contact_consensus(df: DataFrame, pair: Sequence[str], source: str, residues: Column, threshold: tuple[int, int] = (3, 5)) -> DataFrame:
    """``residue``, ``frequency``, ``kept`` per pair: the share of a source's observations with the
    residue, averaged over the pair's sources.

    ``residues`` is an array; an empty or null one still counts as an observation. ``kept`` compares with the
    threshold exactly: doubles decide when they are clearly off it, fractions otherwise.
    """
    rows = df.select(*pair, source, F.array_distinct(F.coalesce(residues, F.array())).alias("r__"))
    size = rows.groupBy(*pair, source).agg(F.count("*").alias("n__"))
    sources = size.groupBy(*pair).agg(F.count("*").alias("k__"))
    counts = rows.select(*pair, source, F.explode("r__").alias("residue")).groupBy(*pair, source, "residue").agg(F.count("*").alias("c__"))
    x = (
        counts.join(size, [*pair, source])
        .groupBy(*pair, "residue")
        .agg(F.sum(F.col("c__") / F.col("n__")).alias("s__"), F.collect_list(F.struct("c__", "n__")).alias("parts__"))
        .join(sources, list(pair))
        .withColumn("frequency", F.col("s__") / F.col("k__"))
    )
    num, den = threshold
    near = F.abs(F.col("frequency") - F.lit(num / den)) < 1e-6

    def exact(parts: pd.Series, k: pd.Series) -> pd.Series:
        limit = Fraction(num, den)
        return pd.Series([p is not None and sum((Fraction(int(c["c__"]), int(c["n__"])) for c in p), Fraction(0)) / int(n) >= limit for p, n in zip(parts, k)])

    check = F.pandas_udf(exact, "boolean")
    x = x.withColumn("parts__", F.when(near, F.col("parts__")))
    return x.select(*pair, "residue", "frequency", F.when(near, check("parts__", "k__")).otherwise(F.col("frequency") > F.lit(num / den)).alias("kept"))


def quantile_report(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``n``, ``mean``, ``min``, ``p10``, ``p25``, ``median``, ``p75``, ``p90``, ``max`` with linear interpolation."""
    q = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("q")).select(
        *by, "n", "mean", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p25", "median", "p75", "p90"))], "max"
    )


def site_summary(df: DataFrame, keys: Sequence[str], within: Sequence[str], score: str) -> DataFrame:
    """``n``, ``median``, ``min``, ``max`` per key, and the average ``rank`` of the medians in ``within``."""
    from pairloom.operators.ranks import ranked

    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.median(score).alias("median"), F.min(score).alias("min"), F.max(score).alias("max"))
    return ranked(g, within, F.col("median"), descending=False).drop("rank_first", "peers", "n_scored")


def incomplete_grid(df: DataFrame, keys: Sequence[str], axes: dict[str, int]) -> DataFrame:
    """Keys whose number of distinct values differs from what ``axes`` demands, or that repeat a cell."""
    total = 1
    for n in axes.values():
        total *= n
    g = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in axes])
    bad = F.col("rows") != total
    for c, n in axes.items():
        bad = bad | (F.col(f"n_{c}") != n)
    return g.filter(bad)


def medoid(df: DataFrame, keys: Sequence[str], order: str, xyz: Sequence[str], radius: float = 4.0) -> DataFrame:
    """``n_near``, and the coordinates of the point of each key with most points within ``radius``, ties to the first in ``order``.

    The points of a key (seeds of one docking run) are gathered as an array; the comparison stays in
    the JVM and no pair is emitted.
    """
    pts = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *xyz))).alias("p"))
    d2 = lambda a, b: sum((a[c] - b[c]) * (a[c] - b[c]) for c in xyz)
    near = F.transform("p", lambda a: F.size(F.filter("p", lambda b: d2(a, b) <= radius * radius)))
    best = pts.withColumn("near", near).withColumn("n_near", F.array_max("near")).withColumn("at", F.array_position("near", F.col("n_near")))
    at = F.element_at("p", F.col("at").cast("int"))
    return best.select(*keys, "n_near", *[at[c].alias(c) for c in xyz])


def repeated_support(df: DataFrame, keys: Sequence[str], scoring: str, seed: str, xyz: Sequence[str], least: int = 3, apart: float = 5.0) -> DataFrame:
    """Per key: ``supported`` scoring functions (at least ``least`` seeds), ``both``, and ``stable``: the
    medoids of both gather ``least`` seeds and lie within ``apart``."""
    g = df.groupBy(*keys, scoring).agg(F.count_distinct(seed).alias("n")).filter(F.col("n") >= least)
    sup = g.groupBy(*keys).agg(F.array_sort(F.collect_set(scoring)).alias("supported"))
    m = medoid(df, [*keys, scoring], seed, xyz)
    pair = m.groupBy(*keys).agg(F.min("n_near").alias("lo"), F.count("*").alias("c"), *[(F.max(c) - F.min(c)).alias(f"d_{c}") for c in xyz])
    gap = sum(F.col(f"d_{c}") * F.col(f"d_{c}") for c in xyz)
    return sup.join(pair, list(keys)).select(
        *keys, F.array_join("supported", ";").alias("supported"), (F.size("supported") >= 2).alias("both"),
        ((F.size("supported") >= 2) & (F.col("lo") >= least) & (gap <= apart * apart)).alias("stable"),
    )
