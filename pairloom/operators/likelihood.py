"""Likelihood-ratio scores from quantile bins, categories and kernel densities, fitted per fold.

The fold is a column: one plan fits and scores all folds. A row of ``data`` with fold f is scored by
the model fitted on the rows of all other folds.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.positions import _changes, grouped_positions
from pairloom.session import written

ALPHA = 0.5
FLOOR = 1e-12
CODES = ("D", "MW", "LP", "AR")
CONTINUOUS = ("D", "MW", "LP")
# fixed values: caps of the log ratios
CAPS = {"KDE_LEGACY": {"D": math.log(100), "MW": math.log(10), "LP": math.log(10), "AR": math.log(10)}, "KDE100": dict.fromkeys(CODES, math.log(100))}
BLOCK = 4096
REACH = 12.0  # widths beyond which a kernel is left out, being below 1e-31 of its peak
TERMS = 32  # moments of a cell
SLICE = 256  # queries, and cells, that are set against each other at once
NODES = 24  # places in a cell at which a density is summed where there are many queries; a polynomial through them gives the others


def methods() -> list[tuple[str, tuple[str, ...]]]:
    """The raw first feature, and each estimator over each non-empty set of features: 46 methods."""
    sets = [s for n in range(1, len(CODES) + 1) for s in itertools.combinations(CODES, n)]
    return [("RAW:RAW_D", ("D",))] + [(f"{e}:{'+'.join(s)}", s) for e in ("QNB", *CAPS) for s in sets]


def training_long(train: DataFrame, fold: str, label: str, codes: Sequence[str]) -> DataFrame:
    """``fit`` (the fold to be scored), ``code``, ``y``, ``x``, ``n``: distinct training values with their
    counts. A fold trains on every other; a single-fold table (fold null) on itself."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).cast("double").alias("x")) for c in codes])).alias("v")
    per = train.select(F.col(fold).alias("own"), F.col(label).alias("y"), x).select("own", "y", "v.*").groupBy("own", "code", "y", "x").agg(F.count("*").alias("n"))
    folds = train.select(F.col(fold).alias("fit")).distinct()
    return per.join(F.broadcast(folds), F.col("fit").isNull() | (F.col("own") != F.col("fit"))).groupBy("fit", "code", "y", "x").agg(F.sum("n").alias("n"))


def quantile_edges(long: DataFrame) -> DataFrame:
    """``fit``, ``code``, ``edges``: the distinct inner quantiles at i / ceil(n^(1/3)), linear interpolation.

    Values are ranked by distributed running counts; only those next to a quantile are kept.
    """
    vals = long.groupBy("fit", "code", "x").agg(F.sum("n").alias("n"))
    key = F.to_json(F.struct("fit", "code"), {"ignoreNullFields": "false"})
    run = grouped_positions(vals, key, [(F.col("x"), False)], carry={"fit": F.col("fit"), "code": F.col("code"), "n": F.col("n")}, sums={"cum": F.col("n")})
    total = vals.groupBy("fit", "code").agg(F.sum("n").alias("t")).withColumn("b", F.ceil(F.pow(F.col("t").cast("double"), F.lit(1.0 / 3.0)) - 1e-12))
    runs = run.select(F.col("fit").alias("f"), F.col("code").alias("c"), F.col("o0").alias("x"), (F.col("cum") - F.col("n")).alias("a"), (F.col("cum") - 1).alias("z"))
    return _edges_among(runs, total)


def _edges_among(runs: DataFrame, total: DataFrame) -> DataFrame:
    """The edges of :func:`quantile_edges` from the values ``x`` of fit ``f`` and code ``c`` with their places ``a`` to ``z``, and the number ``t`` of values and ``b`` of bins."""
    # a value that takes the places a to z says itself between which quantiles it lies: those of number i
    # whose place h = (t - 1) i / b has its lower or upper neighbour among them
    near = runs.join(F.broadcast(total.filter("b > 1")), F.col("f").eqNullSafe(F.col("fit")) & (F.col("c") == F.col("code")))
    step = F.col("b") / (F.col("t") - 1).cast("double")
    first = F.greatest(F.lit(1), F.floor((F.col("a") - 1) * step) - 1).cast("int")
    last = F.least(F.col("b") - 1, F.ceil((F.col("z") + 1) * step) + 1).cast("int")
    near = near.filter(first <= last).select("fit", "code", "x", "a", "z", "t", "b", F.explode(F.sequence(first, last)).alias("i"))
    near = near.withColumn("h", (F.col("t") - 1) * (F.col("i") / F.col("b").cast("double")))
    low, high = F.floor("h"), F.least(F.floor("h") + 1, F.col("t") - 1)
    held = lambda p: (p >= F.col("a")) & (p <= F.col("z"))
    at = near.filter(held(low) | held(high)).groupBy("fit", "code", "i", (F.col("h") - low).alias("part")).agg(
        F.max(F.when(held(low), F.col("x"))).alias("x0"), F.max(F.when(held(high), F.col("x"))).alias("x1")
    )
    return at.select("fit", "code", (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("part")).alias("e")).groupBy("fit", "code").agg(
        F.array_sort(F.collect_set("e")).alias("edges")
    )


def smoothed(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """``llr`` per ``fit``, ``code``, ``bin``: log ratio of the class shares with ALPHA added to every bin.

    ``bins`` has ``fit``, ``code``, ``n_bins``; bins without rows take part, the last one being that of unseen categories.
    """
    every = bins.select("fit", "code", "n_bins", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    totals = counts.groupBy("fit", "code").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    c = counts.select(F.col("fit").alias("f2"), F.col("code").alias("c2"), F.col("bin").alias("b2"), "n0", "n1")
    x = every.join(c, F.col("fit").eqNullSafe(F.col("f2")) & (F.col("code") == F.col("c2")) & (F.col("bin") == F.col("b2")), "left")
    t = totals.select(F.col("fit").alias("f3"), F.col("code").alias("c3"), "t0", "t1")
    x = x.join(t, F.col("fit").eqNullSafe(F.col("f3")) & (F.col("code") == F.col("c3")))
    p = lambda k: (F.coalesce(f"n{k}", F.lit(0)) + ALPHA) / (F.col(f"t{k}") + ALPHA * F.col("n_bins"))
    return x.select("fit", "code", "bin", F.log(p(1) / p(0)).alias("llr"))


def _bin(edges: Column, x: Column) -> Column:
    """The number of ascending ``edges`` up to ``x``, by halving."""
    taken = lambda at, k: (at + k <= F.size(edges)) & (F.get(edges, at + k - 1) <= x)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), lambda at, k: F.when(taken(at, k), at + k).otherwise(at))


def _half_even(c: Column) -> Column:
    """A sum of log ratios at 12 digits; its multiple is exact in doubles, which need no decimals."""
    return F.rint(c * F.lit(1e12)) / F.lit(1e12)


def fit_qnb(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges or categories per fit and code, log ratio per bin)."""
    cont = long.filter(F.col("code").isin(*CONTINUOUS))
    edges = quantile_edges(cont)
    all_fits = cont.select("fit", "code").distinct()
    e2 = edges.select(F.col("fit").alias("f2"), F.col("code").alias("c2"), "edges")
    edges = all_fits.join(e2, F.col("fit").eqNullSafe(F.col("f2")) & (F.col("code") == F.col("c2")), "left").select(
        "fit", "code", F.coalesce("edges", F.array().cast("array<double>")).alias("edges")
    )
    cats = long.filter(~F.col("code").isin(*CONTINUOUS)).groupBy("fit", "code").agg(F.array_sort(F.collect_set("x")).alias("edges"))
    grid = written(edges.unionByName(cats), "bins")
    g = grid.select(F.col("fit").alias("f2"), F.col("code").alias("c2"), "edges")
    x = long.join(F.broadcast(g), F.col("fit").eqNullSafe(F.col("f2")) & (F.col("code") == F.col("c2")))
    b = F.when(F.col("code").isin(*CONTINUOUS), _bin(F.col("edges"), F.col("x"))).otherwise(F.array_position("edges", F.col("x")).cast("int") - 1)
    counts = x.withColumn("bin", b).groupBy("fit", "code", "bin").agg(
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1")
    )
    return grid, smoothed(counts, grid.select("fit", "code", (F.size("edges") + 1).alias("n_bins")))


def qnb_components(queries: DataFrame, grid: DataFrame, llr: DataFrame) -> DataFrame:
    """``queries`` (``fit``, ``code``, ``x``) with ``llr``; an unseen category gets the last bin."""
    g = grid.select(F.col("fit").alias("f2"), F.col("code").alias("c2"), "edges")
    x = queries.join(F.broadcast(g), F.col("fit").eqNullSafe(F.col("f2")) & (F.col("code") == F.col("c2")))
    seen = F.array_position("edges", F.col("x")).cast("int")
    b = F.when(F.col("code").isin(*CONTINUOUS), _bin(F.col("edges"), F.col("x"))).otherwise(F.when(seen > 0, seen - 1).otherwise(F.size("edges")))
    x = x.withColumn("bin__", b).select("fit", "code", "x", "bin__")
    l = llr.select(F.col("fit").alias("f3"), F.col("code").alias("c3"), F.col("bin").alias("b3"), "llr")
    return x.join(F.broadcast(l), F.col("fit").eqNullSafe(F.col("f3")) & (F.col("code") == F.col("c3")) & (F.col("bin__") == F.col("b3"))).select("fit", "code", "x", "llr")


def kde_components(long: DataFrame, queries: DataFrame) -> DataFrame:
    """``fit``, ``code``, ``x``, ``llr`` of distinct continuous queries by Gaussian kernels with Scott's width.

    Queries are clipped to the training range. The kernels of all training values are summed through the moments of
    :func:`kernel_cells`: the work is in proportion to values and queries, not to their product, and the sums
    are those of the kernels one by one but for rounding.
    """
    train = long.filter(F.col("code").isin(*CONTINUOUS))
    stats = train.groupBy("fit", "code", "y").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.col("x")).alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    stats = written(stats, "stats")
    dev = train.alias("t").join(
        F.broadcast(stats.select(F.col("fit").alias("f2"), F.col("code").alias("c2"), F.col("y").alias("y2"), "m", "lo", (F.col("s") / F.col("m")).alias("mean"))),
        F.col("fit").eqNullSafe(F.col("f2")) & (F.col("code") == F.col("c2")) & (F.col("y") == F.col("y2")),
    )
    width = dev.groupBy("fit", "code", "y").agg(
        F.max("m").alias("m"), F.max("lo").alias("lo"), F.sqrt(F.try_divide(F.sum(F.col("n") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))), F.max("m") - 1)).alias("sd"),
        F.count("x").alias("known"), F.count("*").alias("values"),
    )
    # a class with one value, or an unknown one, has no density
    h = F.when(F.col("known") == F.col("values"), F.col("sd") * F.pow(F.col("m").cast("double"), F.lit(-0.2)))
    width = written(width.select(F.col("fit").cast("long").alias("fit"), "code", F.col("y").cast("int").alias("y"), "m", "lo", h.alias("h")).filter("h > 0 AND NOT isnan(h)"), "width")
    cells = kernel_cells(train, width)
    models = [cells.filter(F.col("y") == y).select(F.col("fit").alias(f"f{y}"), F.col("code").alias(f"c{y}"), F.struct("m", "lo", "h", "cell", "w").alias(f"m{y}")) for y in (0, 1)]
    span = stats.groupBy("fit", "code").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(F.col("fit").alias("f2"), F.col("code").alias("c2"), "lo", "hi")
    q = queries.filter(F.col("code").isin(*CONTINUOUS)).distinct()
    blocks = max(1, train.count() // (BLOCK * max(1, stats.count())))
    q = q.groupBy(F.col("fit").cast("long").alias("fit"), "code", F.pmod(F.xxhash64("x"), F.lit(blocks)).alias("qb")).agg(F.collect_list("x").alias("x"))
    q = q.join(F.broadcast(span), F.col("fit").eqNullSafe(F.col("f2")) & (F.col("code") == F.col("c2"))).select("fit", "code", "x", F.col("lo").alias("least"), F.col("hi").alias("most"))
    for y, model in enumerate(models):
        q = q.join(F.broadcast(model), F.col("fit").eqNullSafe(F.col(f"f{y}")) & (F.col("code") == F.col(f"c{y}")), "left").drop(f"f{y}", f"c{y}")

    def densities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for fit, code, x, least, most, *of in zip(b["fit"], b["code"], b["x"], b["least"], b["most"], b["m0"], b["m1"]):
                x = np.sort(np.asarray(x))
                z = np.clip(x, least, most)
                d = [np.full(len(z), np.nan) if m is None else _density(z, m) for m in of]
                yield pd.DataFrame({"fit": pd.array([None if pd.isna(fit) else int(fit)] * len(x), dtype="Int64"), "code": code, "x": x, "d0": d[0], "d1": d[1]})

    dens = q.mapInPandas(densities, "fit long, code string, x double, d0 double, d1 double")
    kind = queries.schema["fit"].dataType
    return dens.select(F.col("fit").cast(kind).alias("fit"), "code", "x", F.log((F.col("d1") + FLOOR) / (F.col("d0") + FLOOR)).alias("llr"))


def kernel_cells(train: DataFrame, width: DataFrame) -> DataFrame:
    """``width`` (``fit``, ``code``, ``y``, the number ``m`` of values, the lowest ``lo``, the kernel's width ``h``) with ``cell`` and ``w``:
    the numbers of the cells of h / 2 that hold training values, in order, and TERMS moments of each, one cell after the other.

    With e the distance of a value to the middle of its cell and u that of a query, both over h, the kernel is
    exp(-u^2 / 2) exp(-e^2 / 2) sum of (u e)^j / j!; the moments are the sums of n e^j / j! exp(-e^2 / 2).
    |u e| is at most REACH / 4, for which the terms left out lie below the rounding of doubles. As h falls with the standard
    deviation, cells are few: a value far from the others widens h.
    """
    keys = ["fit", "code", "y", "cell"]
    names = [f"w{j}" for j in range(TERMS)]
    w = width.select(F.col("fit").alias("f2"), F.col("code").alias("c2"), F.col("y").alias("y2"), "lo", "h")
    x = train.join(F.broadcast(w), F.col("fit").eqNullSafe(F.col("f2")) & (F.col("code") == F.col("c2")) & (F.col("y") == F.col("y2")))
    at = (F.col("x") - F.col("lo")) / F.col("h")
    x = x.select(F.col("fit").cast("long").alias("fit"), "code", F.col("y").cast("int").alias("y"), F.floor(2 * at).cast("long").alias("cell"), at.alias("at"), F.col("n").cast("double").alias("n"))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for b in batches:
            e = (b["at"] - (b["cell"] + 0.5) / 2).to_numpy()
            term = b["n"].to_numpy() * np.exp(-0.5 * e * e)
            part = b[keys].astype({"fit": "Int64"})
            for j, name in enumerate(names):
                part[name] = term
                term = term * e / (j + 1)
            part = part.groupby(keys, dropna=False).sum()
            sums = part if sums is None else pd.concat([sums, part]).groupby(level=keys, dropna=False).sum()
        if sums is not None:
            yield sums.reset_index()

    sums = x.mapInPandas(moments, "fit long, code string, y int, cell long, " + ", ".join(f"{n} double" for n in names))
    sums = sums.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    rows = sums.groupBy("fit", "code", "y").agg(F.array_sort(F.collect_list(F.struct("cell", F.array(*names).alias("w")))).alias("v"))
    rows = rows.select(F.col("fit").alias("f2"), F.col("code").alias("c2"), F.col("y").alias("y2"), F.col("v.cell").alias("cell"), F.flatten("v.w").alias("w"))
    return written(width.join(rows, F.col("fit").eqNullSafe(F.col("f2")) & (F.col("code") == F.col("c2")) & (F.col("y") == F.col("y2"))).select(*width.columns, "cell", "w"), "cells")


def _density(z: np.ndarray, model: dict) -> np.ndarray:
    """The kernel density at the ascending ``z`` from a row of :func:`kernel_cells`."""
    h = model["h"]
    middle = (np.asarray(model["cell"]) + 0.5) / 2
    w = np.asarray(model["w"]).reshape(len(middle), TERMS)
    at = (z - model["lo"]) / h
    out = np.zeros(len(z))
    for a in range(0, len(z), SLICE):
        t = at[a : a + SLICE]
        lo, hi = np.searchsorted(middle, [t[0] - REACH, t[-1] + REACH])
        for i in range(lo, hi, SLICE):
            k = slice(i, min(i + SLICE, hi))
            u = t[:, None] - middle[k]
            near = np.abs(u) <= REACH
            u[~near] = 0.0
            total = np.zeros_like(u) + w[k, -1]
            for j in range(TERMS - 2, -1, -1):
                total *= u
                total += w[k, j]
            out[a : a + SLICE] += (total * np.exp(-0.5 * u * u) * near).sum(axis=1)
    return out / (model["m"] * h * math.sqrt(2 * math.pi))


def method_scores(train: DataFrame, test: DataFrame, fold: str, label: str, keep: Sequence[str], only: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``method``, ``score`` of every test row and each of the 46 methods, or of those named in ``only``.

    Test rows are scored by the model of their fold. Components and sums are rounded half-even at 12
    digits, kernel components capped first. Rows with an incomplete feature get null scores.
    """
    long = written(training_long(train, fold, label, CODES), "training")
    flat = test.select(*keep, F.col(fold).alias("fit"), *CODES)
    queries = flat.select("fit", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).cast("double").alias("x")) for c in CODES])).alias("v")).select("fit", "v.*").dropna(subset=["x"]).distinct()
    grid, llr = fit_qnb(long)
    qnb = written(qnb_components(queries, grid, llr), "qnb")
    kde = written(kde_components(long, queries).unionByName(qnb.filter(~F.col("code").isin(*CONTINUOUS))), "kde")
    x = flat
    for name, comp in (("q", qnb), ("k", kde)):
        for c in CODES:
            part = comp.filter(F.col("code") == c).select(F.col("fit").alias(f"f_{name}{c}"), F.col("x").alias(f"x_{name}{c}"), F.col("llr").alias(f"{name}_{c}"))
            x = x.join(part, F.col("fit").eqNullSafe(F.col(f"f_{name}{c}")) & (F.col(c).cast("double") == F.col(f"x_{name}{c}")), "left")
    return x.select(*keep, F.explode(F.array(*_expressions(only))).alias("m")).select(*keep, "m.method", "m.score")


def _expressions(only: Sequence[str] = ()) -> list[Column]:
    complete = F.lit(True)
    for c in CODES:
        complete = complete & F.col(c).isNotNull()
    out = []
    for name, codes in methods():
        if only and name not in only:
            continue
        est = name.split(":")[0]
        if est == "RAW":
            v = F.bround(F.col("D").cast("double"), 12)
        else:
            v = F.lit(0.0)
            for c in codes:
                k = F.col(f"q_{c}") if est == "QNB" else F.greatest(F.lit(-CAPS[est][c]), F.least(F.lit(CAPS[est][c]), F.col(f"k_{c}")))
                v = v + _half_even(k)
            v = _half_even(v)
        out.append(F.struct(F.lit(name).alias("method"), F.when(complete, v).alias("score")))
    return out


def _needed(only: Sequence[str]) -> tuple[list[str], list[str]]:
    """The features whose bins, and those whose kernels, the methods ``only`` add up."""
    bins, kernels = set(), set()
    for name, codes in methods():
        if name in only and not name.startswith("RAW"):
            kde = {c for c in codes if c in CONTINUOUS and not name.startswith("QNB")}
            bins, kernels = bins | (set(codes) - kde), kernels | kde
    return [c for c in CODES if c in bins], [c for c in CODES if c in kernels]


def wide_scores(train: DataFrame, test: DataFrame, fold: str, label: str, only: Sequence[str], digits: int | None = None, bins_of: Callable | None = None, then: tuple | None = None) -> DataFrame:
    """``test`` with the scores of :func:`method_scores` of the i-th method in ``only`` as ``s{i}``, rounded half up at ``digits`` if given.

    ``bins_of``: what fits the bins, :func:`_bin_models` if not given. ``then``: what makes other batches of those of the result in the
    same task, in the order of ``test``, and the schema of these.

    Only the parts that these methods add up are fitted: bins and moments of cells, that are of no more rows than a histogram, come to the
    driver, and test rows are scored in batches where they are, without joins.
    """
    spark = train.sparkSession
    bins, kernels = _needed(only)
    models = spark.sparkContext.broadcast(((bins_of or _bin_models)(train, fold, label, bins), _kernel_models(train, fold, label, kernels)))
    parts = dict(methods())
    sums = [(i, m.split(":")[0], parts[m]) for i, m in enumerate(only) if not m.startswith("RAW")]
    kind = [f"s{i} double" for i, _, _ in sums]
    codes = sorted({*bins, *kernels})
    complete = F.lit(True)
    for c in CODES:
        complete = complete & F.col(c).isNotNull()
    raw = F.bround(F.col("D").cast("double"), 12)
    raw = raw if digits is None else F.round(raw, digits)
    columns = test.columns
    if then:
        test = test.withColumns({"raw__": raw, "complete__": complete})
    kept = len(test.columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bins, of_kernels = models.value
        for b in batches:
            fits = b.column("fit__").dictionary_encode()
            at = fits.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            x = {c: b.column(f"x__{c}").to_numpy(zero_copy_only=False) for c in codes}
            q = {c: np.full(b.num_rows, np.nan) for c in bins}
            k = {c: np.full(b.num_rows, np.nan) for c in kernels}
            for i, fit in [(-1, None), *enumerate(fits.dictionary.to_pylist())]:
                own = np.flatnonzero(at == i)
                if len(own):
                    for models_of, out, value in ((of_bins, q, _bin_value), (of_kernels, k, _kernel_value)):
                        for c in out:
                            if model := models_of.get((fit, c)):
                                out[c][own] = value(model, x[c][own])
            out = []
            for _, est, added in sums:
                total = np.zeros(b.num_rows)
                for c in added:
                    if est == "QNB":
                        v = q[c]
                    else:  # an unknown ratio counts as the cap, as least() and greatest() skip nulls
                        v = k[c] if c in CONTINUOUS else q[c]
                        v = np.clip(np.where(np.isnan(v), CAPS[est][c], v), -CAPS[est][c], CAPS[est][c])
                    total = total + np.rint(v * 1e12) / 1e12
                total = np.rint(total * 1e12)
                if digits is None:
                    total = total / 1e12
                else:  # of whole numbers, so that halves are exact
                    step = 10.0 ** (12 - digits)
                    total = np.copysign(np.floor((np.abs(total) + step / 2) / step), total) / 10.0**digits + 0.0
                out.append(pa.array(total, mask=np.isnan(total)))
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *out], names=[*b.schema.names[:kept], *[f"s{i}" for i, _, _ in sums]])

    rows = test.select(*test.columns, F.col(fold).alias("fit__"), *[F.col(c).cast("double").alias(f"x__{c}") for c in codes])
    if then:
        further, schema = then
        own = [("raw__" if m.startswith("RAW") else f"s{i}", f"s{i}") for i, m in enumerate(only)]

        def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def whole() -> Iterator[pa.RecordBatch]:
                for b in score(batches):
                    scores = [pc.if_else(b.column("complete__"), b.column(c), pa.scalar(None, pa.float64())) for c, _ in own]
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *scores], names=[*columns, *[n for _, n in own]])

            return further(whole())

        return rows.mapInArrow(finished, schema)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in test.schema.fields], *kind])
    scored = rows.mapInArrow(score, schema)
    return scored.select(*test.columns, *[F.when(complete, raw if m.startswith("RAW") else F.col(f"s{i}")).alias(f"s{i}") for i, m in enumerate(only)])


def _bin_models(train: DataFrame, fold: str, label: str, codes: Sequence[str]) -> dict:
    """(fit, code) to (edges or categories, log ratio of each bin)."""
    if not codes:
        return {}
    grid, llr = fit_qnb(written(training_long(train, fold, label, codes), "training"))
    found: dict = {}
    for r in llr.collect():
        found.setdefault((r["fit"], r["code"]), {})[r["bin"]] = r["llr"]
    # a bin without a ratio is unknown
    return {
        (r["fit"], r["code"]): (np.array(r["edges"], dtype=float), np.array([np.nan if (v := found[r["fit"], r["code"]].get(i)) is None else v for i in range(len(r["edges"]) + 1)]), r["code"] in CONTINUOUS)
        for r in grid.collect() if (r["fit"], r["code"]) in found
    }


def fold_bin_models(train: DataFrame, fold: str, label: str, codes: Sequence[str]) -> dict:
    """:func:`_bin_models` of rows without missing features. Distinct values are sorted once, with counts by fold, from which follow their places
    in each fit; the classes are counted by bin in one pass over the rows."""
    spark = train.sparkSession
    rows = train.select(F.col(fold).alias("own"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in codes])
    folds = [r["own"] for r in rows.select("own").distinct().collect()]
    trains = {fit: [i for i, own in enumerate(folds) if fit is None or (own is not None and own != fit)] for fit in folds}
    own = [f"n{i}" for i in range(len(folds))]
    vals = rows.select("own", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("x")) for c in codes])).alias("v"))
    vals = vals.groupBy(F.col("v.code").alias("code"), F.col("v.x").alias("x")).agg(*[F.count(F.when(F.col("own").eqNullSafe(F.lit(f)), 1)).alias(n) for f, n in zip(folds, own)])
    vals = written(vals, "values")
    sizes = {r["code"]: r for r in vals.groupBy("code").agg(*[F.sum(n).alias(n) for n in own]).collect()}
    found = {(fit, c): [] for fit in folds for c in codes if c in CONTINUOUS}
    totals = [(k, c, t, math.ceil(float(t) ** (1.0 / 3.0) - 1e-12)) for k, fit in enumerate(folds) for c in codes if c in CONTINUOUS and (t := sum(sizes[c][own[i]] for i in trains[fit]))]
    if totals:
        run = grouped_positions(vals.filter(F.col("code").isin(*CONTINUOUS)), F.col("code"), [(F.col("x"), False)], carry={n: F.col(n) for n in own}, sums={f"c{n}": F.col(n) for n in own})
        added = lambda names: sum((F.col(n) for n in names), F.lit(0))
        places = [F.struct(F.lit(k).alias("f"), (added(f"c{own[i]}" for i in trains[fit]) - added(own[i] for i in trains[fit])).alias("a"), (added(f"c{own[i]}" for i in trains[fit]) - 1).alias("z")) for k, fit in enumerate(folds)]
        runs = run.select(F.col("g").alias("c"), F.col("o0").alias("x"), F.explode(F.array(*places)).alias("p")).select("p.f", "c", "x", "p.a", "p.z").filter("a <= z")
        for r in _edges_among(runs, spark.createDataFrame(totals, "fit int, code string, t long, b long")).collect():
            found[folds[r["fit"]], r["code"]] = r["edges"]
    kinds = vals.filter(~F.col("code").isin(*CONTINUOUS)).collect()
    for fit in folds:
        for c in codes:
            if c not in CONTINUOUS:
                found[fit, c] = sorted(r["x"] for r in kinds if r["code"] == c and any(r[own[i]] for i in trains[fit]))
    models = spark.sparkContext.broadcast((folds, trains, {key: np.array(edges, dtype=float) for key, edges in found.items()}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, trains, edges = models.value
        sums = {(k, i, y): np.zeros(len(edges[fit, c]) + 1, dtype=np.int64) for k, fit in enumerate(folds) for i, c in enumerate(codes) for y in (0, 1)}
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            of = b.column("own").dictionary_encode()
            at = of.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for i, c in enumerate(codes):
                x = b.column(c).to_numpy()
                for j, own in [(-1, None), *enumerate(of.dictionary.to_pylist())]:
                    part = at == j
                    if not part.any():
                        continue
                    o = folds.index(own)
                    for k, fit in enumerate(folds):
                        if o in trains[fit]:
                            bins = np.searchsorted(edges[fit, c], x[part], side="right" if c in CONTINUOUS else "left")
                            for v in (0, 1):
                                sums[k, i, v] += np.bincount(bins[y[part] == v], minlength=len(sums[k, i, v]))
        for (k, i, v), n in sums.items():
            bins = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), u), pa.int32()) for u in (k, i, v)] + [pa.array(bins, pa.int32()), pa.array(n[bins])], names=["k", "i", "y", "bin", "n"])

    counts = {key: [np.zeros(len(edges) + 1), np.zeros(len(edges) + 1)] for key, edges in found.items()}
    for r in rows.mapInArrow(count, "k int, i int, y int, bin int, n long").groupBy("k", "i", "y", "bin").agg(F.sum("n").alias("n")).collect():
        counts[folds[r["k"]], codes[r["i"]]][r["y"]][r["bin"]] = r["n"]
    share = lambda n: (n + ALPHA) / (n.sum() + ALPHA * len(n))
    return {key: (np.array(found[key], dtype=float), np.log(share(n1) / share(n0)), key[1] in CONTINUOUS) for key, (n0, n1) in counts.items() if n0.sum() + n1.sum()}


def _bin_value(model: tuple, x: np.ndarray) -> np.ndarray:
    edges, llr, continuous = model
    if continuous:
        at = np.searchsorted(edges, x, side="right")
    else:
        at = np.searchsorted(edges, x)
        at[(at == len(edges)) | (np.append(edges, np.nan)[at] != x)] = len(edges)  # unseen categories have the last bin
    return np.where(np.isnan(x), np.nan, llr[at])


def _kernel_models(train: DataFrame, fold: str, label: str, codes: Sequence[str]) -> dict:
    """(fit, code) to (lowest and highest training value, the :func:`_pieces` of either class).

    Rows are summed once, for their own fold and class, to moments of cells; those of a fit are the ones of its training folds.
    The cells of a fold are at most h / 2 wide for the least width h of the fits that train on it.
    """
    if not codes:
        return {}
    spark = train.sparkSession
    rows = train.select(F.col(fold).alias("own"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in codes])
    aggs = lambda c: F.struct(F.count("*").alias("m"), F.count(c).alias("known"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("dev"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
    stats = rows.groupBy("own", "y").agg(*[aggs(c) for c in codes]).collect()
    fits = list(dict.fromkeys(r["own"] for r in stats))
    spans, widths, steps = {}, {}, {}
    for fit in fits:
        of = [r for r in stats if fit is None or (r["own"] is not None and r["own"] != fit)]
        for c in codes:
            seen = [r[c] for r in of if r[c]["known"]]
            if seen:
                # a NaN counts as the highest value
                spans[fit, c] = (min((s["lo"] for s in seen), key=lambda v: (np.isnan(v), v)), max((s["hi"] for s in seen), key=lambda v: (np.isnan(v), v)))
            for y in (0, 1):
                own = [r for r in of if r["y"] == y]
                m = sum(r[c]["m"] for r in own)
                if m < 2 or any(r[c]["known"] < r[c]["m"] for r in own):
                    continue  # a class with one value, or an unknown one, has no density
                mean = sum(r[c]["m"] * r[c]["mean"] for r in own) / m
                dev = sum(r[c]["dev"] + r[c]["m"] * (r[c]["mean"] - mean) ** 2 for r in own)
                h = math.sqrt(dev / (m - 1)) * float(m) ** -0.2 if math.isfinite(dev) else math.nan
                if h > 0:
                    widths[fit, c, y] = (m, min(r[c]["lo"] for r in own), h)
                    for r in own:
                        steps[r["own"], y, c] = min(h / 2, steps.get((r["own"], y, c), math.inf))
    if not widths:
        return {key: (*span, (None, None)) for key, span in spans.items()}
    groups = [(r["own"], r["y"]) for r in stats if r["y"] in (0, 1)]
    lows = {(r["own"], r["y"], c): r[c]["lo"] for r in stats for c in codes}
    own_kind = rows.schema["own"].dataType.simpleString()
    grids = spark.createDataFrame(
        [(own, y, i, *itertools.chain(*[(lows[own, y, c], steps[own, y, c]) if (own, y, c) in steps else (None, None) for c in codes])) for i, (own, y) in enumerate(groups)],
        f"own2 {own_kind}, y2 int, g long, " + ", ".join(f"lo{i} double, step{i} double" for i in range(len(codes))),
    )
    x = rows.join(F.broadcast(grids), F.col("own").eqNullSafe(F.col("own2")) & (F.col("y") == F.col("y2")))
    at = [(F.col(c) - F.col(f"lo{i}")) / F.col(f"step{i}") for i, c in enumerate(codes)]
    x = x.select("g", *[a.alias(f"at{i}") for i, a in enumerate(at)])
    names = [f"w{j}" for j in range(TERMS)]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {i: [] for i in range(len(codes))}
        for b in batches:
            g = b.column("g").to_numpy()
            for i in held:
                v = b.column(f"at{i}").to_numpy(zero_copy_only=False)
                known = np.isfinite(v)
                cell = np.floor(v[known])
                places, inverse = np.unique(np.stack([g[known], cell.astype(np.int64)]), axis=1, return_inverse=True)
                e = v[known] - cell - 0.5
                w, term = np.empty((places.shape[1], TERMS)), np.ones(len(e))
                for j in range(TERMS):
                    w[:, j] = np.bincount(inverse.ravel(), term, places.shape[1])
                    term = term * e / (j + 1)
                held[i].append((*places, w))
                if len(held[i]) >= 64:
                    held[i] = [_merged(held[i])]
        for i, parts in held.items():
            if parts:
                g, cell, w = _merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i), pa.int32()), pa.array(g), pa.array(cell), *[pa.array(w[:, j]) for j in range(TERMS)]], names=["i", "g", "cell", *names])

    sums = x.mapInArrow(moments, "i int, g long, cell long, " + ", ".join(f"{n} double" for n in names))
    sums = sums.groupBy("i", "g", "cell").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    index = [sums.column(n).to_numpy() for n in ("i", "g", "cell")]
    w = np.stack([sums.column(n).to_numpy() for n in names], axis=1)
    cells = {}
    for i, c in enumerate(codes):
        for g, (own, y) in enumerate(groups):
            of = (index[0] == i) & (index[1] == g)
            cells[own, y, c] = (index[2][of], w[of])

    jobs = []
    for (fit, c, y), (m, lo, h) in widths.items():
        middles, weights = [], []
        for own, of in groups:
            if of == y and (fit is None or (own is not None and own != fit)):
                cell, w = cells[own, y, c]
                step = steps[own, y, c]
                middles.append((lows[own, y, c] - lo + (cell + 0.5) * step) / h)
                weights.append(w * (step / h) ** np.arange(TERMS) @ _SHIFT)
        middle = np.concatenate(middles)
        order = np.argsort(middle, kind="stable")
        jobs.append(((fit, c, y), {"m": m, "lo": lo, "h": h, "cell": 2 * middle[order] - 0.5, "w": np.concatenate(weights)[order]}, spans[fit, c]))
    pieces = dict(spark.sparkContext.parallelize(jobs, len(jobs)).map(lambda job: (job[0], _pieces(job[1], *job[2]))).collect())
    return {(fit, c): (*span, tuple(pieces.get((fit, c, y)) for y in (0, 1))) for (fit, c), span in spans.items()}


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moments of the same group and cell added up."""
    g, cell, w = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((cell, g))
    g, cell, w = g[order], cell[order], w[order]
    if not len(g):
        return g, cell, w
    new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (cell[1:] != cell[:-1])))
    return g[new], cell[new], np.add.reduceat(w, new)


def _shift() -> np.ndarray:
    """From sums of e^j / j! to those of e^j / j! exp(-e^2 / 2), |e| being at most 1/4."""
    out = np.zeros((TERMS, TERMS))
    for j in range(TERMS):
        for k in range((TERMS - 1 - j) // 2 + 1):
            out[j + 2 * k, j] = (-0.5) ** k / math.factorial(k) * (math.factorial(j + 2 * k) // math.factorial(j))
    return out


_SHIFT = _shift()
_PLACES = -np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)  # ascending in -1 to 1
_CHEBYSHEV = np.cos(np.outer(np.arange(NODES), np.arccos(_PLACES))) * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES


def _pieces(model: dict, least: float, most: float) -> tuple:
    """(lowest value, width h, cells of h / 2 within reach of training values, a Chebyshev series of the density for each) between ``least`` and ``most``.

    Within a cell a kernel at REACH widths changes by exp(6), for which the terms left out lie below the rounding of doubles.
    """
    lo, h = model["lo"], model["h"]
    reach = int(2 * REACH) + 1
    cell = np.unique(np.floor(model["cell"] + 0.5).astype(np.int64))
    cell = np.unique(cell[:, None] + np.arange(-reach, reach + 1))
    if math.isfinite(least) and math.isfinite(most):
        cell = cell[(cell >= math.floor(2 * (least - lo) / h)) & (cell <= math.floor(2 * (most - lo) / h))]
    at = (cell[:, None] + 0.5 + 0.5 * _PLACES) / 2
    d = _density(lo + h * at.ravel(), model).reshape(at.shape)
    return lo, h, cell, np.ascontiguousarray((d @ _CHEBYSHEV.T).T)


def _kernel_value(model: tuple, x: np.ndarray) -> np.ndarray:
    """The log ratio of both densities at ``x``, unknown where a class has none."""
    least, most, pieces = model
    z, d = np.clip(x, least, most), []
    for piece in pieces:
        if piece is None:
            return np.full(len(x), np.nan)
        lo, h, cells, series = piece
        if not len(cells):
            d.append(np.where(np.isfinite(z), 0.0, np.nan))
            continue
        at = 2 * ((z - lo) / h)
        known = np.isfinite(at)
        cell = np.floor(np.where(known, at, 0.0))
        i = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        t = 2 * (at - cell) - 1
        b1 = b2 = np.zeros(len(x))
        for c in series[:0:-1]:
            b1, b2 = c[i] + 2 * t * b1 - b2, b1
        v = np.where(cells[i] == cell, series[0][i] + t * b1 - b2, 0.0)
        d.append(np.where(known, np.maximum(v, 0.0), np.nan))
    return np.log((d[1] + FLOOR) / (d[0] + FLOOR))


VIEWS = ("RAW:RAW_D", "KDE_LEGACY:D+AR", "KDE_LEGACY:D+MW", "QNB:D+AR")


def rank_candidates(scores: DataFrame, row_id: str, entity: str) -> DataFrame:
    """``scores`` with average rank and rank fraction per method, over all rows and within the entity."""
    from pairloom.operators.ranks import rank_fraction

    g = rank_fraction(scores, ["method"], F.col("score")).select(row_id, entity, "method", "score", F.col("rank").alias("global_rank"), F.col("fraction").alias("global_fraction"))
    w = rank_fraction(scores, ["method", entity], F.col("score")).select(row_id, "method", F.col("rank").alias("within_rank"), F.col("fraction").alias("within_fraction"))
    return g.join(w, [row_id, "method"])


HELD = 100_000  # rows of an entity that a task ranks at once; a larger one is ranked by positions


def votes(scores: DataFrame, ids: Sequence[str], entity: str, names: Sequence[str], cut: float = 0.1, rows: DataFrame | None = None) -> DataFrame:
    """``scores``, a row per ``ids`` with the columns ``names``, with ``global_hit`` and ``protein_hit``: in how many of these columns the rank fraction of
    :func:`rank_candidates` over all rows, and within the entity, is at most ``cut``.

    Of all ranks only the lowest score within the cut is looked for, among those above a quantile that lies safely below it.
    ``rows``: the rows without their scores, if these are cheaper to count by entity.
    """
    from pairloom.operators.keys import finite
    from pairloom.operators.ranks import null_safe_join, rank_fraction, tie_table

    scores = scores.withColumns({n: finite(F.col(n)) for n in names})
    size = (scores if rows is None else rows).groupBy(F.col(entity).alias("e__")).agg(F.count("*").alias("n__")).filter(F.col("n__") > HELD).select("e__")
    if size.isEmpty():
        within = _held_hits(scores, entity, names, cut)
    else:
        hot = written(size, "hot")
        same = F.col(entity).eqNullSafe(F.col("e__"))
        large = scores.join(F.broadcast(hot), same, "left_semi")
        long = large.select(*ids, entity, F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("score")) for n in names])).alias("m")).select(*ids, entity, "m.*")
        hits = rank_fraction(written(long, "hot"), ["method", entity], F.col("score")).groupBy(*ids).agg(F.sum((F.col("fraction") <= cut).cast("long")).alias("protein_hit"))
        within = _held_hits(scores.join(F.broadcast(hot), same, "left_anti"), entity, names, cut).unionByName(null_safe_join(large, hits, ids))
    within = written(within, "votes")
    n = within.agg(*[F.count(c).alias(c) for c in names]).first()
    above = within.approxQuantile(list(names), [max(0.0, 1 - cut - 0.01)], 0.002)
    top = [F.struct(F.lit(c).alias("method"), F.when(F.col(c) >= q[0], F.col(c)).alias("score"), F.lit(n[c]).alias("scored")) for c, q in zip(names, above) if q]
    least = {}
    if top:
        ties = tie_table(within.select(F.explode(F.array(*top)).alias("m")).select("m.*"), ["method", "scored"], F.col("score"))
        rank = F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)
        least = {r["method"]: r["least"] for r in ties.filter((rank - 0.5) / F.col("scored") <= cut).groupBy("method").agg(F.min("score").alias("least")).collect()}
    known = sum(F.col(c).isNotNull().cast("long") for c in names)
    hits = sum((F.coalesce(F.col(c) >= F.lit(least.get(c)).cast("double"), F.lit(False)).cast("long") for c in names))
    return within.withColumn("global_hit", F.when(known > 0, hits))


def _held_hits(scores: DataFrame, entity: str, names: Sequence[str], cut: float) -> DataFrame:
    """``scores`` with ``protein_hit``; a task holds one entity's rows besides its current batch."""
    names = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            starts = np.flatnonzero(_changes(b, [entity], last))
            last = {entity: b.column(entity)[-1].as_py()}
            if not len(starts):
                held.append(b)
                continue
            if done := [x for x in [*held, b.slice(0, starts[-1])] if x.num_rows]:
                yield one(pa.Table.from_batches(done).combine_chunks().to_batches()[0])
            held = [b.slice(starts[-1])]
        if held:
            yield one(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        group = np.cumsum(_changes(b, [entity], None)) - 1
        hits, known = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=bool)
        for n in names:
            rows = np.flatnonzero(b.column(n).is_valid().to_numpy(zero_copy_only=False))
            if not len(rows):
                continue
            s = b.column(n).to_numpy(zero_copy_only=False)
            rows = rows[np.lexsort((-s[rows], group[rows]))]
            g, v = group[rows], s[rows]
            new_group = np.append(True, g[1:] != g[:-1])
            new_score = new_group | np.append(True, v[1:] != v[:-1])
            groups, ties = np.flatnonzero(new_group), np.flatnonzero(new_score)
            peers = np.diff(np.append(ties, len(rows)))
            size = np.diff(np.append(groups, len(rows)))
            of = np.cumsum(new_group)[ties] - 1
            rank = (ties - groups[of] + peers) - (peers - 1) / 2.0
            hits[rows] += np.repeat((rank - 0.5) / size[of] <= cut, peers)
            known[rows] = True
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, mask=~known)], names=[*b.schema.names, "protein_hit"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in scores.schema.fields], "protein_hit long"])
    return scores.repartition(entity).sortWithinPartitions(entity).mapInArrow(run, schema)


def review_funnel(pairs: DataFrame, rankings: DataFrame, row_id: str, cut: float = 0.1) -> DataFrame:
    """``pairs`` with the votes of the four views and the cumulative passes spatial, role, agreement, repeated."""
    v = rankings.filter(F.col("method").isin(*VIEWS)).groupBy(row_id).agg(
        F.sum((F.col("global_fraction") <= cut).cast("long")).alias("global_hit"), F.sum((F.col("within_fraction") <= cut).cast("long")).alias("protein_hit")
    )
    return funnel_passes(pairs.join(v, row_id))


def funnel_passes(x: DataFrame) -> DataFrame:
    """``x``, pairs with ``global_hit`` and ``protein_hit``, with the cumulative passes."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    x = x.withColumn("spatial_pass", ok((F.col("D") >= 10) & (F.col("min_heavy_distance") >= 6) & F.col("no_residue_overlap")))
    x = x.withColumn("role_pass", F.col("spatial_pass") & ok(F.col("compound_pass") & F.col("known_role_pass")))
    x = x.withColumn("agreement_pass", F.col("role_pass") & ok((F.col("global_hit") >= 2) & (F.col("protein_hit") >= 3)))
    return x.withColumn("repeated_pass", F.col("agreement_pass") & ok((F.col("sources") >= 2) & (F.col("fraction_ge10") >= 0.75)))
