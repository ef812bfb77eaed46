"""Docking endpoints: evaluable targets, known-site matches, repeated success and paired statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.checks import require
from pairloom.operators.geometry import XYZ
from pairloom.operators.observations import medoid
from pairloom.operators.resample import MAX_CELLS, block_statistics, holm

# fixed values: names of reference kinds, endpoints and default reasons in result tables
LIMITED = "limited_catalytic_residue_reference"
STRICT, KNOWN = "strict_distinct6A", "known_allosteric_site"
STRICT_REASON = "Limited catalytic-residue reference does not define the complete orthosteric site"
KNOWN_REASON = "Known-site reference is incompletely transferred or otherwise not evaluable"
SUPPORT = ("both_same_box", "spatially_stable")


def evaluability(refs: DataFrame, target: str) -> DataFrame:
    """``strict``, ``strict_reason``, ``known``, ``known_reason`` per target from ``reference_kind`` and the optional flags
    ``strict_distinct_evaluable``, ``known_site_evaluable`` and their ``.._exclusion_reason``.

    A limited reference is never strict; one that says so raises. Missing flags take the defaults.
    """
    limited = F.col("reference_kind") == LIMITED
    require({"Limited residues cannot define a full reference": refs.filter(limited & F.coalesce("strict_distinct_evaluable", F.lit(False)))})
    strict, known = F.coalesce("strict_distinct_evaluable", ~limited), F.coalesce("known_site_evaluable", F.lit(True))
    return refs.select(
        target, strict.alias("strict"), F.when(strict, "").otherwise(F.coalesce("strict_distinct_exclusion_reason", F.lit(STRICT_REASON))).alias("strict_reason"),
        known.alias("known"), F.when(known, "").otherwise(F.coalesce("known_site_exclusion_reason", F.lit(KNOWN_REASON))).alias("known_reason"),
    )


def endpoint_targets(flags: DataFrame, coverage: DataFrame, target: str) -> DataFrame:
    """``endpoint`` and target: strict ones, and those with an evaluable known site that a box covers (``coverage``: target, ``covered``)."""
    covered = coverage.filter("covered").select(target).distinct()
    return flags.filter("strict").select(F.lit(STRICT).alias("endpoint"), target).unionByName(
        flags.filter("known").join(covered, target, "left_semi").select(F.lit(KNOWN).alias("endpoint"), target)
    )


def known_site_matches(poses: DataFrame, sites: DataFrame, coverage: DataFrame, target: str, pose: str, box: str, site: str) -> DataFrame:
    """``recall``, ``precision``, ``distance``, ``covered``, ``match`` of each pose with each known site of its target.

    ``poses``: target, pose, box, ``contacts`` (array), ``valid`` and centroid ``x``, ``y``, ``z``; ``sites``: target, site, ``keys`` (array)
    and centroid ``sx``, ``sy``, ``sz``; ``coverage``: target, site, box, ``covered``. A valid pose matches with at least three
    shared residues, a quarter of the site's residues, and centroids at most 5 apart.
    """
    require({"Known site has fewer than 3 contact residues": sites.filter(F.size(F.array_distinct("keys")) < 3), "Repeated site": sites.groupBy(target, site).count().filter("count > 1")})
    shared, own, all_ = F.size(F.array_intersect("contacts", "keys")), F.size(F.array_distinct("keys")), F.size(F.array_distinct("contacts"))
    gap = F.sqrt(sum(((F.col(c) - F.col(f"s{c}")) * (F.col(c) - F.col(f"s{c}")) for c in XYZ), F.lit(0.0)))
    x = poses.join(sites, target).join(coverage.select(target, site, box, "covered"), [target, site, box], "left")
    x = x.withColumns({"recall": shared / own.cast("double"), "precision": F.when(all_ > 0, shared / all_.cast("double")).otherwise(0.0), "distance": gap, "covered": F.coalesce("covered", F.lit(False))})
    hit = F.col("valid") & (shared >= 3) & (F.col("recall") >= 0.25) & (F.col("distance") <= 5.0)
    return x.select(target, pose, box, site, "recall", "precision", "distance", "covered", F.coalesce(hit, F.lit(False)).alias("match"))


def seed_grid_problems(poses: DataFrame, system: str, box: str, scorings: Sequence[str], seeds: int = 5) -> DataFrame:
    """``system``, ``box``, ``problem`` of boxes whose poses are not exactly ``seeds`` seeds for each scoring function; empty if complete."""
    g = poses.groupBy(system, box, "scoring").agg(F.count("*").alias("n"), F.count_distinct("seed").alias("d"))
    repeated = g.filter("n <> d").select(system, box, F.lit("repeated seed").alias("problem"))
    short = g.filter(F.col("d") != seeds).select(system, box, F.lit("number of seeds").alias("problem"))
    every = g.groupBy(system, box).agg(F.array_sort(F.collect_set("scoring")).alias("s"))
    missing = every.filter(F.col("s") != F.array(*map(F.lit, sorted(scorings)))).select(system, box, F.lit("scoring functions").alias("problem"))
    return repeated.unionByName(short).unionByName(missing)


def repeated_success(hits: DataFrame, system: str, box: str, site: str, scorings: Sequence[str], least: int = 3, apart: float = 5.0, radius: float = 4.0, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``scoring``, ``system``: the systems that a scoring function supports, and those under ``both_same_box`` and ``spatially_stable``.

    ``hits`` are successful poses with ``seed`` and centroid. Support takes ``least`` seeds in one box at one site;
    both functions must give it in the same box and site; it is stable if the medoids of both gather ``least`` seeds and lie within ``apart``.
    """
    keys = [*by, system, box, site]
    n = hits.filter(F.col("scoring").isin(*scorings)).groupBy(*keys, "scoring").agg(F.count_distinct("seed").alias("n")).filter(F.col("n") >= least)
    both = n.groupBy(*keys).agg(F.count("*").alias("c")).filter(F.col("c") == len(scorings)).select(*keys)
    m = medoid(hits.join(both, keys, "left_semi"), [*keys, "scoring"], "seed", XYZ, radius)
    spread = sum(((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in XYZ), F.lit(0.0))
    stable = m.groupBy(*keys).agg(F.min("n_near").alias("lo"), spread.alias("d2")).filter((F.col("lo") >= least) & (F.col("d2") <= apart * apart))
    parts = [n.select(*by, "scoring", system), both.select(*by, F.lit(SUPPORT[0]).alias("scoring"), system), stable.select(*by, F.lit(SUPPORT[1]).alias("scoring"), system)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def endpoint_table(units: DataFrame, targets: DataFrame, hits: DataFrame, target: str, system: str, box: str, scorings: Sequence[str], cutoffs: Sequence[float | None] = (None, -5.0)) -> DataFrame:
    """``units`` of the evaluable targets with ``endpoint``, ``energy_cutoff``, ``scoring`` and ``success``.

    ``hits``: successful poses with ``endpoint``, ``site``, ``seed``, ``scoring``, ``score`` and centroid. One row for every unit, endpoint,
    cutoff and criterion; ``success`` says whether the unit's system is supported there.
    """
    names = ["none" if c is None else f"{c:g}" for c in cutoffs]
    cut = F.array(*[F.when(F.lit(True) if c is None else F.col("score") <= c, F.lit(n)) for n, c in zip(names, cutoffs)])
    counted = hits.join(targets, ["endpoint", target], "left_semi").withColumn("energy_cutoff", F.explode(F.array_compact(cut)))
    won = repeated_success(counted, system, box, "site", scorings, by=["endpoint", "energy_cutoff"])
    grid = units.join(targets, target).withColumn("energy_cutoff", F.explode(F.array(*map(F.lit, names)))).withColumn("scoring", F.explode(F.array(*map(F.lit, (*scorings, *SUPPORT)))))
    keys = ["endpoint", "energy_cutoff", "scoring", system]
    return grid.join(won.withColumn("w__", F.lit(True)), keys, "left").withColumn("success", F.coalesce("w__", F.lit(False))).drop("w__")


def invalid_units(units: DataFrame, system: str, match: str, target: str) -> DataFrame:
    """``match`` of the pairs that are not one candidate and one comparison on the same target, or that repeat a system."""
    g = units.groupBy(match).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("role")).alias("r"), F.count_distinct(target).alias("t"))
    bad = g.filter((F.col("n") != 2) | (F.col("r") != F.array(F.lit("candidate"), F.lit("comparison"))) | (F.col("t") != 1)).select(match)
    twice = units.groupBy(system).agg(F.count("*").alias("n"), F.min(match).alias(match)).filter("n > 1").select(match)
    return bad.unionByName(twice).distinct()


def endpoint_summary(table: DataFrame, by: Sequence[str], family: Sequence[str], target: str, match: str, success: Column, replicates: int = 10_000, family_size: int = 16) -> DataFrame:
    """Paired statistics per condition ``by``: pair and block counts, means, ``delta`` with interval, sign-flip ``p``, discordance counts and ``holm_p`` within ``family``.

    Pairs are reduced to one row of sums per condition and target in Spark; the blocks of a condition are what is drawn and flipped
    (:func:`pairloom.operators.resample.block_statistics`). Raises if a family has more conditions than ``family_size``.
    """
    v = success.cast("double")
    pairs = table.groupBy(*by, target, match).agg(F.max(F.when(F.col("role") == "candidate", v)).alias("a"), F.max(F.when(F.col("role") == "comparison", v)).alias("b"))
    require({"Every pair needs both roles": pairs.filter("a IS NULL OR b IS NULL")})
    one = lambda c: F.sum(c.cast("long"))
    a, b = F.col("a") == 1, F.col("b") == 1
    sums = pairs.groupBy(*by, target).agg(
        F.count("*").alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), one(a & ~b).alias("c10"), one(~a & b).alias("c01"), one(a & b).alias("c11"), one(~a & ~b).alias("c00")
    ).limit(MAX_CELLS + 1).collect()
    if len(sums) > MAX_CELLS:
        raise ValueError("Too many blocks for resampling on the driver")
    groups: dict[tuple, list] = {}
    for r in sorted(sums, key=lambda r: str(r[target])):
        groups.setdefault(tuple(r[c] for c in by), []).append(r)
    out = []
    for key, rows in groups.items():
        n, sa, sb = (np.array([float(r[c]) for r in rows]) for c in ("n", "sa", "sb"))
        x = block_statistics(sa - sb, n, replicates)
        out.append((*key, int(n.sum()), len(rows), float(sa.sum() / n.sum()), float(sb.sum() / n.sum()), x["delta"], x["ci_low"], x["ci_high"], x["p"], x["method"], *(sum(r[c] for r in rows) for c in ("c10", "c01", "c11", "c00"))))
    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, n_pairs long, n_blocks long, candidate_mean double, comparison_mean double, delta double, ci_low double, ci_high double, p double, method string, candidate_only long, comparison_only long, both long, neither long"
    result = table.sparkSession.createDataFrame(out, schema)
    require({"More conditions than the testing family": result.groupBy(*family).count().filter(F.col("count") > family_size)})
    rest = [c for c in by if c not in family]
    return holm(result.withColumn("tie__", F.to_json(F.struct(*rest))), family, "p", "tie__", family_size).drop("tie__")
