"""Contacts, distances and fits of 3-D points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import written

XYZ = ("x", "y", "z")


def distance2(a: str, b: str) -> Column:
    return sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in XYZ), F.lit(0.0))


def within_radius(left: DataFrame, right: DataFrame, on: Sequence[str], radius: float) -> DataFrame:
    """Pairs of points of two tables (``x``, ``y``, ``z`` and ids of different names) that agree in ``on`` and lie within ``radius``.

    Points meet by equi-join on grid cells of the radius' size: the left point looks into
    its own and the 26 cells around it, the exact distance decides. Points with a missing or infinite coordinate never match.
    """
    ok = F.lit(True)
    for c in XYZ:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e15)
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    l = left.filter(ok)
    for c in XYZ:
        l = l.withColumn(f"s__{c}", F.explode(near)).withColumn(f"g__{c}", cell(c) + F.col(f"s__{c}"))
    r = right.filter(ok).select("*", *[cell(c).alias(f"h__{c}") for c in XYZ])
    cond = F.lit(True)
    for c in XYZ:
        cond = cond & (F.col(f"l.g__{c}") == F.col(f"r.h__{c}"))
    for c in on:
        cond = cond & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    d2 = distance2("l", "r")
    keep_r = [F.col(f"r.{c}") for c in right.columns if c not in (*on, *XYZ)]
    return l.alias("l").join(r.alias("r"), cond).filter(d2 <= radius * radius).select(
        *[F.col(f"l.{c}") for c in left.columns if c not in XYZ], *keep_r, F.sqrt(d2).alias("distance")
    )


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], keys: Sequence[str], radius: float = 2.0) -> DataFrame:
    """``min_distance`` per left key to the right points with equal ``on``.

    Cells around each point are searched (:func:`within_radius`), with a radius that doubles
    for the keys that have found nothing yet: the nearest point inside the radius is the nearest of all. Keys without a
    right point, and points with a missing or infinite coordinate, are left out.
    """
    good = F.lit(True)
    for c in XYZ:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e15)
    r = right.filter(good).select(*on, *XYZ)
    open_ = left.filter(good).join(r.select(*on).distinct(), list(on), "left_semi").select(*dict.fromkeys([*on, *keys]), *XYZ)
    done = []
    while True:
        near = written(within_radius(open_, r, on, radius).groupBy(*keys).agg(F.min("distance").alias("min_distance")), "nearest")
        done.append(near)
        open_ = written(null_safe_anti(open_, near, keys), "far")
        if not open_.limit(1).count():
            break
        radius *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def null_safe_anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"{k}__r") for k in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}__r"))
    return left.join(r, cond, "left_anti")


def min_image_distance(a: str, b: str, cell: Sequence[float]) -> Column:
    """Shortest distance of two points (struct columns) in a periodic box with right angles."""
    total = F.lit(0.0)
    for c, size in zip(XYZ, cell):
        d = F.col(f"{a}.{c}") - F.col(f"{b}.{c}")
        d = d - F.lit(float(size)) * F.floor(d / F.lit(float(size)) + 0.5)
        total = total + d * d
    return F.sqrt(total)


def min_image_matrix(x: np.ndarray, y: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Shortest distances between two point sets in any periodic cell, given by its row vectors.

    Differences are wrapped in cell coordinates, then the 27 neighbouring images are compared.
    """
    d = x[:, None, :] - y[None, :, :]
    f = d @ np.linalg.inv(cell)
    d = (f - np.round(f)) @ cell
    s = np.stack(np.meshgrid(*[[-1, 0, 1]] * 3, indexing="ij"), axis=-1).reshape(-1, 3) @ cell
    return np.sqrt(((d[:, :, None, :] + s) ** 2).sum(-1)).min(axis=-1)


def box_coverage(sites: DataFrame, boxes: DataFrame, on: Sequence[str], site: str, box: str, least: float = 0.8) -> DataFrame:
    """``inside`` (share of a site's atoms in a box), ``centroid_inside``, ``covered`` for each site and box of equal ``on``.

    ``boxes`` has ``cx``.. and ``sx``..: centre and size; a table of a few boxes per target.
    """
    j = sites.join(boxes, list(on))
    out = lambda v: [F.abs(v(c) - F.col(f"c{c}")) <= F.col(f"s{c}") / 2 for c in XYZ]
    a = out(F.col)
    g = j.groupBy(*on, site, box, *[f"c{c}" for c in XYZ], *[f"s{c}" for c in XYZ]).agg(
        F.avg((a[0] & a[1] & a[2]).cast("double")).alias("inside"), *[F.avg(c).alias(f"m{c}") for c in XYZ]
    )
    m = out(lambda c: F.col(f"m{c}"))
    g = g.withColumn("centroid_inside", m[0] & m[1] & m[2])
    return g.select(*on, site, box, "inside", "centroid_inside", (F.col("centroid_inside") & (F.col("inside") >= least)).alias("covered"))


def classify_poses(poses: DataFrame, receptor: DataFrame, primary: DataFrame, on: Sequence[str], pose: str, residue: str, radius: float = 4.0, clash: float = 1.2, apart: float = 6.0, least: int = 3) -> DataFrame:
    """Per pose: ``n_atoms``, ``n_contacts``, ``min_receptor``, ``min_primary``, ``valid`` and ``distinct``.

    Valid: no atom closer than ``clash`` and at least ``least`` residues within ``radius``. Distinct: valid,
    at least ``apart`` from the primary reference and without a residue that is also in contact with it.
    """
    hit = within_radius(poses.select(*on, pose, *XYZ), receptor.select(*on, residue, *XYZ), on, radius)
    c = hit.groupBy(*on, pose).agg(F.collect_set(residue).alias("residues"))
    ref = within_radius(primary.select(*on, *XYZ), receptor.select(*on, residue, *XYZ), on, radius).groupBy(*on).agg(F.collect_set(residue).alias("shared__"))
    base = poses.groupBy(*on, pose).agg(F.count("*").alias("n_atoms"))
    a = nearest(poses, receptor, on, [*on, pose]).withColumnRenamed("min_distance", "min_receptor")
    b = nearest(poses, primary, on, [*on, pose]).withColumnRenamed("min_distance", "min_primary")
    k = [*on, pose]
    x = base.join(c, k, "left").join(ref, list(on), "left").join(a, k, "left").join(b, k, "left")
    n = F.when(F.col("residues").isNull(), 0).otherwise(F.size("residues"))
    none = F.lit(None).cast("array<string>")
    overlap = F.coalesce(F.arrays_overlap("residues", "shared__"), F.lit(False))
    x = x.withColumn("n_contacts", n).withColumn("valid", F.coalesce((F.col("min_receptor") >= clash) & (n >= least), F.lit(False)))
    return x.select(*k, "n_atoms", "n_contacts", "min_receptor", "min_primary", "valid", F.coalesce(F.col("valid") & ~overlap & (F.col("min_primary") >= apart), F.lit(False)).alias("distinct"))


def clashes(df: DataFrame, keys: Sequence[str], residue: str, atom: str, limit: float = 2.2) -> DataFrame:
    """``n_clashes`` per key: pairs of atoms of residues that are not neighbours and closer than ``limit``."""
    a = df.select(*keys, F.col(residue).alias("ra"), F.col(atom).alias("aa"), *XYZ)
    b = df.select(*keys, F.col(residue).alias("rb"), F.col(atom).alias("ab"), *XYZ)
    return within_radius(a, b, keys, limit).filter((F.col("aa") < F.col("ab")) & (F.abs(F.col("ra") - F.col("rb")) > 1) & (F.col("distance") < limit)).groupBy(*keys).agg(F.count("*").alias("n_clashes"))


def kabsch_rmsd(df: DataFrame, key: str, moving: str, fixed: str) -> DataFrame:
    """``rmsd`` of two point sets (ARRAY of coordinate arrays) per row after the best rotation; null if they differ in length."""
    kind = df.schema[key].dataType.simpleString()

    def one(p, q) -> float | None:
        p, q = np.array([list(v) for v in p], float), np.array([list(v) for v in q], float)
        if p.shape != q.shape or not len(p):
            return None
        p, q = p - p.mean(0), q - q.mean(0)
        u, s, vt = np.linalg.svd(p.T @ q)
        s[-1] *= np.sign(np.linalg.det(u @ vt))
        return float(np.sqrt(max(0.0, ((p**2).sum() + (q**2).sum() - 2 * s.sum()) / len(p))))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "rmsd": [one(p, q) for p, q in zip(b[moving], b[fixed])]})

    return df.select(key, moving, fixed).mapInPandas(run, f"{key} {kind}, rmsd double")
