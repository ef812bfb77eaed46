"""Quality checks of periodic molecular frames: cells, contacts, imaging, poses and schedules.

A frame is one row with its coordinates as arrays; frames are worked through in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.geometry import min_image_matrix
from pairloom.operators.series import interpolate

CONTACT = 4.5
# fixed values: tolerances of the imaging check, in length units or parts of a cell
DEFORMED, CELL_STEP, MIN_GAP, NEAREST_COPY, CLASH = 0.001, 0.01, 0.05, 1.0, 1.2


def cell_vectors(lengths: Column, angles: Column) -> Column:
    """Rows of the lower-triangular cell matrix (ARRAY of three arrays) from three lengths and three angles in degrees."""
    a, b, c = (lengths[i] for i in range(3))
    al, be, ga = (F.radians(angles[i]) for i in range(3))
    x = c * F.cos(be)
    y = c * (F.cos(al) - F.cos(be) * F.cos(ga)) / F.greatest(F.sin(ga), F.lit(1e-12))
    zero = F.lit(0.0)
    return F.array(F.array(a, zero, zero), F.array(b * F.cos(ga), b * F.sin(ga), zero), F.array(x, y, F.sqrt(F.greatest(c * c - x * x - y * y, zero))))


def perpendicular_widths(cell: Column) -> Column:
    """Distances between the opposite faces of a cell (ARRAY of three row arrays): volume over the area of each face."""
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    v = [cell[i] for i in range(3)]
    faces = [cross(v[(i + 1) % 3], v[(i + 2) % 3]) for i in range(3)]
    volume = F.abs(sum((v[0][k] * faces[0][k] for k in range(3)), F.lit(0.0)))
    return F.array(*[volume / F.sqrt(sum((f[k] * f[k] for k in range(3)), F.lit(0.0))) for f in faces])


def _xyz(v) -> np.ndarray:
    return np.array([list(p) for p in v], dtype=float).reshape(-1, 3)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x[:, None, :] - y[None, :, :]
    return np.sqrt(np.einsum("ijk,ijk->ij", d, d))


def contact_table(frames: DataFrame, frame: str, ligand: str, protein: str, residues: str, cell: str, site: Sequence[int], radius: float = CONTACT) -> DataFrame:
    """Per frame the contacts of ligand and protein atoms: ``raw_pairs``, ``raw_min`` of the coordinates as they are, and
    ``mim_pairs``, ``mim_min``, ``mim_residues``, ``mim_site`` (residues in contact, and those of the site) over periodic images.

    ``residues`` gives the residue of each protein atom. ``too_wide`` tells that the radius exceeds half the narrowest cell width.
    """
    kind = frames.schema[frame].dataType.simpleString()
    wanted = set(site)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, lig, prot, res, box, width in zip(b["f"], b["l"], b["p"], b["r"], b["c"], b["w"]):
                x, y = _xyz(lig), _xyz(prot)
                raw, near = _distances(x, y), min_image_matrix(x, y, _xyz(box))
                hit = set(np.asarray(res)[(near <= radius).any(axis=0)].tolist())
                rows.append((f, int((raw <= radius).sum()), float(raw.min()), int((near <= radius).sum()), float(near.min()), len(hit), len(hit & wanted), radius > 0.5 * min(width)))
            yield pd.DataFrame(rows, columns=["frame", "raw_pairs", "raw_min", "mim_pairs", "mim_min", "mim_residues", "mim_site", "too_wide"])

    x = frames.select(F.col(frame).alias("f"), F.col(ligand).alias("l"), F.col(protein).alias("p"), F.col(residues).alias("r"), F.col(cell).alias("c"), perpendicular_widths(F.col(cell)).alias("w"))
    return x.mapInPandas(run, f"frame {kind}, raw_pairs long, raw_min double, mim_pairs long, mim_min double, mim_residues long, mim_site long, too_wide boolean")


def best_fit(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, shift) that bring ``moving`` closest to ``fixed``, by the largest eigenvector of the quaternion matrix."""
    p, q = moving - moving.mean(0), fixed - fixed.mean(0)
    m = p.T @ q
    k = np.zeros((4, 4))
    k[0, 0] = np.trace(m)
    k[0, 1:] = k[1:, 0] = [m[1, 2] - m[2, 1], m[2, 0] - m[0, 2], m[0, 1] - m[1, 0]]
    k[1:, 1:] = m + m.T - np.eye(3) * np.trace(m)
    w, x, y, z = np.linalg.eigh(k)[1][:, -1]
    r = np.array(
        [[1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)], [2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)], [2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)]]
    )
    return r, fixed.mean(0) - moving.mean(0) @ r


def _rmsd(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.sqrt(((x - y) ** 2).sum(axis=1).mean()))


def pose_metrics(frames: DataFrame, frame: str, core: str, ligand: str, protein: str, residues: str, reference: dict[str, np.ndarray], site: Sequence[int], radius: float = CONTACT, bins: Sequence[float] = (2.0, 2.5, 3.0)) -> DataFrame:
    """Per frame, after fitting its core on the reference: ``core_rmsd``, ``ligand_rmsd``, ``centroid`` shift, ``internal_rmsd`` (ligand fitted on itself),

    ``kept`` and ``kept_site`` (parts of the reference's contact residues), ``min_pair`` and ``pairs_below`` (counts per bin). ``reference`` has ``core``, ``ligand``, ``protein``."""
    kind = frames.schema[frame].dataType.simpleString()
    shared = frames.sparkSession.sparkContext.broadcast({k: np.asarray(v, float) for k, v in reference.items()})  # one structure
    wanted = set(site)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = shared.value
        near_ref = (_distances(ref["ligand"], ref["protein"]) <= radius).any(axis=0)
        for b in batches:
            rows = []
            for f, c, lig, prot, res in zip(b["f"], b["c"], b["l"], b["p"], b["r"]):
                c, lig, prot, res = _xyz(c), _xyz(lig), _xyz(prot), np.asarray(res)
                r, t = best_fit(c, ref["core"])
                moved = lig @ r + t
                d = _distances(moved, prot @ r + t)
                now, then = set(res[(d <= radius).any(axis=0)].tolist()), set(res[near_ref].tolist())
                part = lambda s: len(now & s) / len(s) if s else None
                ri, ti = best_fit(lig, ref["ligand"])
                rows.append(
                    (f, _rmsd(c @ r + t, ref["core"]), _rmsd(moved, ref["ligand"]), float(np.linalg.norm(moved.mean(0) - ref["ligand"].mean(0))), _rmsd(lig @ ri + ti, ref["ligand"]),
                     part(then), part(then & wanted), float(d.min()), [int((d < x).sum()) for x in bins])
                )
            yield pd.DataFrame(rows, columns=["frame", "core_rmsd", "ligand_rmsd", "centroid", "internal_rmsd", "kept", "kept_site", "min_pair", "pairs_below"])

    x = frames.select(F.col(frame).alias("f"), F.col(core).alias("c"), F.col(ligand).alias("l"), F.col(protein).alias("p"), F.col(residues).alias("r"))
    return x.mapInPandas(run, f"frame {kind}, core_rmsd double, ligand_rmsd double, centroid double, internal_rmsd double, kept double, kept_site double, min_pair double, pairs_below array<long>")


def imaging_check(frames: DataFrame, frame: str, raw_ligand: str, raw_protein: str, ligand: str, protein: str, residues: str, cell: str, radius: float = CONTACT) -> DataFrame:
    """Whether imaging kept a frame whole: ``flags``, ``lost`` and ``gained`` residues and ``state``.

    Protein and ligand may only be shifted, against each other by whole cells; the imaged complex must have the contacts
    and smallest distance of the periodic frame, stand at the nearest copy, fit into the narrowest width and not clash.
    ``state`` is GENUINELY_DETACHED without contacts, NEEDS_REVIEW with flags, else OK.
    """
    kind = frames.schema[frame].dataType.simpleString()

    def one(rl, rp, il, ip, res, m, widths) -> tuple:
        inverse, flags = np.linalg.inv(m), []
        shift = {}
        for name, a, b in (("protein", rp, ip), ("ligand", rl, il)):
            step = b - a
            shift[name] = step.mean(0)
            if np.abs(step - shift[name]).max() > DEFORMED:
                flags.append(f"{name}_deformed")
        cells = (shift["ligand"] - shift["protein"]) @ inverse
        if np.abs(cells - np.round(cells)).max() > CELL_STEP:
            flags.append("not_whole_cells")
        before, after = min_image_matrix(rl, rp, m), _distances(il, ip)
        was, now = (set(res[(d <= radius).any(axis=0)].tolist()) for d in (before, after))
        if was != now:
            flags.append("contacts_differ")
        if abs(before.min() - after.min()) > MIN_GAP:
            flags.append("distance_differs")
        apart = rl.mean(0) - rp.mean(0)
        apart = apart - np.round(apart @ inverse) @ m
        if np.linalg.norm(il.mean(0) - ip.mean(0) - apart) > NEAREST_COPY:
            flags.append("not_nearest_copy")
        if np.ptp(np.concatenate([il, ip]), axis=0).max() > min(widths):
            flags.append("wider_than_cell")
        if after.min() < CLASH:
            flags.append("clash")
        state = "GENUINELY_DETACHED" if not (before <= radius).any() else "NEEDS_REVIEW" if flags else "OK"
        return sorted(was - now), sorted(now - was), flags, state

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *one(_xyz(rl), _xyz(rp), _xyz(il), _xyz(ip), np.asarray(res), _xyz(m), w)) for f, rl, rp, il, ip, res, m, w in zip(*(b[c] for c in ("f", "rl", "rp", "il", "ip", "r", "c", "w")))]
            yield pd.DataFrame(rows, columns=["frame", "lost", "gained", "flags", "state"])

    names = {"f": frame, "rl": raw_ligand, "rp": raw_protein, "il": ligand, "ip": protein, "r": residues, "c": cell}
    x = frames.select(*[F.col(v).alias(k) for k, v in names.items()], perpendicular_widths(F.col(cell)).alias("w"))
    return x.mapInPandas(run, f"frame {kind}, lost array<long>, gained array<long>, flags array<string>, state string")


def residue_changes(before: Column, after: Column) -> Column:
    """STRUCT of the residues that are ``lost``, ``gained`` and ``kept`` between two arrays, each sorted."""
    s = lambda c: F.array_sort(F.array_distinct(c))
    return F.struct(s(F.array_except(before, after)).alias("lost"), s(F.array_except(after, before)).alias("gained"), s(F.array_intersect(before, after)).alias("kept"))


def schedule_deviation(log: DataFrame, schedule: DataFrame, step: str, columns: Sequence[str], tolerance: float) -> DataFrame:
    """``column``, ``deviation``, ``at_step``, ``ok``: where each logged column is farthest from what the schedule prescribes.

    Between the schedule's steps values are interpolated; of equal deviations the first step counts.
    """
    plan = schedule.select(F.col(step).alias("step__"), *[F.col(c).alias(f"{c}__") for c in columns])
    x = interpolate(log.select(F.col(step).alias("at__"), *columns), plan, "at__", "step__", [f"{c}__" for c in columns])
    pick = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(c) - F.col(f"{c}__")).alias("d")) for c in columns])).alias("x")
    worst = x.select("at__", pick).select("at__", "x.*").groupBy("column").agg(F.max("d").alias("deviation"), F.max_by("at__", F.struct("d", -F.col("at__"))).alias("at_step"))
    return worst.withColumn("ok", F.col("deviation") <= tolerance)


def preparation_check(seeds: DataFrame, seed: str, coords: str, bonds: str, cell: str, max_bond: float = 2.5) -> DataFrame:
    """``finite``, ``longest_bond``, ``coherent``, ``image_gap`` per prepared system.

    ``bonds`` holds pairs of 0-based atom numbers. ``image_gap`` is the smallest distance between the atoms and their copies in the 26 cells around.
    """
    kind = seeds.schema[seed].dataType.simpleString()
    around = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)], dtype=float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, v, pairs, box in zip(b["s"], b["x"], b["b"], b["c"]):
                x, m = _xyz(v), _xyz(box)
                if not (np.isfinite(x).all() and np.isfinite(m).all() and len(x)):
                    rows.append((s, False, None, False, None))
                    continue
                at = np.array([list(p) for p in pairs], dtype=int).reshape(-1, 2)
                bond = float(np.linalg.norm(x[at[:, 0]] - x[at[:, 1]], axis=1).max()) if len(at) else 0.0
                gap = min(float(_distances(x, x + t @ m).min()) for t in around)
                rows.append((s, True, bond, bond <= max_bond, gap))
            yield pd.DataFrame(rows, columns=["seed", "finite", "longest_bond", "coherent", "image_gap"])

    x = seeds.select(F.col(seed).alias("s"), F.col(coords).alias("x"), F.col(bonds).alias("b"), F.col(cell).alias("c"))
    return x.mapInPandas(run, f"seed {kind}, finite boolean, longest_bond double, coherent boolean, image_gap double")


def contact_seeds(rows: DataFrame, legs: Sequence[str], per_leg: int, strata: Sequence[str], wanted: str) -> DataFrame:
    """``leg``, ``seed`` of the stratum ``wanted``; raises unless each leg has ``per_leg`` distinct seeds, known strata and a finite ``wpd``."""
    from pairloom.operators.checks import require

    g = rows.groupBy("leg").agg(F.count("*").alias("n"), F.count_distinct("seed").alias("d"), F.min("seed").alias("lo"), F.max("seed").alias("hi"))
    want = rows.sparkSession.createDataFrame([(x,) for x in legs], "leg string")
    require(
        {
            "A leg is missing or unknown": want.exceptAll(g.select("leg")).unionAll(g.select("leg").exceptAll(want)),
            "Not the original seeds": g.filter((F.col("n") != per_leg) | (F.col("d") != per_leg) | (F.col("lo") != 1) | (F.col("hi") != per_leg)),
            "Unknown stratum": rows.filter(~F.coalesce(F.col("stratum").isin(*strata), F.lit(False))),
            "Missing coverage measurement": rows.filter(F.col("wpd").isNull() | F.isnan("wpd")),
        }
    )
    return rows.filter(F.col("stratum") == wanted).select("leg", "seed")
