"""Property-matched selection of top- and bottom-decile compounds, greedy within a protein."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.positions import grouped_positions
from pairloom.session import shuffle_partitions, written

WINDOWS = {"mw": 0.25, "logp": 1.5, "tpsa": 40.0}  # relative, absolute, absolute


def eligible(df: DataFrame) -> DataFrame:
    """One row per protein (``u``) and compound (``ck``): the best-scored, with ``pct``, its ascending percentile rank in the protein.

    ``df``: id, u, ck, lig, s, mw, logp, tpsa, y, o (flags of named roles, both must be 0).
    """
    from pairloom.operators.ranks import best_per_key, percentile_rank

    x = df.filter("y = 0 AND o = 0").dropna(subset=["u", "ck", "s", "mw", "logp", "tpsa"]).filter("mw BETWEEN 150 AND 750 AND u RLIKE '^[A-Z0-9]+$'")
    return percentile_rank(best_per_key(x, ["u", "ck"], F.col("s"), "id"), ["u"], F.col("s"))


def _greedy(d: pd.DataFrame) -> pd.DataFrame:
    top = d[d.pct >= 0.9].sort_values(["pct", "s", "id"], ascending=[False, False, True])
    low = d[(d.pct <= 0.1) & d.ok].sort_values("id")
    mw, logp, tpsa, score, ids, keys = (low[c].to_numpy() for c in ("mw", "logp", "tpsa", "s", "id", "ck"))
    q1, q2 = low.q1.to_numpy(), low.q2.to_numpy()
    free = np.ones(len(low), dtype=bool)
    out = []
    for n, r in enumerate(top.itertuples(index=False)):
        fit = np.zeros(0, dtype=int)
        if r.ok:
            dm, dl, dt = (mw - r.mw) / (WINDOWS["mw"] * r.mw), (logp - r.logp) / WINDOWS["logp"], (tpsa - r.tpsa) / WINDOWS["tpsa"]
            near = (abs(dm) <= 1) & (abs(dl) <= 1) & (abs(dt) <= 1)
            fit = np.flatnonzero(free & near & (score < r.s) & (q1 == r.q1) & (q2 == r.q2))
        if len(fit):
            dist = dm[fit] ** 2 + dl[fit] ** 2 + dt[fit] ** 2
            k = int(np.argmin(dist))  # the first of equal distances has the smallest id
            free &= (keys != keys[fit[k]]) & (keys != r.ck)
            out.append((r.u, n, r.id, ids[fit[k]], float(dist[k]), None))
        else:
            out.append((r.u, n, r.id, None, None, "no_match" if r.ok else "preparation"))
    return pd.DataFrame(out, columns=["u", "round", "candidate", "comparison", "distance", "reason"])


def matched_selection(df: DataFrame, prepared: DataFrame, count: int, per_protein: int) -> DataFrame:
    """``match``, ``u``, ``candidate``, ``comparison``, ``distance``: candidates of the top decile, each with its nearest
    unused bottom-decile compound of equal charges, lower score and similar properties.

    ``prepared``: lig, status, computed, q1, q2. The greedy step runs per protein on its two
    deciles after deduplication by compound; matches are then taken in the order of (round, protein), at
    most ``per_protein`` each and ``count`` in all.
    """
    d = eligible(df).filter("pct >= 0.9 OR pct <= 0.1").join(prepared, "lig", "left")
    d = d.withColumn("ok", F.coalesce((F.col("status") == "complete") & (F.col("computed") == F.col("ck")) & F.col("q1").isNotNull() & F.col("q2").isNotNull(), F.lit(False)))
    cols = d.select("u", "ck", "id", "s", "mw", "logp", "tpsa", "pct", "ok", F.coalesce("q1", F.lit(0)).alias("q1"), F.coalesce("q2", F.lit(0)).alias("q2"))
    tried = written(
        # a fixed number of partitions, else the few bytes are put into one task
        written(cols, "deciles").repartition(shuffle_partitions(df.sparkSession), "u").groupBy("u").applyInPandas(_greedy, "u string, round int, candidate string, comparison string, distance double, reason string"),
        "matches",
    )
    good = tried.filter("comparison IS NOT NULL")
    capped = grouped_positions(good, F.col("u"), [(F.col("round"), False)], carry={c: F.col(c) for c in ("candidate", "comparison", "distance")}, up_to=per_protein)
    out = grouped_positions(capped.withColumnRenamed("pos", "nth"), F.lit(1), [(F.col("o0"), False), (F.col("g"), False)], carry={c: F.col(c) for c in ("candidate", "comparison", "distance")}, up_to=count)
    return out.select(F.col("pos").alias("match"), F.col("o1").alias("u"), "candidate", "comparison", "distance")
