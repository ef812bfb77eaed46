"""Queries on repeated observations and likelihood-ratio scores (line items stand in for structural observations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import likelihood as L
from pairloom.operators import observations as O
from pairloom.operators import wide_ranks as W
from pairloom.operators.checks import require
from pairloom.plans.base import rounded
from pairloom.session import table, written

MEDIAN = {"D": "l_quantity", "MW": "l_extendedprice", "LP": "l_discount", "AR": "l_linenumber"}


def _obs(spark, d):
    l = table(spark, d, "lineitem")
    return l.select(
        F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b"), (F.col("l_orderkey") % 7).alias("pdb"), "l_quantity", "l_extendedprice", "l_discount", "l_linenumber",
        ((F.col("l_suppkey") + F.col("l_partkey") % 50) % 2).cast("int").alias("y"), (F.col("l_suppkey") % 5).cast("int").alias("fold"), "l_tax",
        F.array(F.col("l_linenumber"), (F.col("l_quantity") % 5).cast("int")).alias("res"),
    )


def _pairs(spark, d, means=None, checked=True):
    flags = {"no_residue_overlap": F.col("l_tax") >= 0, "compound_pass": F.col("l_discount") < 0.11, "known_role_pass": F.col("l_quantity") >= 1}
    return O.aggregate_observations(_obs(spark, d), ["a", "b"], "", "pdb", MEDIAN, ["y", "fold"], flags, means, checked)


def observation_pairs(spark, d):
    return rounded(_pairs(spark, d), "D", "MW", "LP", "AR")


def contact_consensus(spark, d):
    return rounded(O.contact_consensus(_obs(spark, d), ["a", "b"], "pdb", F.col("res")), "frequency")


def mean_of_source_means(spark, d):
    return rounded(O.mean_of_source_means(_obs(spark, d), ["a", "b"], "pdb", (F.col("l_quantity") >= 10).cast("double"), "fraction_ge10"), "fraction_ge10")


def quantile_report(spark, d):
    return rounded(O.quantile_report(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice"), "mean", "p10", "p25", "median", "p75", "p90", digits=6)


def site_summary(spark, d):
    return rounded(O.site_summary(_obs(spark, d), ["a", "b", "pdb"], ["a", "b"], "l_quantity"), "median", "rank")


def seed_grid_check(spark, d):
    return O.incomplete_grid(_obs(spark, d).select("a", "b", "pdb", "y"), ["a", "b"], {"pdb": 7})


def _fitted(spark, d):
    p = _pairs(spark, d).filter("feature_complete").withColumn("LP", F.round("LP", 9)).withColumn("MW", F.round("MW", 6))
    return written(p, "pairs")


def qnb_bins(spark, d):
    grid, llr = L.fit_qnb(written(L.training_long(_fitted(spark, d), "fold", "y", L.CODES), "training"))
    return rounded(llr, "llr")


def _scores(spark, d):
    p = _fitted(spark, d)
    return L.method_scores(p, p, "fold", "y", ["a", "b"])


def _some_scores(p, *methods):
    s = L.method_scores(p, p, "fold", "y", ["a", "b"], methods)
    return written(s.withColumn("score", F.round("score", 6)).withColumn("id", F.concat_ws(":", "a", "b")), "scores")


def oof_method_scores(spark, d):
    return rounded(_scores(spark, d), "score", digits=6)


def rank_candidates(spark, d):
    p = _pairs(spark, d, None, False)
    p = written(p.withColumn("LP", F.round("LP", 9)).withColumn("MW", F.round("MW", 6)), "pairs")
    require({"Inconsistent assignment": p.filter("NOT consistent")})
    names = [m for m, _ in L.methods()]
    rows = p.select(F.concat_ws(":", "a", "b").alias("id"), "a", "fold", *L.CODES).repartition("a").sortWithinPartitions("a")
    named = {f"s{i}": m for i, m in enumerate(names)}
    blocks = L.wide_scores(p.filter("feature_complete"), rows, "fold", "y", names, 6, L.fold_bin_models, (W.blocks_of("id", "a", named), W.BLOCKS))
    return W.block_ranks(blocks, "id", "a", {c: rows.schema[c].dataType.simpleString() for c in ("id", "a")}, named)


def review_funnel(spark, d):
    p = _pairs(spark, d, {"fraction_ge10": (F.col("l_quantity") >= 10).cast("double")}, False)
    p = written(p.withColumn("LP", F.round("LP", 9)).withColumn("MW", F.round("MW", 6)), "pairs")
    require({"Inconsistent assignment": p.filter("NOT consistent")})
    p = p.filter("feature_complete")
    s = L.wide_scores(p, p.drop("observations", "y", "consistent", "feature_complete"), "fold", "y", L.VIEWS).drop("MW", "LP", "AR", "fold")
    names = [f"s{i}" for i in range(len(L.VIEWS))]
    v = L.votes(s.withColumns({n: F.round(n, 6) for n in names}), ["a", "b"], "a", names, rows=p)
    v = v.filter("a IS NOT NULL AND b IS NOT NULL").withColumn("id", F.concat_ws(":", "a", "b")).withColumn("min_heavy_distance", F.col("D") / 3)
    return L.funnel_passes(v).select("id", "global_hit", "protein_hit", "spatial_pass", "role_pass", "agreement_pass", "repeated_pass")


QUERIES = {f.__name__: f for f in (observation_pairs, contact_consensus, mean_of_source_means, quantile_report, site_summary, seed_grid_check, qnb_bins, oof_method_scores, rank_candidates, review_funnel)}

OBS = """o AS (SELECT l_suppkey AS a, l_partkey % 50 AS b, l_orderkey % 7 AS pdb, l_quantity, l_extendedprice, l_discount, l_linenumber, l_tax,
  CAST((l_suppkey + l_partkey % 50) % 2 AS INT) AS y, CAST(l_suppkey % 5 AS INT) AS fold, list_distinct([l_linenumber, CAST(l_quantity % 5 AS INT)]) AS res FROM lineitem)"""
PAIRED = f"""{OBS}, s AS (SELECT a, b, pdb, count(*) AS n, median(l_quantity) AS "D", median(l_extendedprice) AS "MW", median(l_discount) AS "LP", median(CAST(l_linenumber AS DOUBLE)) AS "AR",
  min(y) AS y, min(fold) AS fold FROM o GROUP BY a, b, pdb),
p AS (SELECT a, b, CAST(sum(n) AS BIGINT) AS observations, count(*) AS sources, median("D") AS "D", median("MW") AS "MW", median("LP") AS "LP", median("AR") AS "AR", min(y) AS y, min(fold) AS fold FROM s GROUP BY a, b)"""
FIT = f"""{PAIRED}, z AS (SELECT a, b, sources, y, fold, "D", round("MW", 6) AS "MW", round("LP", 9) AS "LP", "AR" FROM p),
v AS (SELECT a, b, y, fold, unnest(['D', 'MW', 'LP', 'AR']) AS code, unnest(["D", "MW", "LP", "AR"]) AS x FROM z),
tr AS (SELECT f.fit, v.code, v.y, v.x FROM v JOIN (SELECT DISTINCT fold AS fit FROM z) f ON v.fold <> f.fit),
nb AS (SELECT fit, code, count(*) AS t, CAST(ceil(pow(count(*), 1.0 / 3.0) - 1e-12) AS INT) AS b FROM tr GROUP BY fit, code),
ed AS (SELECT tr.fit, tr.code, list_sort(list_distinct(quantile_cont(x, list_transform(range(1, min(b)), i -> i / CAST(1 AS DOUBLE))))) AS e FROM tr JOIN nb USING (fit, code) WHERE false GROUP BY tr.fit, tr.code)"""
# quantiles by interpolation between sorted values, since the number of bins differs by fit
EDGES = """so AS (SELECT fit, code, x, row_number() OVER (PARTITION BY fit, code ORDER BY x) - 1 AS i FROM tr WHERE code <> 'AR'),
wa AS (SELECT fit, code, (t - 1) * (i / CAST(b AS DOUBLE)) AS h FROM nb, LATERAL unnest(range(1, b)) u(i) WHERE code <> 'AR'),
eg AS (SELECT DISTINCT w.fit, w.code, lo.x + (hi.x - lo.x) * (w.h - floor(w.h)) AS e FROM wa w JOIN nb USING (fit, code) JOIN so lo ON lo.fit = w.fit AND lo.code = w.code AND lo.i = floor(w.h)
  JOIN so hi ON hi.fit = w.fit AND hi.code = w.code AND hi.i = least(floor(w.h) + 1, nb.t - 1)),
el AS (SELECT fit, code, list(e ORDER BY e) AS e FROM eg GROUP BY fit, code),
ca AS (SELECT fit, code, list_sort(list(DISTINCT x)) AS e FROM tr WHERE code = 'AR' GROUP BY fit, code),
gr AS (SELECT * FROM el UNION ALL SELECT * FROM ca),
bi AS (SELECT tr.fit, tr.code, CASE WHEN tr.code = 'AR' THEN list_position(e, x) - 1 ELSE len(list_filter(e, lambda q: q <= x)) END AS bin, y FROM tr JOIN gr USING (fit, code)),
bc AS (SELECT fit, code, bin, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM bi GROUP BY fit, code, bin),
bt AS (SELECT fit, code, sum(n0) AS t0, sum(n1) AS t1 FROM bc GROUP BY fit, code),
ev AS (SELECT fit, code, len(e) + 1 AS k, unnest(range(0, len(e) + 1)) AS bin FROM gr),
lr AS (SELECT fit, code, CAST(bin AS INT) AS bin, ln(((coalesce(n1, 0) + 0.5) / (t1 + 0.5 * k)) / ((coalesce(n0, 0) + 0.5) / (t0 + 0.5 * k))) AS llr FROM ev LEFT JOIN bc USING (fit, code, bin) JOIN bt USING (fit, code))"""
FIT = FIT[: FIT.index(",\ned AS")]
SCORE = f"""{FIT}, {EDGES}, dx AS (SELECT DISTINCT fold AS fit, code, x FROM v),
qc AS (SELECT dx.fit, dx.code, dx.x, lr.llr FROM dx JOIN gr USING (fit, code) JOIN lr ON lr.fit = dx.fit AND lr.code = dx.code
  AND lr.bin = CASE WHEN dx.code = 'AR' THEN coalesce(nullif(list_position(e, dx.x), 0) - 1, len(e)) ELSE len(list_filter(e, lambda q: q <= dx.x)) END),
ms AS (SELECT fit, code, y, count(*) AS m, stddev_samp(x) * pow(count(*), -0.2) AS h FROM tr WHERE code <> 'AR' GROUP BY fit, code, y),
sp AS (SELECT fit, code, min(x) AS lo, max(x) AS hi FROM tr GROUP BY fit, code),
cl AS (SELECT fit, code, x, greatest(lo, least(hi, x)) AS w FROM dx JOIN sp USING (fit, code) WHERE code <> 'AR'),
tw AS (SELECT fit, code, y, x, count(*) AS n FROM tr WHERE code <> 'AR' GROUP BY fit, code, y, x),
de AS (SELECT cl.fit, cl.code, cl.x, tw.y, sum(n * exp(-0.5 * pow((cl.w - tw.x) / h, 2))) / (min(m) * min(h) * sqrt(2 * pi())) AS d FROM cl JOIN tw ON tw.fit = cl.fit AND tw.code = cl.code
  JOIN ms ON ms.fit = tw.fit AND ms.code = tw.code AND ms.y = tw.y GROUP BY cl.fit, cl.code, cl.x, tw.y),
kc AS (SELECT fit, code, x, ln((max(CASE WHEN y = 1 THEN d END) + 1e-12) / (max(CASE WHEN y = 0 THEN d END) + 1e-12)) AS llr FROM de GROUP BY fit, code, x
  UNION ALL SELECT fit, code, x, llr FROM qc WHERE code = 'AR'),
wd AS (SELECT z.*, {", ".join(f'q{c}.llr AS q_{c}, k{c}.llr AS k_{c}' for c in L.CODES)} FROM z {" ".join(f"JOIN qc q{c} ON q{c}.fit = z.fold AND q{c}.code = '{c}' AND q{c}.x = z.{chr(34)}{c}{chr(34)} JOIN kc k{c} ON k{c}.fit = z.fold AND k{c}.code = '{c}' AND k{c}.x = z.{chr(34)}{c}{chr(34)}" for c in L.CODES)})"""


def _expr(name: str, codes: tuple[str, ...]) -> str:
    est = name.split(":")[0]
    if est == "RAW":
        return '"D"'
    return " + ".join(f"q_{c}" if est == "QNB" else f"greatest(-{L.CAPS[est][c]!r}, least({L.CAPS[est][c]!r}, k_{c}))" for c in codes)


LONG = f"{SCORE}, sc AS (" + " UNION ALL ".join(f"SELECT a, b, sources, '{n}' AS method, round({_expr(n, s)}, 6) AS score FROM wd" for n, s in L.methods()) + ")"
RANKED = """rk AS (SELECT a, b, method, score, rank() OVER (PARTITION BY method ORDER BY score DESC) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS gr, count(*) OVER (PARTITION BY method) AS gn,
  rank() OVER (PARTITION BY method, a ORDER BY score DESC) + (count(*) OVER (PARTITION BY method, a, score) - 1) / 2.0 AS wr, count(*) OVER (PARTITION BY method, a) AS wn FROM sc)"""

SQL = {
    "observation_pairs": f"WITH {PAIRED} SELECT a, b, observations, sources, round(\"D\", 9) AS \"D\", round(\"MW\", 9) AS \"MW\", round(\"LP\", 9) AS \"LP\", round(\"AR\", 9) AS \"AR\", y, fold, true AS no_residue_overlap, true AS compound_pass, true AS known_role_pass, true AS feature_complete FROM p",
    "contact_consensus": f"""WITH {OBS}, n AS (SELECT a, b, pdb, count(*) AS n FROM o GROUP BY a, b, pdb), k AS (SELECT a, b, count(*) AS k, list_reduce(list(n), lambda x, w: lcm(x, w)) AS l FROM n GROUP BY a, b),
c AS (SELECT a, b, pdb, r, count(*) AS c FROM (SELECT a, b, pdb, unnest(res) AS r FROM o) GROUP BY a, b, pdb, r)
SELECT a, b, r AS residue, round(sum(c / CAST(n AS DOUBLE)) / min(k), 9) AS frequency, 5 * sum(c * (l // n)) >= 3 * min(k) * min(l) AS kept FROM c JOIN n USING (a, b, pdb) JOIN k USING (a, b) GROUP BY a, b, r""",
    "mean_of_source_means": f"WITH {OBS} SELECT a, b, round(avg(m), 9) AS fraction_ge10 FROM (SELECT a, b, pdb, avg(CAST(l_quantity >= 10 AS INT)) AS m FROM o GROUP BY a, b, pdb) GROUP BY a, b",
    "quantile_report": "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, min(l_extendedprice) AS min, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {n}" for q, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90"))) + ", max(l_extendedprice) AS max FROM lineitem GROUP BY l_returnflag",
    "site_summary": f"WITH {OBS}, g AS (SELECT a, b, pdb, count(*) AS n, median(l_quantity) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi FROM o GROUP BY a, b, pdb) SELECT a, b, pdb, n, round(m, 9) AS median, lo AS min, hi AS max, round(rank() OVER (PARTITION BY a, b ORDER BY m) + (count(*) OVER (PARTITION BY a, b, m) - 1) / 2.0, 9) AS rank FROM g",
    "seed_grid_check": f"WITH {OBS} SELECT a, b, count(*) AS rows, count(DISTINCT pdb) AS n_pdb FROM o GROUP BY a, b HAVING count(*) <> 7 OR count(DISTINCT pdb) <> 7",
    "qnb_bins": f"WITH {FIT}, {EDGES} SELECT fit, code, bin, round(llr, 9) AS llr FROM lr",
    "oof_method_scores": f"WITH {LONG} SELECT a, b, method, score FROM sc",
    "rank_candidates": f"WITH {LONG}, {RANKED} SELECT a || ':' || b AS id, a, method, score, round(gr, 9) AS global_rank, round((gr - 0.5) / gn, 9) AS global_fraction, round(wr, 9) AS within_rank, round((wr - 0.5) / wn, 9) AS within_fraction FROM rk",
    "review_funnel": f"""WITH {LONG}, {RANKED}, vo AS (SELECT a, b, CAST(count(*) FILTER (WHERE (gr - 0.5) / gn <= 0.1) AS BIGINT) AS g, CAST(count(*) FILTER (WHERE (wr - 0.5) / wn <= 0.1) AS BIGINT) AS w FROM rk WHERE method IN {L.VIEWS} GROUP BY a, b),
fr AS (SELECT a, b, avg(m) AS f FROM (SELECT a, b, pdb, avg(CAST(l_quantity >= 10 AS INT)) AS m FROM o GROUP BY a, b, pdb) GROUP BY a, b),
x AS (SELECT a, b, g, w, f, sources, "D" >= 10 AND "D" / 3 >= 6 AS s FROM z JOIN vo USING (a, b) JOIN fr USING (a, b))
SELECT a || ':' || b AS id, g AS global_hit, w AS protein_hit, s AS spatial_pass, s AS role_pass, s AND g >= 2 AND w >= 3 AS agreement_pass, s AND g >= 2 AND w >= 3 AND sources >= 2 AND f >= 0.75 AS repeated_pass FROM x""",
}
