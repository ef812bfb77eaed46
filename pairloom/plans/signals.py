"""Queries on resampling, attention vectors, geometry, time series and matched selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairloom.operators import geometry as G
from pairloom.operators import match, observations, vectors
from pairloom.operators import resample as R
from pairloom.operators import series as T
from pairloom.operators.keys import clean_key
from pairloom.plans.base import PAIRS, SCORED, pairs, rounded, scored
from pairloom.session import table

DRAWS = 10_000
MATCH = ("u", "ck", "lig", "s", "mw", "logp", "tpsa", "y", "o")


# --- resampling -------------------------------------------------------------------------------


def _paired(spark, d):
    """Suppliers by nation and order status: two roles per supplier, success by mean discount."""
    l = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey")
    g = l.filter("l_linestatus IN ('O', 'F')").groupBy("nation", F.col("l_suppkey").alias("unit"), F.when(F.col("l_linestatus") == "O", "candidate").otherwise("comparison").alias("role")).agg(
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*") >= 5).cast("int").alias("success")
    )
    both = g.groupBy("unit").agg(F.count("*").alias("n")).filter("n = 2").select("unit")
    return R.paired_roles(g.join(both, "unit"), ["nation", "unit"], "role", "success")


def paired_units(spark, d):
    return _paired(spark, d)


def discordance_counts(spark, d):
    return R.discordance(_paired(spark, d), ["nation"])


def sign_flip_exact(spark, d):
    x = _paired(spark, d).withColumn("block", F.col("nation") % 5)
    return rounded(R.sign_flip(x, "block", "delta"), "delta", "p")


def sign_flip_drawn(spark, d):
    return rounded(R.sign_flip(_paired(spark, d), "nation", "delta"), "delta", "p")


def holm_adjust(spark, d):
    p = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey"), (F.abs(F.col("s_acctbal")) / 20000).alias("p"))
    return rounded(R.holm(p, ["s_nationkey"], "p", "s_suppkey"), "p", "holm_p")


def wilcoxon_signed_rank(spark, d):
    l = table(spark, d, "lineitem").select("l_returnflag", (F.round(F.col("l_discount") * 100) - F.round(F.col("l_tax") * 100)).alias("v"))
    return rounded(R.wilcoxon(l, ["l_returnflag"], "v"), "p")


def bootstrap_ratio(spark, d):
    p = pairs(spark, d, "fam", "y").withColumn("one", F.lit(1))
    return rounded(R.bootstrap_ratio(p, "fam", "y", "one", DRAWS), "estimate", "ci_low", "ci_high")


def cluster_pair_matrix(spark, d):
    x = scored(spark, d, "u", "y", "s").withColumn("c", F.pmod(F.length("u") + F.ascii("u"), F.lit(7)).cast("int"))
    return R.cluster_pair_matrix(x, "c", "y", "s")


def paired_bootstrap(spark, d):
    x = scored(spark, d, "u", "y", "s", "logp").withColumn("c", F.pmod(F.length("u") + F.ascii("u"), F.lit(7)).cast("int")).filter("logp IS NOT NULL")
    return rounded(R.bootstrap_auroc_difference(x, "c", "y", "s", "logp", DRAWS), "delta", "ci_low", "ci_high")


# --- vectors ----------------------------------------------------------------------------------


def _attention(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")), 4)).alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", "label", F.transform("a", lambda x: x / total).alias("a"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i + F.col("label")) % 5 == 0).alias("m"))


def attention_metrics(spark, d):
    return rounded(vectors.attention_metrics(_attention(spark, d), "vec_id", "a", "m"), *vectors.METRICS, digits=7)


def masked_means(spark, d):
    e = table(spark, d, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    mask = F.transform("v", lambda x: x["vec_id"] % 3 == 0)
    out = vectors.masked_mean(F.col("v.embedding"), mask)
    return e.select("label", F.posexplode(out).alias("place", "mean")).select("label", "place", F.round("mean", 6).alias("mean"))


def masked_maxima(spark, d):
    e = table(spark, d, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    out = vectors.masked_max(F.col("v.embedding"), F.transform("v", lambda x: x["vec_id"] % 3 == 0))
    return e.select("label", F.posexplode(out).alias("place", "top")).select("label", "place", F.round("top", 6).alias("top"))


def ligand_specificity(spark, d):
    x = _attention(spark, d).withColumn("g", (F.col("vec_id") / 10).cast("int"))
    return rounded(vectors.own_and_other(x, "g", "vec_id", "a", "m"), "mine", "other", "log_ratio", digits=7)


def map_similarity(spark, d):
    x = _attention(spark, d).withColumn("g", (F.col("vec_id") / 10).cast("int"))
    return rounded(vectors.map_similarity(x, "g", "vec_id", "a"), "median_rho", digits=7)


def network_scores(spark, d):
    rng = np.random.default_rng(7)
    w = {"w1": rng.normal(size=(256, 8)) / 16, "b1": np.zeros(8), "w2": rng.normal(size=8), "b2": 0.0}
    # all vectors of a label: those with an even id on the left, the others on the right
    side = lambda k: F.array_sort(F.collect_list(F.when(F.pmod("vec_id", F.lit(2)) == k, F.struct("vec_id", "embedding"))))
    e = table(spark, d, "embeddings").groupBy("label").agg(side(0).alias("l"), side(1).alias("r"))
    x = e.select("label", *(F.when(F.size(c) > 0, F.col(c)["embedding"]).alias(c) for c in ("l", "r")))
    return rounded(vectors.predict(x, "label", "l", "r", w, "both_ways"), "score", digits=6)


# --- geometry ---------------------------------------------------------------------------------


def _points(spark, d, rule: str):
    e = table(spark, d, "embeddings").filter(rule)
    c = lambda i: F.round(F.col("embedding")[i].cast("double") * 10, 3)
    return e.select("label", "vec_id", c(0).alias("x"), c(1).alias("y"), c(2).alias("z"))


def _sides(spark, d):
    a = _points(spark, d, "vec_id % 3 = 0").withColumnRenamed("vec_id", "a")
    return a, _points(spark, d, "vec_id % 3 > 0").withColumnRenamed("vec_id", "b")


def radius_contacts(spark, d):
    return rounded(G.within_radius(*_sides(spark, d), ["label"], 4.0), "distance")


def nearest_distance(spark, d):
    a, b = _sides(spark, d)
    return rounded(G.nearest(a, b, ["label"], ["label", "a"]), "min_distance")


def min_image_distance(spark, d):
    a, b = _sides(spark, d)
    j = a.select("label", "a", F.struct("x", "y", "z").alias("p")).join(b.select("label", "b", F.struct("x", "y", "z").alias("q")), "label")
    return rounded(j.select("a", "b", G.min_image_distance("p", "q", (6.0, 7.0, 8.0)).alias("distance")), "distance")


def box_coverage(spark, d):
    a, _ = _sides(spark, d)
    s = a.withColumn("site", F.col("a") % 5).drop("a")
    boxes = spark.createDataFrame([(i, b, *[float(b - 1)] * 3, *[20.0 + 4 * b] * 3) for i in range(8) for b in range(3)], "label int, box int, cx double, cy double, cz double, sx double, sy double, sz double")
    return rounded(G.box_coverage(s, boxes, ["label"], "site", "box"), "inside")


def pose_classification(spark, d):
    a, b = _sides(spark, d)
    poses = a.withColumn("pose", F.col("a") % 7).drop("a")
    rec = b.filter("b % 3 = 1").withColumn("res", F.col("b") % 20).drop("b")
    prim = b.filter("b % 3 = 2 AND b % 4 = 0").drop("b")
    return rounded(G.classify_poses(poses, rec, prim, ["label"], "pose", "res", 4.0, 0.5, 1.0), "min_receptor", "min_primary")


def clash_counts(spark, d):
    a, _ = _sides(spark, d)
    return G.clashes(a.withColumn("res", F.col("a") % 20), ["label"], "res", "a", 5.0)


def medoid(spark, d):
    a, _ = _sides(spark, d)
    return observations.medoid(a, ["label"], "a", G.XYZ, 6.0)


def repeated_support(spark, d):
    a, _ = _sides(spark, d)
    x = a.withColumn("box", F.col("a") % 2).withColumn("scoring", F.when(F.col("a") % 4 < 2, "one").otherwise("two"))
    return observations.repeated_support(x, ["label", "box"], "scoring", "a", G.XYZ, 3, 5.0)


# the same over all points of the table; the queries above keep the rows that their SQL names


def _all_points(spark, d):
    return _points(spark, d, "true").withColumnRenamed("vec_id", "a")


def box_coverage_all(spark, d):
    """Boxes for every label that is present."""
    s = _all_points(spark, d).withColumn("site", F.col("a") % 5).drop("a")
    boxes = spark.createDataFrame([(b, *[float(b - 1)] * 3, *[20.0 + 4 * b] * 3) for b in range(3)], "box int, cx double, cy double, cz double, sx double, sy double, sz double")
    return rounded(G.box_coverage(s, s.select("label").distinct().crossJoin(F.broadcast(boxes)), ["label"], "site", "box"), "inside")


def pose_classification_all(spark, d):
    """Three roles that together cover all points: poses, receptor and primary reference."""
    a, b = _sides(spark, d)
    poses = a.withColumn("pose", F.col("a") % 7).drop("a")
    rec = b.filter("b % 3 = 1").withColumn("res", F.col("b") % 20).drop("b")
    prim = b.filter("b % 3 = 2").drop("b")
    return rounded(G.classify_poses(poses, rec, prim, ["label"], "pose", "res", 4.0, 0.5, 1.0), "min_receptor", "min_primary")


def clash_counts_all(spark, d):
    return G.clashes(_all_points(spark, d).withColumn("res", F.col("a") % 20), ["label"], "res", "a", 5.0)


def medoid_all(spark, d):
    return observations.medoid(_all_points(spark, d), ["label"], "a", G.XYZ, 6.0)


def repeated_support_all(spark, d):
    x = _all_points(spark, d).withColumn("box", F.col("a") % 2).withColumn("scoring", F.when(F.col("a") % 4 < 2, "one").otherwise("two"))
    return observations.repeated_support(x, ["label", "box"], "scoring", "a", G.XYZ, 3, 5.0)


def kabsch_rmsd(spark, d):
    e = table(spark, d, "embeddings")
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.slice("embedding", i * 3 + a, F.lit(3)))
    return rounded(G.kabsch_rmsd(e.select("vec_id", cut(1).alias("p"), cut(31).alias("q")), "vec_id", "p", "q"), "rmsd", digits=6)


# --- series -----------------------------------------------------------------------------------


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("t"), F.col("value").alias("v"))


def time_gaps(spark, d):
    return T.gaps(_events(spark, d), ["user_id"], "t", 6e10)


def span_gap(spark, d):
    return rounded(T.span_gap(_events(spark, d), ["user_id"], "v"), "median", "span", "largest_gap")


def histogram12(spark, d):
    return T.histogram(_events(spark, d), ["user_id"], "v", 0.0, 100.0)


def zero_runs(spark, d):
    x = _events(spark, d).withColumn("z", F.when(F.col("v") < 20, 0).otherwise(1))
    return T.zero_runs(x, ["user_id"], "t", "z", 3e10)


def stitch_segments(spark, d):
    e = _events(spark, d).withColumn("seg", F.col("user_id") % 10).withColumn("local_t", (F.col("event_id") % 1000) / 10.0)
    seg = spark.createDataFrame([(i, i * 900, i * 900 + 1000, i * 900 + 950 if i % 2 else None) for i in range(10)], "seg long, start_step long, end_step long, valid_to_step long")
    rows = e.groupBy("seg", "local_t").agg(F.min("v").alias("v"))
    return rounded(T.stitch(seg, rows, "seg", 0.1), "t", digits=4)


def schedule_interpolation(spark, d):
    s = spark.createDataFrame([(0, 1.0, 0.0), (3000, 2.0, 10.0), (7000, 0.5, 20.0)], "step int, a double, k double")
    return rounded(T.interpolate(_events(spark, d).select("event_id"), s, "event_id", "step", ["a", "k"]), "a", "k")


def evenly_spaced(spark, d):
    return T.evenly_spaced(_events(spark, d).select("event_id", "v"), "event_id", 100)


def contact_strata(spark, d):
    x = _events(spark, d).select("user_id", T.stratum((F.col("v") > 20).cast("int"), (F.col("v") > 50).cast("int")).alias("stratum"))
    return x.groupBy("user_id", "stratum").agg(F.count("*").alias("n"))


# --- matched selection ------------------------------------------------------------------------


def _prepared(spark, d):
    return table(spark, d, "prepared_compounds").select(
        F.col("ligand_chembl_id").alias("lig"), F.lower(F.trim("status")).alias("status"), F.col("computed_connectivity").alias("computed"), F.col("source_formal_charge").alias("q1"), F.col("ph74_formal_charge").alias("q2")
    )


def matched_selection(spark, d):
    return rounded(match.matched_selection(scored(spark, d, *MATCH), _prepared(spark, d), 500, 5), "distance")


def match_population(spark, d):
    return rounded(match.eligible(scored(spark, d, *MATCH)).select("u", "ck", "id", "pct"), "pct")


QUERIES = {
    f.__name__: f
    for f in (
        paired_units, discordance_counts, sign_flip_exact, sign_flip_drawn, holm_adjust, wilcoxon_signed_rank, bootstrap_ratio, cluster_pair_matrix, paired_bootstrap,
        attention_metrics, masked_means, masked_maxima, ligand_specificity, map_similarity, network_scores, radius_contacts, nearest_distance, min_image_distance, box_coverage,
        pose_classification, clash_counts, medoid, repeated_support, box_coverage_all, pose_classification_all, clash_counts_all, medoid_all, repeated_support_all, kabsch_rmsd, time_gaps, span_gap, histogram12, zero_runs, stitch_segments, schedule_interpolation,
        evenly_spaced, contact_strata, matched_selection, match_population,
    )
}

ROLES = """g AS (SELECT s_nationkey AS nation, l_suppkey AS unit, l_linestatus AS r, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) >= 5 AS INT) AS s
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus IN ('O', 'F') GROUP BY ALL),
u AS (SELECT nation, unit, CAST(max(s) FILTER (WHERE r = 'O') AS DOUBLE) AS candidate, CAST(max(s) FILTER (WHERE r = 'F') AS DOUBLE) AS comparison FROM g GROUP BY nation, unit HAVING count(*) = 2)"""
ATT = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(abs(CAST(x AS DOUBLE)), 4)) AS w FROM embeddings),
a AS (SELECT vec_id, label, list_transform(w, lambda x: x / list_sum(w)) AS a, list_transform(range(0, 64), lambda i: (i + label) % 5 = 0) AS m, vec_id // 10 AS g FROM e)"""
PTS = """pt AS (SELECT label, vec_id, round(CAST(embedding[1] AS DOUBLE) * 10, 3) AS x, round(CAST(embedding[2] AS DOUBLE) * 10, 3) AS y, round(CAST(embedding[3] AS DOUBLE) * 10, 3) AS z FROM embeddings),
a AS (SELECT label, vec_id AS a, x, y, z FROM pt WHERE vec_id % 3 = 0), b AS (SELECT label, vec_id AS b, x, y, z FROM pt WHERE vec_id % 3 > 0)"""
D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
EV = "ev AS (SELECT user_id, event_id, epoch_us(ts) AS t, value AS v FROM events)"


def _box(c: str, s: int) -> str:
    q = f"(a.{c} - b.{c})"
    return f"pow({q} - {s} * floor({q} / {s}.0 + 0.5), 2)"


SQL = {
    "paired_units": f"WITH {ROLES} SELECT nation, unit, candidate, comparison, candidate - comparison AS delta FROM u",
    "discordance_counts": f"WITH {ROLES} SELECT nation, CAST(sum(CAST(candidate = 1 AND comparison = 0 AS INT)) AS BIGINT) AS candidate_only, CAST(sum(CAST(candidate = 0 AND comparison = 1 AS INT)) AS BIGINT) AS comparison_only, CAST(sum(CAST(candidate = 1 AND comparison = 1 AS INT)) AS BIGINT) AS \"both\", CAST(sum(CAST(candidate = 0 AND comparison = 0 AS INT)) AS BIGINT) AS neither FROM u GROUP BY nation",
    "sign_flip_exact": f"""WITH {ROLES}, s AS (SELECT nation % 5 AS k, sum(candidate - comparison) AS s, count(*) AS n FROM u GROUP BY 1), o AS (SELECT s, row_number() OVER (ORDER BY k) - 1 AS i FROM s),
t AS (SELECT sum(n) AS n, count(*) AS c, sum(s) / sum(n) AS d FROM s), f AS (SELECT v, sum(CASE WHEN (v >> i) & 1 = 1 THEN s ELSE -s END) / (SELECT n FROM t) AS z FROM o, LATERAL range(0, CAST(1 << (SELECT c FROM t) AS BIGINT)) r(v) GROUP BY v)
SELECT CAST(n AS BIGINT) AS n, c AS clusters, round(d, 9) AS delta, round((SELECT avg(CAST(abs(z) >= abs(d) - 1e-12 AS INT)) FROM f), 9) AS p, 'exact' AS method FROM t""",
    "wilcoxon_signed_rank": """WITH x AS (SELECT l_returnflag AS g, round(l_discount * 100) - round(l_tax * 100) AS v FROM lineitem), y AS (SELECT g, v, abs(v) AS a FROM x WHERE v <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0 AS k FROM y), t AS (SELECT g, sum(c * c * c - c) AS ties FROM (SELECT g, a, CAST(count(*) AS DOUBLE) AS c FROM y GROUP BY g, a) GROUP BY g),
w AS (SELECT g, count(*) AS n, sum(k) FILTER (WHERE v > 0) AS w_plus FROM r GROUP BY g), z AS (SELECT g, n, w_plus, abs(w_plus - n * (n + 1) / 4.0) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(2) AS x FROM w JOIN t USING (g)),
q AS (SELECT *, 1 / (1 + x / 2) AS t FROM z)
SELECT g AS l_returnflag, n, w_plus, round(t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))), 9) AS p FROM q""",
    "holm_adjust": """WITH p AS (SELECT s_nationkey, s_suppkey, abs(s_acctbal) / 20000 AS p FROM supplier), r AS (SELECT *, p * (count(*) OVER (PARTITION BY s_nationkey) - row_number() OVER w + 1) AS s FROM p WINDOW w AS (PARTITION BY s_nationkey ORDER BY p, s_suppkey))
SELECT s_nationkey, s_suppkey, round(p, 9) AS p, round(least(1, max(s) OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey ROWS UNBOUNDED PRECEDING)), 9) AS holm_p FROM r""",
    "cluster_pair_matrix": f"""WITH {SCORED}, x AS (SELECT (length(u) + ascii(u)) % 7 AS c, s, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1 - y) AS BIGINT) AS n FROM r GROUP BY 1, 2),
k AS (SELECT DISTINCT c FROM x), q AS (SELECT s, k.c, CAST(coalesce(x.n, 0) AS DOUBLE) AS n FROM (SELECT DISTINCT s FROM x) CROSS JOIN k LEFT JOIN x USING (s, c)),
w AS (SELECT s, c, n, sum(n) OVER (PARTITION BY c ORDER BY s) AS cn FROM q)
SELECT CAST(x.c AS INT) AS pos, CAST(w.c AS INT) AS neg, sum(x.p * (w.cn - w.n / 2)) AS wins FROM x JOIN w ON w.s = x.s WHERE x.p > 0 GROUP BY 1, 2 HAVING sum(x.p * (w.cn - w.n / 2)) > 0""",
    "attention_metrics": f"""WITH {ATT}, x AS (SELECT vec_id, unnest(a) AS a, unnest(m) AS m, unnest(range(0, 64)) AS i FROM a),
r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY a) + (count(*) OVER (PARTITION BY vec_id, a) - 1) / 2.0 AS rk, sum(CAST(m AS INT)) OVER (PARTITION BY vec_id ORDER BY a DESC) AS tp, count(*) OVER (PARTITION BY vec_id ORDER BY a DESC) AS cn,
  rank() OVER (PARTITION BY vec_id ORDER BY a DESC) AS r1, count(*) OVER (PARTITION BY vec_id, a) AS pe, count(*) FILTER (WHERE m) OVER (PARTITION BY vec_id) AS q FROM x),
g AS (SELECT vec_id, count(*) AS n, min(q) AS k, sum(a) FILTER (WHERE m) AS s, sum(rk) FILTER (WHERE m) AS rs, sum(tp / cn) FILTER (WHERE m) / min(q) AS ap, -sum(a * ln(greatest(a, 1e-300))) / ln(64) AS en,
  sum(greatest(0, least(1, (4 - (r1 - 1)) / CAST(pe AS DOUBLE)))) FILTER (WHERE m) AS t5, sum(greatest(0, least(1, (7 - (r1 - 1)) / CAST(pe AS DOUBLE)))) FILTER (WHERE m) AS t10 FROM r GROUP BY vec_id),
sh AS (SELECT vec_id, k, sum(a) AS v FROM (SELECT b.vec_id, s.k, b.a[(i + s.k) % 64 + 1] AS a, b.m[i + 1] AS m FROM a b, range(0, 64) s(k), range(0, 64) j(i)) WHERE m GROUP BY vec_id, k),
sp AS (SELECT sh.vec_id, avg(CAST(v >= s - 1e-10 AS INT)) AS p FROM sh JOIN g USING (vec_id) GROUP BY sh.vec_id)
SELECT vec_id, n, k AS n_site, 'evaluated' AS status, round(s, 7) AS proportion, round(s / (k / 64.0), 7) AS enrichment, round((rs - k * (k + 1) / 2.0) / (k * (64.0 - k)), 7) AS auroc, round(ap, 7) AS auprc, round(p, 7) AS shift_p, round(en, 7) AS entropy,
  round(t5 / 4.0, 7) AS top5_precision, round(t5 / k, 7) AS top5_recall, round(t10 / 7.0, 7) AS top10_precision, round(t10 / k, 7) AS top10_recall FROM g JOIN sp USING (vec_id)""",
    "masked_means": "SELECT label, CAST(i AS INT) AS place, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings WHERE vec_id % 3 = 0) GROUP BY label, i",
    "masked_maxima": "SELECT label, CAST(i AS INT) AS place, round(max(CAST(v AS DOUBLE)), 6) AS top FROM (SELECT label, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings WHERE vec_id % 3 = 0) GROUP BY label, i",
    "ligand_specificity": f"""WITH {ATT}, x AS (SELECT vec_id, g, m, unnest(a) AS v, unnest(range(0, 64)) AS i FROM a), o AS (SELECT p.g, p.vec_id, q.vec_id AS w, sum(q.v) AS s FROM a p JOIN x q ON q.g = p.g AND p.m[q.i + 1] AND (q.vec_id = p.vec_id OR q.m <> p.m) GROUP BY ALL),
k AS (SELECT g, vec_id, count(*) FILTER (WHERE w <> vec_id) AS n, sum(s) FILTER (WHERE w = vec_id) AS mine, avg(s) FILTER (WHERE w <> vec_id) AS other FROM o GROUP BY g, vec_id)
SELECT CAST(g AS INT) AS g, vec_id, CAST(n AS INT) AS others, round(mine, 7) AS mine, round(other, 7) AS other, round(ln(mine / other), 7) AS log_ratio FROM k WHERE n > 0""",
    "map_similarity": f"""WITH {ATT}, x AS (SELECT vec_id, g, unnest(a) AS v, unnest(range(0, 64)) AS i FROM a), r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY v) + (count(*) OVER (PARTITION BY vec_id, v) - 1) / 2.0 AS k FROM x),
c AS (SELECT p.g, p.vec_id, q.vec_id AS w, corr(p.k, q.k) AS c FROM r p JOIN r q ON p.g = q.g AND p.i = q.i AND p.vec_id < q.vec_id GROUP BY ALL) SELECT CAST(g AS INT) AS g, count(*) AS pairs, round(median(c), 7) AS median_rho FROM c GROUP BY g""",
    "radius_contacts": f"WITH {PTS} SELECT a.label, a, b, round(sqrt({D2}), 9) AS distance FROM a JOIN b ON a.label = b.label WHERE {D2} <= 16",
    "nearest_distance": f"WITH {PTS} SELECT a.label, a, round(sqrt(min({D2})), 9) AS min_distance FROM a JOIN b ON a.label = b.label GROUP BY a.label, a",
    "min_image_distance": f"WITH {PTS} SELECT a, b, round(sqrt({_box('x', 6)} + {_box('y', 7)} + {_box('z', 8)}), 9) AS distance FROM a JOIN b ON a.label = b.label",
    "box_coverage": f"""WITH {PTS}, k AS (SELECT a % 5 AS site, * FROM a), bx AS (SELECT box, box - 1.0 AS c, (20 + 4 * box) / 2.0 AS h FROM range(0, 3) t(box)),
j AS (SELECT label, site, CAST(box AS INT) AS box, c, h, x, y, z FROM k, bx WHERE label < 8)
SELECT label, site, box, round(avg(CAST(abs(x - c) <= h AND abs(y - c) <= h AND abs(z - c) <= h AS INT)), 9) AS inside, abs(avg(x) - min(c)) <= min(h) AND abs(avg(y) - min(c)) <= min(h) AND abs(avg(z) - min(c)) <= min(h) AS centroid_inside,
  abs(avg(x) - min(c)) <= min(h) AND abs(avg(y) - min(c)) <= min(h) AND abs(avg(z) - min(c)) <= min(h) AND avg(CAST(abs(x - c) <= h AND abs(y - c) <= h AND abs(z - c) <= h AS INT)) >= 0.8 AS covered FROM j GROUP BY label, site, box""",
    "pose_classification": f"""WITH {PTS}, po AS (SELECT label, a % 7 AS pose, x, y, z FROM a), rc AS (SELECT label, b % 20 AS res, x, y, z FROM b WHERE b % 3 = 1), pr AS (SELECT label, x, y, z FROM b WHERE b % 3 = 2 AND b % 4 = 0),
n AS (SELECT label, pose, count(*) AS n_atoms FROM po GROUP BY ALL),
c AS (SELECT a.label, a.pose, min({D2}) AS m, list(DISTINCT res) FILTER (WHERE {D2} <= 16) AS r FROM po a JOIN rc b USING (label) GROUP BY a.label, a.pose),
q AS (SELECT a.label, list(DISTINCT res) AS s FROM pr a JOIN rc b USING (label) WHERE {D2} <= 16 GROUP BY a.label),
p AS (SELECT a.label, a.pose, min({D2}) AS m FROM po a JOIN pr b USING (label) GROUP BY a.label, a.pose)
SELECT n.label, n.pose, n_atoms, CAST(coalesce(len(r), 0) AS INT) AS n_contacts, round(sqrt(c.m), 9) AS min_receptor, round(sqrt(p.m), 9) AS min_primary, coalesce(sqrt(c.m) >= 0.5 AND coalesce(len(r), 0) >= 3, false) AS valid,
  coalesce(sqrt(c.m) >= 0.5 AND coalesce(len(r), 0) >= 3 AND NOT coalesce(list_has_any(r, s), false) AND sqrt(p.m) >= 1, false) AS "distinct" FROM n LEFT JOIN c USING (label, pose) LEFT JOIN q USING (label) LEFT JOIN p USING (label, pose)""",
    "clash_counts": f"WITH {PTS} SELECT a.label, count(*) AS n_clashes FROM a JOIN a AS b ON a.label = b.label AND a.a < b.a WHERE abs(a.a % 20 - b.a % 20) > 1 AND {D2} < 25 GROUP BY a.label",
    "medoid": f"WITH {PTS}, c AS (SELECT a.label, a.a, a.x, a.y, a.z, CAST(count(*) AS INT) AS n FROM a JOIN a AS b ON a.label = b.label WHERE {D2} <= 36 GROUP BY ALL) SELECT label, n AS n_near, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, a) AS q FROM c) WHERE q = 1",
    "repeated_support": f"""WITH {PTS}, s AS (SELECT label, a % 2 AS box, CASE WHEN a % 4 < 2 THEN 'one' ELSE 'two' END AS sc, a, x, y, z FROM a), g AS (SELECT label, box, sc FROM s GROUP BY ALL HAVING count(DISTINCT a) >= 3),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, box, sc ORDER BY n DESC, a) AS q FROM (SELECT a.label, a.box, a.sc, a.a, a.x, a.y, a.z, count(*) AS n FROM s a JOIN s b ON a.label = b.label AND a.box = b.box AND a.sc = b.sc WHERE {D2} <= 16 GROUP BY ALL)) WHERE q = 1),
k AS (SELECT label, box, min(n) AS lo, pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2) AS d FROM m GROUP BY ALL)
SELECT g.label, g.box, array_to_string(list_sort(list(sc)), ';') AS supported, count(*) >= 2 AS "both", count(*) >= 2 AND min(lo) >= 3 AND min(d) <= 25 AS stable FROM g JOIN k USING (label, box) GROUP BY g.label, g.box""",
    "time_gaps": f"WITH {EV} SELECT user_id, t AS \"at\", p AS previous, t - p AS gap FROM (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM ev) WHERE t - p > 6e10",
    "span_gap": f"""WITH {EV}, x AS (SELECT user_id, v, lag(v) OVER (PARTITION BY user_id ORDER BY v) AS p FROM ev), m AS (SELECT user_id, max(v - p) AS g FROM x GROUP BY user_id)
SELECT x.user_id, count(*) AS n, min(v) AS min, max(v) AS max, round(median(v), 9) AS median, round(max(v) - min(v), 9) AS span, round(coalesce(min(g), 0), 9) AS largest_gap, min(p) FILTER (WHERE v - p = g) AS gap_at FROM x JOIN m USING (user_id) GROUP BY x.user_id""",
    "histogram12": f"WITH {EV} SELECT user_id, CAST(least(floor(v / 100.0 * 12), 11) AS INT) AS bin, count(*) AS n FROM ev WHERE v BETWEEN 0 AND 100 GROUP BY 1, 2",
    "zero_runs": f"""WITH {EV}, x AS (SELECT user_id, t, v < 20 AS z, lag(t) OVER w AS p, lag(v < 20) OVER w AS pz, lead(t) OVER w AS nt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)),
y AS (SELECT *, sum(CAST(coalesce(t - p > 3e10, true) OR NOT coalesce(pz, false) AS INT)) OVER (PARTITION BY user_id ORDER BY t) AS r FROM x WHERE z),
g AS (SELECT user_id, r, min(t) AS s, max(t) AS l, arg_max(nt, t) AS nt0, max(CAST(nt IS NULL AS INT)) AS e FROM y GROUP BY user_id, r), h AS (SELECT g.*, CASE WHEN e = 1 THEN NULL ELSE nt0 END AS nt FROM g)
SELECT user_id, s AS start, CASE WHEN nt IS NULL OR nt - l > 3e10 THEN l ELSE nt END AS "end", CASE WHEN nt IS NULL THEN 'last' WHEN nt - l > 3e10 THEN 'gap' ELSE 'recovered' END AS reason FROM h""",
    "stitch_segments": """WITH r AS (SELECT user_id % 10 AS seg, event_id % 1000 / 10.0 AS lt, min(value) AS v FROM events GROUP BY 1, 2), x AS (SELECT seg, v, round(seg * 90 + CAST(lt AS DOUBLE), 4) AS t FROM r WHERE lt <= CASE WHEN seg % 2 = 1 THEN 95 ELSE 100 END + 1e-6)
SELECT t, seg, v FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY seg) AS q FROM x) WHERE q = 1""",
    "schedule_interpolation": """SELECT event_id, round(CASE WHEN event_id < 3000 THEN 1 + event_id / 3000.0 WHEN event_id < 7000 THEN 2 - 1.5 * ((event_id - 3000) / 4000.0) ELSE 0.5 END, 9) AS a,
  round(CASE WHEN event_id < 3000 THEN event_id / 300.0 WHEN event_id < 7000 THEN 10 + 10 * ((event_id - 3000) / 4000.0) ELSE 20 END, 9) AS k FROM events""",
    "evenly_spaced": "SELECT CAST(i AS INT) AS pick, event_id, value AS v FROM range(0, 100) t(i) JOIN events ON event_id = i * (SELECT max(event_id) FROM events) // 99",
    "contact_strata": "SELECT user_id, CASE WHEN NOT value > 20 THEN 'no_protein_contact' WHEN value > 50 THEN 'site_contact' ELSE 'other_surface_contact' END AS stratum, count(*) AS n FROM events GROUP BY 1, 2",
    "match_population": f"""WITH {SCORED}, e AS (SELECT * FROM r WHERE y = 0 AND o = 0 AND ck IS NOT NULL AND mw IS NOT NULL AND logp IS NOT NULL AND tpsa IS NOT NULL AND mw BETWEEN 150 AND 750 AND regexp_full_match(u, '[A-Z0-9]+')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u, ck ORDER BY s DESC, id) AS q FROM e) WHERE q = 1)
SELECT u, ck, id, round((rank() OVER (PARTITION BY u ORDER BY s) + (count(*) OVER (PARTITION BY u, s) - 1) / 2.0) / count(*) OVER (PARTITION BY u), 9) AS pct FROM b""",
}
ALL = PTS.replace(" FROM pt WHERE vec_id % 3 = 0)", " FROM pt)")
SQL |= {f"{q}_all": SQL[q].replace(PTS, ALL).replace(" WHERE label < 8", "") for q in ("box_coverage", "clash_counts", "medoid", "repeated_support")}
SQL["pose_classification_all"] = SQL["pose_classification"].replace(" AND b % 4 = 0", "")
