"""Queries on compared rankings, reference metrics, releases, docking endpoints and frame checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.operators import compare, endpoints, release, trajectory
from pairloom.operators import resample as R
from pairloom.plans.base import PAIRS, SCORED, pairs, rounded, scored
from pairloom.plans.ranking import _auc
from pairloom.session import table, written

KEYS = ["model", "method"]
MODELS = {"ligand": "s", "c1": "tpsa"}
METHODS = {"RAW": "logp", "QNB": "mw"}


# --- compared rankings: two scores of a row stand for models, two properties for structural methods ------------


def _stack(df, names, key, out):
    x = F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(c).cast("double").alias(out)) for n, c in names.items()])).alias("x")
    return df.select("id", "u", "y", x).select("id", "u", "y", "x.*")


def _matched(spark, d):
    r = scored(spark, d, "u", "y", "s", "logp", "mw", "tpsa")
    m = compare.matched_rankings(_stack(r, MODELS, "model", "a"), _stack(r, METHODS, "method", "b"), ["id", "u"], "model", "method", 2, 2)
    fam = pairs(spark, d, "u", "fam").groupBy("u").agg(F.min("fam").alias("fam"))
    return written(m.join(fam, "u", "left").withColumn("cluster", F.coalesce("fam", "u")), "matched")


def _table(spark, d):
    return written(compare.comparison_table(_matched(spark, d), KEYS, "u", "cluster"), "comparison")


def comparison_table(spark, d):
    return rounded(_table(spark, d), "spearman", "top_choice_agreement", "random_choice_expectation", "excess_agreement", "auroc_a", "auroc_b", digits=7)


def comparison_estimates(spark, d):
    return rounded(compare.estimates(_table(spark, d), KEYS, "u"), "estimate", digits=7)


def comparison_contrasts(spark, d):
    return rounded(compare.contrasts(_table(spark, d), *KEYS, "u", "ligand", ["protein"]), "estimate", digits=7)


def comparison_intervals(spark, d):
    t = _table(spark, d)
    rows = compare._long(t, KEYS, "u").withColumn("scope", F.lit("estimate")).select(*KEYS, "metric", "scope", "cluster", "v")
    diff = compare.contrast_rows(t, *KEYS, "u", "ligand", ["protein"]).withColumn("scope", F.lit("model_minus_ligand")).select(*KEYS, "metric", "scope", "cluster", "v")
    return rounded(compare.with_intervals(rows.unionByName(diff), [*KEYS, "metric", "scope"], "cluster", "v", t), "ci_low", "ci_high")


def reference_metrics(spark, d):
    r = scored(spark, d, "cohort", "u", "y", "s", "logp", "tpsa")
    m = compare.reference_metrics(r, ["cohort"], "u", F.col("y"), {"one": "s", "two": "logp", "three": "tpsa"})
    return rounded(m, "auroc", "ap_pos", "ap_neg", "ap_symmetric", "within_auroc")


def paired_within(spark, d):
    """Differences of two scores within proteins (which lie in one cluster) and within ligands (which do not)."""
    r = scored(spark, d, "u", "ck", "y", "s", "logp").filter("logp IS NOT NULL")
    r = written(r.withColumn("c", F.pmod(F.length("u") + F.ascii("u"), F.lit(7)).cast("int")), "rows")
    parts = [R.bootstrap_within(r, "c", [k], "y", "s", "logp", n).withColumn("scope", F.lit(f"within_{k}")) for k, n in (("u", 10_000), ("ck", 1_000))]
    return rounded(parts[0].unionByName(parts[1]), "delta", "ci_low", "ci_high")


def baseline_rows(spark, d):
    r = _stack(scored(spark, d, "u", "y", "s", "tpsa"), MODELS, "model", "score").filter("score IS NOT NULL")
    return compare.against_baseline(r.select("id", "model", "score"), [], "id", "model", "score", "ligand").groupBy("model").agg(F.count("*").alias("rows"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("difference"))


# --- releases ---------------------------------------------------------------------------------------------------


def released_scores(spark, d):
    r = scored(spark, d, "u", "s", "logp", "mw")
    s = r.select("id", F.col("s").alias("p_x_c1_mean"), F.col("logp").alias("p_x_d1_mean"))
    return rounded(release.released_scores(r.select("id", "u"), s, "id", ["c1", "d1"]), "c1", "d1")


def score_identity(spark, d):
    p = pairs(spark, d, "k", "y")
    return release.with_identity(p.select("id", F.col("y").alias("ranking_id")), p.select("id", F.col("k").alias("full_inchikey")), "id", {"ranking_id": "method"})


def input_availability(spark, d):
    p = table(spark, d, "pairs").select(F.col("main_row_id").alias("id"), F.upper(F.trim("uniprot")).alias("u"), F.col("ligand_embedding_path").alias("lp"), F.col("protein_embedding_path").alias("pp")).distinct()
    files = p.select(F.explode(F.array("lp", "pp")).alias("path")).filter(F.pmod(F.length("path") + F.ascii(F.reverse("path")), F.lit(3)) > 0)
    pockets = p.select("u").filter(F.pmod(F.ascii(F.reverse("u")), F.lit(2)) == 0)
    return release.input_availability(p, files, pockets, ["ligand", "protein", "c1", "d1"], "lp", "pp", "u").select("id", "model", "available", "score_status")


def annotated_rows(spark, d):
    r = scored(spark, d, "u", "s")
    return release.annotated(r.select("id", "u"), r.filter("s > 0").select("id", F.floor("s").alias("note")), "id")


def selected_predictions(spark, d):
    r = scored(spark, d, "cohort", "model", "s").select("id", F.col("cohort").alias("cohort_arm"), "model", F.col("s").cast("string").alias("p_allosteric"))
    p = release.prediction_frame(r, {"every_pair": "main"})
    return release.select_rows(p, {"model": "c1", "regime": None}).select("id", "dataset", F.round("score", 9).alias("score"))


def ensemble_ranks(spark, d):
    r = scored(spark, d, "u", "s").select("id", "u", *[(F.col("s") + F.lit(float(k))).alias(f"s{k}") for k in (1, 2, 3)])
    return rounded(release.ensemble_ranks(r, ["s1", "s2", "s3"], "u").select("id", "score", "seed_sd", "global_rank", "within_rank"), "score", "seed_sd")


def deployment_epochs(spark, d):
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 4).alias("cohort"), (F.col("o_orderkey") % 3).alias("seed"), F.pmod(F.col("o_orderkey") + F.col("o_custkey"), F.lit(5)).alias("outer_fold"))
    return release.deployment_epochs(o.agg(F.max(F.col("o_orderkey") % 25).alias("best_epoch")), ["cohort"], [0, 1, 2], 5)


def scaffolds_added(spark, d):
    """The structure up to its first bracket stands for the scaffold that a chemistry library would give."""
    p = table(spark, d, "pairs").select(F.col("main_row_id").alias("id"), F.col("connectivity_key").alias("ck"), F.col("canonical_smiles").alias("c")).filter("ck IS NOT NULL").distinct()
    return release.add_scaffolds(p, "ck", "c", lambda c: F.substring_index(c, "(", 1)).select("ck", "murcko_scaffolds_json").distinct()


def label_disagreements(spark, d):
    p = pairs(spark, d, "u", "k", "y", "fam", "yr")
    a, b = p.select("id", "y", "fam"), p.select("id", F.when(F.col("yr") < 2010, 1 - F.col("y")).otherwise(F.col("y")).alias("label"), F.col("fam").alias("family"))
    return release.disagreements(a, b, ["id"], {"label": ("y", "label"), "family": ("fam", "family")})


def seeds_one_to_one(spark, d):
    p = pairs(spark, d, "yr")
    return release.one_to_one(p.filter("yr IS NULL OR yr >= 2005").select("id"), p.filter("yr IS NULL OR yr <= 2015").select("id"), ["id"])


def population(spark, d):
    p = pairs(spark, d, "y", "e", "yr")
    kept = release.validate_temporal(p.filter(F.col("yr") <= 2015).withColumn("k2", F.col("id")), "yr", 2015, "id", ["k2"], "y")
    release.two_classes(kept, [], "y")
    return release.label_population(kept, "y", "e").select("id")


# --- docking endpoints: line items stand for poses, suppliers for compounds, nations for proteins ------------------


def _units(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("system"), F.col("s_nationkey").alias("target"))
    pos = F.row_number().over(Window.partitionBy("target").orderBy("system")) - 1
    s = s.withColumn("n", pos).withColumn("match", F.concat_ws(":", "target", F.floor(F.col("n") / 2).cast("long"))).withColumn("role", F.when(F.col("n") % 2 == 0, "candidate").otherwise("comparison")).drop("n")
    return s.join(s.groupBy("match").count().filter("count = 2").select("match"), "match")


def _flags(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("target"), F.when(F.col("n_nationkey") % 4 == 0, endpoints.LIMITED).otherwise("full").alias("reference_kind"))
    n = n.withColumns({"strict_distinct_evaluable": F.when(F.col("target") % 5 == 1, F.lit(False)), "known_site_evaluable": F.when(F.col("target") % 3 == 0, F.lit(False))})
    return endpoints.evaluability(n.withColumn("strict_distinct_exclusion_reason", F.lit(None).cast("string")).withColumn("known_site_exclusion_reason", F.lit(None).cast("string")), "target")


def evaluable_targets(spark, d):
    return _flags(spark, d)


def _coverage(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("target"), (F.col("n_regionkey") != 2).alias("covered"))


def endpoint_targets(spark, d):
    return endpoints.endpoint_targets(_flags(spark, d), _coverage(spark, d), "target")


def _hits(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target")), "l_suppkey")
    x = l.select(
        F.col("l_suppkey").alias("system"), "target", (F.col("l_partkey") % 3).alias("box"), F.when(F.col("l_linestatus") == "O", "vina").otherwise("vinardo").alias("scoring"),
        (F.col("l_linenumber") % 5).alias("seed"), (-F.col("l_quantity") / 5).alias("score"), F.round(F.col("l_discount") * 40, 0).alias("x"), F.round(F.col("l_tax") * 40, 0).alias("y"), F.lit(0.0).alias("z"),
        F.when(F.col("l_returnflag") == "R", endpoints.STRICT).otherwise(endpoints.KNOWN).alias("endpoint"), F.when(F.col("l_returnflag") == "A", "a").otherwise("b").alias("site"),
    )
    # one pose for each seed of a box and function: the lowest score, then the lowest coordinates
    return x.groupBy("system", "target", "box", "scoring", "seed", "endpoint", "site").agg(F.min(F.struct("score", "x", "y", "z")).alias("p")).select("system", "target", "box", "scoring", "seed", "endpoint", "site", "p.*")


def _endpoints(spark, d):
    return endpoints.endpoint_table(_units(spark, d), written(endpoint_targets(spark, d), "targets"), _hits(spark, d), "target", "system", "box", ["vina", "vinardo"])


def endpoint_table(spark, d):
    return _endpoints(spark, d).select("system", "match", "role", "endpoint", "energy_cutoff", "scoring", "success")


SUMMARY = ["endpoint", "energy_cutoff", "scoring"]


def endpoint_counts(spark, d):
    s = _summary(spark, d)
    return rounded(s.select(*SUMMARY, "n_pairs", "n_blocks", "candidate_mean", "comparison_mean", "delta", "candidate_only", "comparison_only", "both", "neither"), "candidate_mean", "comparison_mean", "delta")


def _summary(spark, d):
    return endpoints.endpoint_summary(_endpoints(spark, d), SUMMARY, ["endpoint", "energy_cutoff"], "target", "match", F.col("success"))


def endpoint_summary(spark, d):
    return rounded(_summary(spark, d), "candidate_mean", "comparison_mean", "delta", "ci_low", "ci_high", "p", "holm_p")


def unit_problems(spark, d):
    u = _units(spark, d).filter("NOT (target % 3 = 0 AND role = 'comparison')")
    return endpoints.invalid_units(u, "system", "match", "target")


def seed_grid_problems(spark, d):
    return endpoints.seed_grid_problems(_hits(spark, d), "system", "box", ["vina", "vinardo"])


def known_site_matches(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", *[F.round(F.col("embedding")[i].cast("double") * 10, 3).alias(c) for i, c in enumerate("xyz")])
    keys = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.col("vec_id") * 7 + i * 5) % 40)
    poses = e.filter("vec_id % 50 > 0").select("label", F.col("vec_id").alias("pose"), (F.col("vec_id") % 3).alias("box"), keys.alias("contacts"), (F.col("vec_id") % 4 > 0).alias("valid"), *"xyz")
    sites = e.filter("vec_id % 50 = 0").select("label", F.col("vec_id").alias("site"), keys.alias("keys"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    cover = sites.select("label", "site", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("box")).withColumn("covered", (F.col("site") / 50 + F.col("box")).cast("long") % 2 == 0)
    out = endpoints.known_site_matches(poses, sites, cover, "label", "pose", "box", "site")
    return rounded(out, "recall", "precision", "distance", digits=7)


# --- frames ---------------------------------------------------------------------------------------------------------


def cell_widths(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 7 + 5.0).alias("a"), (F.col("p_size") % 5 + 6.0).alias("b"), (F.col("p_size") % 3 + 7.0).alias("c"), (F.col("p_partkey") % 40 + 70.0).alias("al"), (F.col("p_partkey") % 30 + 75.0).alias("be"), (F.col("p_partkey") % 20 + 80.0).alias("ga"))
    m = p.select("p_partkey", trajectory.cell_vectors(F.array("a", "b", "c"), F.array("al", "be", "ga")).alias("m"))
    w = trajectory.perpendicular_widths(F.col("m"))
    return rounded(m.select("p_partkey", F.col("m")[1][0].alias("bx"), F.col("m")[2][2].alias("cz"), *[w[i].alias(f"w{i}") for i in range(3)]), "bx", "cz", "w0", "w1", "w2", digits=6)


def residue_changes(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("vec_id") + i * i) % 23).alias("b"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("vec_id") * 3 + i) % 23).alias("a"))
    c = trajectory.residue_changes(F.col("b"), F.col("a"))
    return e.select("vec_id", *[F.array_join(c[k], ";").alias(k) for k in ("lost", "gained", "kept")])


def _frame(spark, d):
    """A vector is a frame: its first 15 numbers are five ligand atoms, the next 45 fifteen protein atoms, in a skewed cell."""
    e = table(spark, d, "embeddings")
    atoms = lambda a, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.slice("embedding", i * 3 + a, F.lit(3)), lambda v: F.round(v.cast("double") * 20, 3)))
    cell = F.array(F.array(F.lit(9.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(8.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.5), F.lit(7.0)))
    return e.select("vec_id", atoms(1, 5).alias("l"), atoms(16, 15).alias("p"), F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: (i / 2).cast("long")).alias("r"), cell.alias("c"))


def imaged_contacts(spark, d):
    return rounded(trajectory.contact_table(_frame(spark, d), "vec_id", "l", "p", "r", "c", [0, 1, 2], 2.0), "raw_min", "mim_min", digits=6)


def imaging_states(spark, d):
    f = _frame(spark, d).withColumn("l2", F.when(F.col("vec_id") % 2 == 0, F.transform("l", lambda v: F.array(v[0] + 9.0, v[1], v[2]))).otherwise(F.col("l")))
    return trajectory.imaging_check(f, "vec_id", "l", "p", "l2", "p", "r", "c", 2.0).select("frame", "state", F.array_join("flags", ";").alias("flags"), F.size("lost").alias("lost"), F.size("gained").alias("gained"))


def pose_metrics(spark, d):
    first = _frame(spark, d).orderBy("vec_id").first()  # the reference structure
    ref = {"core": first["p"], "ligand": first["l"], "protein": first["p"]}
    out = trajectory.pose_metrics(_frame(spark, d), "vec_id", "p", "l", "p", "r", ref, [0, 1, 2], 3.0)
    return rounded(out.withColumn("pairs_below", F.array_join("pairs_below", ";")), "core_rmsd", "ligand_rmsd", "centroid", "internal_rmsd", "kept", "kept_site", "min_pair", digits=5)


def preparation_check(spark, d):
    f = _frame(spark, d).withColumn("b", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(i, i + 1)))
    return rounded(trajectory.preparation_check(f, "vec_id", "l", "b", "c", 12.0), "longest_bond", "image_gap", digits=6)


def schedule_deviation(spark, d):
    s = spark.createDataFrame([(0, 1.0, 0.0), (3000, 2.0, 10.0), (7000, 0.5, 20.0)], "step int, a double, k double")
    log = table(spark, d, "events").select(F.col("event_id").alias("step"), (F.col("value") / 100).alias("a"), (F.col("value") / 5).alias("k"))
    return rounded(trajectory.schedule_deviation(log, s, "step", ["a", "k"], 5.0), "deviation", digits=6)


def contact_seeds(spark, d):
    rows = spark.range(0, 200).select(F.when(F.col("id") < 100, "open").otherwise("closed").alias("leg"), (F.col("id") % 100 + 1).alias("seed"))
    e = table(spark, d, "events").groupBy((F.col("event_id") % 200).alias("n")).agg(F.min("value").alias("v"), F.max("value").alias("wpd"))
    x = rows.withColumn("n", F.when(F.col("leg") == "open", 0).otherwise(100) + F.col("seed") - 1).join(e, "n")
    x = x.withColumn("stratum", F.when(F.col("v") < 1, "no_protein_contact").when(F.col("v") < 2, "site_contact").otherwise("other_surface_contact"))
    return trajectory.contact_seeds(x, ["open", "closed"], 100, ["site_contact", "other_surface_contact", "no_protein_contact"], "site_contact")


QUERIES = {
    f.__name__: f
    for f in (
        comparison_table, comparison_estimates, comparison_contrasts, comparison_intervals, reference_metrics, paired_within, baseline_rows, released_scores, score_identity,
        input_availability, annotated_rows, selected_predictions, ensemble_ranks, deployment_epochs, scaffolds_added, label_disagreements, seeds_one_to_one, population,
        evaluable_targets, endpoint_targets, endpoint_table, endpoint_counts, endpoint_summary, unit_problems, seed_grid_problems, known_site_matches,
        cell_widths, residue_changes, imaged_contacts, imaging_states, pose_metrics, preparation_check, schedule_deviation, contact_seeds,
    )
}
W = f"WITH {PAIRS}, {SCORED}"
FULL = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c})" for c in ("s", "tpsa", "logp", "mw"))


def _avg_rank(part: str, v: str, order: str = "") -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {v} {order}) + (count(*) OVER (PARTITION BY {part}, {v}) - 1) / 2.0"


G = "model, method, u"
COMPARED = f"""{W}, x AS (SELECT r.id, r.u, r.y, m.model, m.a, t.method, t.b FROM r, LATERAL (VALUES ('ligand', s), ('c1', tpsa)) m(model, a), LATERAL (VALUES ('RAW', logp), ('QNB', mw)) t(method, b) WHERE {FULL}),
k AS (SELECT *, {_avg_rank(G, 'a')} AS ra, {_avg_rank(G, 'b')} AS rb, a = max(a) OVER (PARTITION BY {G}) AS ia, b = max(b) OVER (PARTITION BY {G}) AS ib FROM x),
g AS (SELECT {G}, count(*) AS pairs, sum(y) AS p, CASE WHEN count(*) >= 3 AND count(DISTINCT ra) > 1 AND count(DISTINCT rb) > 1 THEN corr(ra, rb) END AS spearman,
  count(*) FILTER (WHERE ia AND ib) / CAST(count(*) FILTER (WHERE ia) * count(*) FILTER (WHERE ib) AS DOUBLE) AS agree,
  (sum(ra) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auroc_a, (sum(rb) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auroc_b
  FROM k GROUP BY {G} HAVING count(*) >= 2),
fm AS (SELECT u, min(fam) AS fam FROM p GROUP BY u),
ct AS (SELECT g.model, g.method, g.u, coalesce(fam, g.u) AS cluster, pairs, spearman, agree AS top_choice_agreement, 1 / CAST(pairs AS DOUBLE) AS random_choice_expectation, agree - 1 / CAST(pairs AS DOUBLE) AS excess_agreement, auroc_a, auroc_b FROM g LEFT JOIN fm ON fm.u = g.u),
l AS (SELECT model, method, u, pairs, t.metric, t.v FROM ct, LATERAL (VALUES ('spearman', spearman), ('excess_agreement', excess_agreement), ('auroc_a', auroc_a), ('auroc_b', auroc_b)) t(metric, v) WHERE t.v IS NOT NULL)"""
ALL3 = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c})" for c in ("logp", "tpsa"))
STACKED = f"x AS (SELECT cohort, u, y, t.model, t.s FROM r, LATERAL (VALUES ('one', s), ('two', logp), ('three', tpsa)) t(model, s) WHERE {ALL3})"
UNITS = """su AS (SELECT s_suppkey AS system, s_nationkey AS target, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier),
un AS (SELECT system, target, target || ':' || (n // 2) AS match, CASE WHEN n % 2 = 0 THEN 'candidate' ELSE 'comparison' END AS role FROM su),
u AS (SELECT * FROM un WHERE match IN (SELECT match FROM un GROUP BY match HAVING count(*) = 2))"""
FLAGS = f"""fl AS (SELECT n_nationkey AS target, n_regionkey <> 2 AS covered, CASE WHEN n_nationkey % 5 = 1 THEN false ELSE n_nationkey % 4 <> 0 END AS strict, n_nationkey % 3 <> 0 AS known FROM nation),
tg AS (SELECT '{endpoints.STRICT}' AS endpoint, target FROM fl WHERE strict UNION ALL SELECT '{endpoints.KNOWN}', target FROM fl WHERE known AND covered)"""
HITS = f"""hx AS (SELECT l_suppkey AS system, s_nationkey AS target, l_partkey % 3 AS box, CASE WHEN l_linestatus = 'O' THEN 'vina' ELSE 'vinardo' END AS scoring, l_linenumber % 5 AS seed, -l_quantity / 5 AS score,
  round(l_discount * 40, 0) AS x, round(l_tax * 40, 0) AS y, CASE WHEN l_returnflag = 'R' THEN '{endpoints.STRICT}' ELSE '{endpoints.KNOWN}' END AS endpoint, CASE WHEN l_returnflag = 'A' THEN 'a' ELSE 'b' END AS site FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system, target, box, scoring, seed, endpoint, site ORDER BY score, x, y) AS q FROM hx) WHERE q = 1)"""
HK = "endpoint, cut, system, box, site"
TABLE = f"""{UNITS}, {FLAGS}, {HITS}, hc AS (SELECT h.*, c.cut FROM h JOIN tg USING (endpoint, target), (VALUES ('none', 1e9), ('-5', -5.0)) c(cut, least) WHERE score <= least),
n AS (SELECT {HK}, scoring FROM hc GROUP BY ALL HAVING count(DISTINCT seed) >= 3), bo AS (SELECT {HK} FROM n GROUP BY ALL HAVING count(*) = 2),
hb AS (SELECT hc.* FROM hc JOIN bo USING ({HK})),
nr AS (SELECT a.endpoint, a.cut, a.system, a.box, a.site, a.scoring, a.seed, a.x, a.y, count(*) AS c FROM hb a JOIN hb b ON a.endpoint = b.endpoint AND a.cut = b.cut AND a.system = b.system AND a.box = b.box AND a.site = b.site AND a.scoring = b.scoring
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 16 GROUP BY ALL),
md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {HK}, scoring ORDER BY c DESC, seed) AS q FROM nr) WHERE q = 1),
st AS (SELECT {HK} FROM md GROUP BY ALL HAVING min(c) >= 3 AND pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) <= 25),
won AS (SELECT DISTINCT endpoint, cut, system, scoring FROM n UNION SELECT endpoint, cut, system, 'both_same_box' FROM bo UNION SELECT endpoint, cut, system, 'spatially_stable' FROM st),
et AS (SELECT u.*, tg.endpoint, c.cut AS energy_cutoff, k.scoring, EXISTS (SELECT 1 FROM won w WHERE w.endpoint = tg.endpoint AND w.cut = c.cut AND w.system = u.system AND w.scoring = k.scoring) AS success
  FROM u JOIN tg USING (target), (VALUES ('none'), ('-5')) c(cut), (VALUES ('vina'), ('vinardo'), ('both_same_box'), ('spatially_stable')) k(scoring))"""
FRAME = """f AS (SELECT vec_id, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE) * 20, 3)) AS e FROM embeddings),
li AS (SELECT vec_id, i, e[i * 3 + 1] AS x, e[i * 3 + 2] AS y, e[i * 3 + 3] AS z FROM f, range(0, 5) t(i)), pr AS (SELECT vec_id, i, i // 2 AS r, e[i * 3 + 16] AS x, e[i * 3 + 17] AS y, e[i * 3 + 18] AS z FROM f, range(0, 15) t(i)),
sh AS (SELECT a, b, c, a * 9.0 + b * 2.0 + c * 1.0 AS x, b * 8.0 + c * 1.5 AS y, c * 7.0 AS z FROM range(-1, 2) t1(a), range(-1, 2) t2(b), range(-1, 2) t3(c))"""
PLAN = "CASE WHEN event_id < 3000 THEN 1 + event_id / 3000.0 WHEN event_id < 7000 THEN 2 - 1.5 * ((event_id - 3000) / 4000.0) ELSE 0.5 END", "CASE WHEN event_id < 3000 THEN event_id / 300.0 WHEN event_id < 7000 THEN 10 + 10 * ((event_id - 3000) / 4000.0) ELSE 20 END"

SQL = {
    "comparison_table": f"{COMPARED} SELECT model, method, u, cluster, pairs, round(spearman, 7) AS spearman, round(top_choice_agreement, 7) AS top_choice_agreement, round(random_choice_expectation, 7) AS random_choice_expectation, round(excess_agreement, 7) AS excess_agreement, round(auroc_a, 7) AS auroc_a, round(auroc_b, 7) AS auroc_b FROM ct",
    "comparison_estimates": f"{COMPARED} SELECT model, method, metric, count(*) AS entities, CAST(sum(pairs) AS BIGINT) AS pairs, round(avg(v), 7) AS estimate FROM l GROUP BY ALL",
    "comparison_contrasts": f"{COMPARED} SELECT a.model, a.method, a.metric, count(*) AS entities, round(avg(a.v - b.v), 7) AS estimate FROM l a JOIN l b ON b.model = 'ligand' AND a.method = b.method AND a.metric = b.metric AND a.u = b.u WHERE a.model = 'c1' GROUP BY ALL",
    "reference_metrics": f"{W}, {STACKED}, " + _auc("cohort, model", "x") + f""", w AS (SELECT cohort, model, u, y, {_avg_rank('cohort, model, u', 's')} AS k FROM x),
v AS (SELECT cohort, model, u, count(*) AS n, (sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS a FROM w GROUP BY ALL HAVING min(y) <> max(y)),
z AS (SELECT cohort, model, avg(a) AS within_auroc, count(*) AS two_class_entities, CAST(sum(n) AS BIGINT) AS within_rows FROM v GROUP BY ALL)
SELECT cohort, model, n AS rows, n_pos, round(auroc, 9) AS auroc, round(ap_pos, 9) AS ap_pos, round(ap_neg, 9) AS ap_neg, round((ap_pos + ap_neg) / 2, 9) AS ap_symmetric, round(within_auroc, 9) AS within_auroc, coalesce(two_class_entities, 0) AS two_class_entities, coalesce(within_rows, 0) AS within_rows FROM m LEFT JOIN z USING (cohort, model)""",
    "baseline_rows": f"{W} SELECT 'c1' AS model, count(*) AS rows, round(avg(tpsa - s), 6) AS difference FROM r WHERE tpsa IS NOT NULL",
    "released_scores": f"{W} SELECT id, u, round(s, 9) AS c1, round(logp, 9) AS d1 FROM r",
    "score_identity": f"{W} SELECT id, y AS method, k AS full_inchikey FROM p",
    "input_availability": """WITH p AS (SELECT DISTINCT main_row_id AS id, upper(trim(uniprot)) AS u, ligand_embedding_path AS lp, protein_embedding_path AS pp FROM pairs), fs AS (SELECT DISTINCT f FROM (SELECT lp AS f FROM p UNION SELECT pp FROM p) WHERE (length(f) + ascii(right(f, 1))) % 3 > 0),
x AS (SELECT id, model, (model = 'protein' OR coalesce(lp IN (SELECT f FROM fs), false)) AND (model = 'ligand' OR coalesce(pp IN (SELECT f FROM fs), false)) AND (model <> 'd1' OR coalesce(ascii(right(u, 1)) % 2 = 0, false)) AS available FROM p, (VALUES ('ligand'), ('protein'), ('c1'), ('d1')) m(model))
SELECT id, model, available, CASE WHEN available THEN 'scored' ELSE 'input_unavailable' END AS score_status FROM x""",
    "annotated_rows": f"{W} SELECT id, u, CASE WHEN s > 0 THEN CAST(floor(s) AS BIGINT) END AS note FROM r",
    "selected_predictions": f"{W} SELECT id, CASE cohort WHEN 'every_pair' THEN 'main' ELSE cohort END AS dataset, round(s, 9) AS score FROM r WHERE model = 'c1'",
    "ensemble_ranks": f"{W} SELECT id, round(s + 2, 9) AS score, round(sqrt(CAST(2 AS DOUBLE) / 3), 9) AS seed_sd, rank() OVER (ORDER BY ((s + 1) + (s + 2) + (s + 3)) / 3 DESC) + (count(*) OVER (PARTITION BY ((s + 1) + (s + 2) + (s + 3)) / 3) - 1) / 2.0 AS global_rank, rank() OVER (PARTITION BY u ORDER BY ((s + 1) + (s + 2) + (s + 3)) / 3 DESC) + (count(*) OVER (PARTITION BY u, ((s + 1) + (s + 2) + (s + 3)) / 3) - 1) / 2.0 AS within_rank FROM r",
    "deployment_epochs": "SELECT cohort, CAST(median(b) AS INT) AS epochs FROM (SELECT o_custkey % 4 AS cohort, max(o_orderkey % 25) AS b FROM orders GROUP BY o_custkey % 4, o_orderkey % 3, (o_orderkey + o_custkey) % 5) GROUP BY cohort",
    "scaffolds_added": """WITH x AS (SELECT DISTINCT connectivity_key AS ck, replace(split_part(canonical_smiles, '(', 1), chr(92), chr(92) || chr(92)) AS s FROM pairs WHERE connectivity_key IS NOT NULL)
SELECT ck, CASE WHEN count(*) FILTER (WHERE s <> '') = 0 THEN '[]' ELSE '["' || array_to_string(list_sort(list(DISTINCT s) FILTER (WHERE s <> '')), '", "') || '"]' END AS murcko_scaffolds_json FROM x GROUP BY ck""",
    "label_disagreements": f"{W} SELECT id, 'label' AS field, CAST(y AS VARCHAR) AS \"left\", CAST(1 - y AS VARCHAR) AS \"right\" FROM p WHERE yr < 2010 UNION ALL SELECT id, 'family', fam, fam FROM p WHERE fam IS NULL",
    "seeds_one_to_one": f"{W} SELECT id, CASE WHEN yr > 2015 THEN 'missing' ELSE 'extra' END AS problem FROM p WHERE yr > 2015 OR yr < 2005",
    "population": f"{W} SELECT id FROM p WHERE yr <= 2015 AND y IN (0, 1) AND e = 1",
    "evaluable_targets": f"WITH {FLAGS} SELECT target, strict, CASE WHEN strict THEN '' ELSE '{endpoints.STRICT_REASON}' END AS strict_reason, known, CASE WHEN known THEN '' ELSE '{endpoints.KNOWN_REASON}' END AS known_reason FROM fl",
    "endpoint_targets": f"WITH {FLAGS} SELECT * FROM tg",
    "endpoint_table": f"WITH {TABLE} SELECT system, match, role, endpoint, energy_cutoff, scoring, success FROM et",
    "endpoint_counts": f"""WITH {TABLE}, pr AS (SELECT endpoint, energy_cutoff, scoring, target, match, max(CAST(success AS INT)) FILTER (WHERE role = 'candidate') AS a, max(CAST(success AS INT)) FILTER (WHERE role = 'comparison') AS b FROM et GROUP BY ALL)
SELECT endpoint, energy_cutoff, scoring, count(*) AS n_pairs, count(DISTINCT target) AS n_blocks, round(avg(a), 9) AS candidate_mean, round(avg(b), 9) AS comparison_mean, round(avg(a - b), 9) AS delta, count(*) FILTER (WHERE a > b) AS candidate_only, count(*) FILTER (WHERE a < b) AS comparison_only,
  count(*) FILTER (WHERE a = 1 AND b = 1) AS "both", count(*) FILTER (WHERE a = 0 AND b = 0) AS neither FROM pr GROUP BY endpoint, energy_cutoff, scoring""",
    "unit_problems": f"WITH {UNITS} SELECT DISTINCT match FROM u WHERE target % 3 = 0",
    "seed_grid_problems": f"""WITH {HITS}, g AS (SELECT system, box, scoring, count(*) AS n, count(DISTINCT seed) AS d FROM h GROUP BY ALL)
SELECT system, box, 'repeated seed' AS problem FROM g WHERE n <> d UNION ALL SELECT system, box, 'number of seeds' FROM g WHERE d <> 5 UNION ALL SELECT system, box, 'scoring functions' FROM g GROUP BY system, box HAVING count(*) <> 2""",
    "known_site_matches": """WITH e AS (SELECT label, vec_id, round(CAST(embedding[1] AS DOUBLE) * 10, 3) AS x, round(CAST(embedding[2] AS DOUBLE) * 10, 3) AS y, round(CAST(embedding[3] AS DOUBLE) * 10, 3) AS z, list_transform(range(0, 6), lambda i: (vec_id * 7 + i * 5) % 40) AS k FROM embeddings),
j AS (SELECT a.label, a.vec_id AS pose, a.vec_id % 3 AS box, b.vec_id AS site, len(list_intersect(a.k, b.k)) AS n, len(list_distinct(b.k)) AS own, len(list_distinct(a.k)) AS al, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d, a.vec_id % 4 > 0 AS valid FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 50 > 0 AND b.vec_id % 50 = 0)
SELECT label, pose, box, site, round(n / CAST(own AS DOUBLE), 7) AS recall, round(n / CAST(al AS DOUBLE), 7) AS precision, round(d, 7) AS distance, (site // 50 + box) % 2 = 0 AS covered, valid AND n >= 3 AND n / CAST(own AS DOUBLE) >= 0.25 AND d <= 5 AS match FROM j""",
    "cell_widths": """WITH p AS (SELECT p_partkey, p_size % 7 + 5.0 AS a, p_size % 5 + 6.0 AS b, p_size % 3 + 7.0 AS c, radians(p_partkey % 40 + 70.0) AS al, radians(p_partkey % 30 + 75.0) AS be, radians(p_partkey % 20 + 80.0) AS ga FROM part),
q AS (SELECT *, sqrt(1 - pow(cos(al), 2) - pow(cos(be), 2) - pow(cos(ga), 2) + 2 * cos(al) * cos(be) * cos(ga)) AS v FROM p)
SELECT p_partkey, round(b * cos(ga), 6) AS bx, round(c * v / sin(ga), 6) AS cz, round(a * v / sin(al), 6) AS w0, round(b * v / sin(be), 6) AS w1, round(c * v / sin(ga), 6) AS w2 FROM q""",
    "residue_changes": """WITH e AS (SELECT vec_id, list_transform(range(0, 10), lambda i: (vec_id + i * i) % 23) AS b, list_transform(range(0, 10), lambda i: (vec_id * 3 + i) % 23) AS a FROM embeddings)
SELECT vec_id, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), ';') AS lost, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ';') AS gained, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: list_contains(a, x)))), ';') AS kept FROM e""",
    "imaged_contacts": f"""WITH {FRAME}, d AS (SELECT l.vec_id, l.i AS li, p.i AS pi, p.r, l.x - p.x AS x, l.y - p.y AS y, l.z - p.z AS z FROM li l JOIN pr p USING (vec_id)),
q AS (SELECT *, z / 7.0 AS f3, (y - 1.5 * z / 7.0) / 8.0 AS f2, (x - 2.0 * (y - 1.5 * z / 7.0) / 8.0 - z / 7.0) / 9.0 AS f1 FROM d),
w AS (SELECT *, (f1 - round(f1)) * 9 + (f2 - round(f2)) * 2 + (f3 - round(f3)) AS wx, (f2 - round(f2)) * 8 + (f3 - round(f3)) * 1.5 AS wy, (f3 - round(f3)) * 7 AS wz FROM q),
m AS (SELECT vec_id, li, pi, r, sqrt(any_value(w.x * w.x + w.y * w.y + w.z * w.z)) AS raw, sqrt(min(pow(wx + sh.x, 2) + pow(wy + sh.y, 2) + pow(wz + sh.z, 2))) AS near FROM w, sh GROUP BY ALL)
SELECT vec_id AS frame, count(*) FILTER (WHERE raw <= 2) AS raw_pairs, round(min(raw), 6) AS raw_min, count(*) FILTER (WHERE near <= 2) AS mim_pairs, round(min(near), 6) AS mim_min, count(DISTINCT r) FILTER (WHERE near <= 2) AS mim_residues, count(DISTINCT r) FILTER (WHERE near <= 2 AND r < 3) AS mim_site, false AS too_wide FROM m GROUP BY vec_id""",
    "preparation_check": f"""WITH {FRAME}, bd AS (SELECT a.vec_id, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS m FROM li a JOIN li b ON a.vec_id = b.vec_id AND b.i = a.i + 1 GROUP BY a.vec_id),
gp AS (SELECT a.vec_id, sqrt(min(pow(a.x - b.x - sh.x, 2) + pow(a.y - b.y - sh.y, 2) + pow(a.z - b.z - sh.z, 2))) AS g FROM li a JOIN li b USING (vec_id), sh WHERE NOT (sh.a = 0 AND sh.b = 0 AND sh.c = 0) GROUP BY a.vec_id)
SELECT vec_id AS seed, true AS finite, round(m, 6) AS longest_bond, m <= 12 AS coherent, round(g, 6) AS image_gap FROM bd JOIN gp USING (vec_id)""",
    "schedule_deviation": f"WITH x AS (SELECT event_id, abs(value / 100 - ({PLAN[0]})) AS a, abs(value / 5 - ({PLAN[1]})) AS k FROM events), y AS (SELECT event_id, 'a' AS c, a AS d FROM x UNION ALL SELECT event_id, 'k', k FROM x) SELECT c AS \"column\", round(d, 6) AS deviation, event_id AS at_step, d <= 5 AS ok FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d DESC, event_id) AS q FROM y) WHERE q = 1",
    "contact_seeds": "WITH e AS (SELECT event_id % 200 AS n, min(value) AS v FROM events GROUP BY 1) SELECT CASE WHEN n < 100 THEN 'open' ELSE 'closed' END AS leg, n % 100 + 1 AS seed FROM e WHERE v >= 1 AND v < 2",
}
