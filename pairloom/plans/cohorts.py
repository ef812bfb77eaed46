"""Queries on cohorts, partitions, time splits, integration and novelty."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.booleans import strict_bool
from pairloom.operators import cohorts as C
from pairloom.operators import integrate as I
from pairloom.operators.graph import related_groups
from pairloom.operators.keys import clean_key
from pairloom.plans.base import PAIRS, SCORED, pairs, rounded, scored
from pairloom.session import table

CUTOFF = 2015
FOLD = 0
FAMILY_SQL = "(SELECT min(fam) FROM p WHERE fam IS NOT NULL)"


def both_class_proteins(spark, d):
    return C.both_roles(pairs(spark, d), "u").select("id", "u")


def both_class_ligands(spark, d):
    return C.both_roles(pairs(spark, d), "k").select("id", "k")


def both_class_fixpoint(spark, d):
    p = pairs(spark, d, "u", "k", "y", "e").filter("e = 1")
    return C.role_fixpoint(p, ["u", "k"])[0].select("id")


def cohort_counts(spark, d):
    # the frozen rows of this table are not one per label and protein, so that rule is not checked
    return C.dataset_counts(C.construct_datasets(pairs(spark, d, "u", "k", "y", "e"), F.col("e") == 1, checked=False), ["dataset"])


def _early(spark, d):
    return pairs(spark, d, "u", "k", "ck", "y", "yr").filter(F.col("yr") <= CUTOFF)


def early_cohorts(spark, d):
    return C.dataset_counts(C.complete_cohorts(_early(spark, d))[0], ["dataset"])


def fixpoint_history(spark, d):
    history = C.complete_cohorts(_early(spark, d))[1]
    return spark.createDataFrame(list(enumerate(history)), "iteration long, rows long")


def temporal_counts(spark, d):
    return C.temporal_cohorts(pairs(spark, d, "u", "k", "ck", "y", "yr"), "yr", CUTOFF, ["u", "ck"])[1]


def temporal_rows(spark, d):
    return C.temporal_cohorts(pairs(spark, d, "u", "k", "ck", "y", "yr"), "yr", CUTOFF, ["u", "ck"])[0].select("id", "dataset", "part")


def _part(spark, d, col):
    return C.fold_partition(pairs(spark, d), col, FOLD, F.col("e") == 1)


def partition_random(spark, d):
    return _part(spark, d, "rf").select("id", "part")


def partition_family(spark, d):
    return _part(spark, d, "ff").select("id", "part")


def partition_ligand(spark, d):
    return _part(spark, d, "lf").select("id", "part")


def partition_double_held_out(spark, d):
    return C.purge_shared(_part(spark, d, "ff"), "ck").select("id", "part")


def partition_scaffold(spark, d):
    parts = C.purge_shared(_part(spark, d, "ff"), "ck")
    return C.purge_shared_sets(parts, "id", F.from_json("sc", "array<string>")).select("id", "part")


def partition_overlaps(spark, d):
    return C.overlaps(_part(spark, d, "rf"), ["id", "ck", "fam"])


def leave_one_family_out(spark, d):
    p = pairs(spark, d)
    family = p.agg(F.min("fam")).first()[0]
    return C.leave_one_out(p, "fam", family, "ck").select("id", "part")


def frozen_partition(spark, d):
    p = pairs(spark, d)
    m = p.select("id", F.when(F.col("rf") == 0, "test").when(F.col("rf") == 1, "validation").when(F.col("rf").isNull(), "excluded").otherwise("train").alias("partition"))
    return C.dataset_counts(C.frozen_partition(p, m, "id"), ["part"])


def time_split_cohorts(spark, d):
    return C.time_split(pairs(spark, d), "yr", CUTOFF, ["u", "ck"]).select("id", "part")


def chronological_boundary(spark, d):
    early = pairs(spark, d).filter(F.col("yr") <= CUTOFF)
    named = [("every_pair", early), ("both_class_proteins", C.both_roles(early, "u")), ("both_class_ligands", C.both_roles(early, "k"))]
    rows = [x.select("yr", "y").withColumn("dataset", F.lit(n)) for n, x in named]
    return C.chronological_boundary(rows[0].unionByName(rows[1]).unionByName(rows[2]), "yr", "y", ["dataset"])


def training_weights(spark, d):
    return rounded(C.training_weights(pairs(spark, d), "u", "y").select("id", "weight"), "weight")


def family_components(spark, d):
    p = pairs(spark, d)
    g = related_groups(p, F.col("id"), [F.col("fam"), F.col("u")])
    return g.select(F.col("row_id").alias("id"), F.expr("substr(group_label, 3)").alias("component"))


def novelty_flags(spark, d):
    r = scored(spark, d).select("id", "u", "ck")
    p = pairs(spark, d).select("u", "ck")
    return I.novelty(r, p, "u", "ck", "ck").drop("u", "ck")


def exact_pair_anti(spark, d):
    return scored(spark, d).select("id", "u", "ck").join(pairs(spark, d).select("u", "ck").distinct(), ["u", "ck"], "left_anti").select("id")


def blocked_pairs_semi(spark, d):
    return scored(spark, d).select("id", "u", "ck").join(pairs(spark, d).select("u", "ck").distinct(), ["u", "ck"], "left_semi").select("id")


def _sources(spark, d):
    s = table(spark, d, "source_records").withColumn("uniprot", clean_key(F.col("uniprot")))
    return I.resolved(s)


def integrate_pairs(spark, d):
    return I.integrate(_sources(spark, d).filter("resolved"))[0]


def label_conflicts(spark, d):
    return I.integrate(_sources(spark, d).filter("resolved"))[1]


def unresolved_records(spark, d):
    return _sources(spark, d).filter("NOT resolved").select("source", "source_record_id").distinct()


def shared_finite_rows(spark, d):
    r = table(spark, d, "ranking_condition").select(F.col("ood_row_id").alias("id"), "model_score", "logp", "tpsa").distinct()
    return I.finite_in_all(r, ["model_score", "logp", "tpsa"]).select("id")


def ensemble_seeds(spark, d):
    r = scored(spark, d).filter("model IN ('ligand', 'protein', 'c2')").select("id", "u", "model", "s")
    x = r.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("score", F.col("s") / 1000 + F.col("seed") * F.lit(1e-4))
    e = I.ensemble(x, ["id", "model"], "seed", "score", ["u"])
    e = I.average_identical_inputs(e, F.col("model") == "protein", ["model", "u"])
    return rounded(e, "score", "seed_sd")


def explicit_booleans(spark, d):
    r = table(spark, d, "ranking_condition").select(F.col("ood_row_id").alias("id"), strict_bool(F.col("has_allosteric_text")).alias("b")).distinct()
    return r.groupBy("b").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        both_class_proteins, both_class_ligands, both_class_fixpoint, cohort_counts, early_cohorts, fixpoint_history, temporal_counts, temporal_rows, partition_random, partition_family, partition_ligand,
        partition_double_held_out, partition_scaffold, partition_overlaps, leave_one_family_out, frozen_partition, time_split_cohorts,
        chronological_boundary, training_weights, family_components, novelty_flags, exact_pair_anti, blocked_pairs_semi, integrate_pairs,
        label_conflicts, unresolved_records, shared_finite_rows, ensemble_seeds, explicit_booleans,
    )
}

W = f"WITH {PAIRS}"


def _both(src: str, key: str) -> str:
    return f"SELECT * FROM {src} WHERE {key} IN (SELECT {key} FROM {src} GROUP BY {key} HAVING min(y) <> max(y))"


def _fix(a: str, b: str, src: str = "(SELECT * FROM p WHERE e = 1)", rounds: int = 24) -> str:
    steps = [f"f0 AS MATERIALIZED (SELECT * FROM {src})"]
    for i in range(rounds):
        steps.append(f"g{i} AS MATERIALIZED ({_both(f'f{i}', a)})")
        steps.append(f"f{i + 1} AS MATERIALIZED ({_both(f'g{i}', b)})")
    return ", ".join(steps)


def _fold(col: str) -> str:
    return f"""a AS (SELECT *, CASE WHEN NOT coalesce({col} IN (0, 1), false) THEN 'train' WHEN {col} = 0 AND e = 1 THEN 'test' WHEN {col} = 1 AND e = 1 THEN 'validation' END AS part FROM p),
q AS (SELECT * FROM a WHERE part IS NOT NULL)"""


PURGED = f"""{_fold('ff')}, tk AS (SELECT DISTINCT ck FROM q WHERE part = 'test' AND ck IS NOT NULL),
v AS (SELECT * FROM q WHERE part = 'validation' AND NOT coalesce(ck IN (SELECT ck FROM tk), false)),
bk AS (SELECT ck FROM tk UNION SELECT ck FROM v WHERE ck IS NOT NULL),
z AS (SELECT * FROM q WHERE part = 'test' UNION ALL SELECT * FROM v UNION ALL SELECT * FROM q WHERE part = 'train' AND NOT coalesce(ck IN (SELECT ck FROM bk), false))"""
SETS = """sx AS (SELECT id, part, unnest(CAST(from_json(sc, '["VARCHAR"]') AS VARCHAR[])) AS m FROM z WHERE sc IS NOT NULL),
tm AS (SELECT DISTINCT m FROM sx WHERE part = 'test' AND m <> ''),
vv AS (SELECT * FROM z WHERE part = 'validation' AND id NOT IN (SELECT id FROM sx WHERE m IN (SELECT m FROM tm))),
bm AS (SELECT m FROM tm UNION SELECT m FROM sx WHERE m <> '' AND id IN (SELECT id FROM vv))"""
RESOLVED = """s AS (SELECT *, nullif(nullif(upper(trim(uniprot)), ''), 'NA') AS u, coalesce(regexp_full_match(full_inchikey, '[A-Z]{14}-[A-Z]{10}-[A-Z]')
  AND nullif(nullif(upper(trim(uniprot)), ''), 'NA') IS NOT NULL AND canonical_smiles IS NOT NULL AND binary_label IN (0, 1), false) AS ok FROM source_records),
rows AS (SELECT DISTINCT source, source_record_id, u, full_inchikey AS k, canonical_smiles AS c, binary_label AS y FROM s WHERE ok)"""


def _bound(name: str, src: str) -> str:
    return f"""SELECT '{name}' AS dataset, arg_min(yr, [d, -yr]) AS boundary FROM (SELECT yr, abs((al - tr) / CAST(al AS DOUBLE) - 0.2) AS d FROM (
  SELECT yr, sum(n) OVER w AS tr, sum(q) OVER w AS tp, sum(n) OVER () AS al, sum(q) OVER () AS ap FROM (SELECT yr, count(*) AS n, sum(y) AS q FROM {src} GROUP BY yr) WINDOW w AS (ORDER BY yr))
  WHERE tr >= 10 AND al - tr >= 6 AND tp > 0 AND tp < tr AND ap - tp > 0 AND ap - tp < al - tr)"""


def _counts(name: str, src: str) -> str:
    return f"SELECT '{name}' AS dataset, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, count(DISTINCT u) AS n_a, count(DISTINCT k) AS n_b FROM ({src})"


COHORTS = (("every_pair", "x"), ("both_class_proteins", "x1"), ("both_class_ligands", "x2"), ("both_class_proteins_ligands", "f24"))
EARLY = f"{W}, x AS (SELECT * FROM p WHERE yr <= {CUTOFF}), x1 AS ({_both('x', 'u')}), x2 AS ({_both('x', 'k')}), x3 AS ({_both('x1', 'k')}), {_fix('u', 'k', 'x3')}"
BOUNDS = "bd AS (" + " UNION ALL ".join(_bound(n, t) for n, t in COHORTS) + "), m AS (" + " UNION ALL ".join(
    f"SELECT x.*, bd.dataset, boundary, CASE WHEN yr <= boundary THEN 'train' ELSE 'validation' END AS part FROM {t} x JOIN bd ON bd.dataset = '{n}'" for n, t in COHORTS
) + ")"

SQL = {
    "both_class_proteins": f"{W} SELECT id, u FROM ({_both('p', 'u')})",
    "both_class_ligands": f"{W} SELECT id, k FROM ({_both('p', 'k')})",
    "both_class_fixpoint": f"{W}, {_fix('u', 'k')} SELECT id FROM f24",
    "cohort_counts": f"{W}, {_fix('u', 'k')} " + " UNION ALL ".join([_counts("every_pair", "SELECT * FROM p"), _counts("both_class_proteins", "SELECT * FROM p WHERE e = 1"), _counts("both_class_ligands", _both("p", "k")), _counts("both_class_proteins_ligands", "SELECT * FROM f24") + " HAVING count(*) > 0"]),
    "early_cohorts": f"{EARLY} SELECT * FROM (" + " UNION ALL ".join(_counts(n, f"SELECT * FROM {t}") for n, t in COHORTS) + ") WHERE rows > 0",
    # the round that changes nothing is counted, as its rows say that the last one was the last
    "fixpoint_history": f"{EARLY}, n AS (" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS iteration, count(*) AS rows FROM f{i}" for i in range(25))
    + ") SELECT iteration, rows FROM (SELECT *, lag(rows, 2) OVER (ORDER BY iteration) AS p2, lag(rows) OVER (ORDER BY iteration) AS p1 FROM n) WHERE p2 IS NULL OR p2 <> p1",
    "temporal_counts": f"{EARLY}, {BOUNDS}, q AS (SELECT * FROM m UNION ALL BY NAME SELECT * REPLACE ('refit' AS part) FROM m) SELECT dataset, part, boundary, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, count(DISTINCT u) AS n_a, count(DISTINCT k) AS n_b FROM q GROUP BY ALL",
    "temporal_rows": f"{EARLY}, {BOUNDS} SELECT id, dataset, part FROM m UNION ALL SELECT id, 'later', CASE WHEN yr IS NULL THEN 'unknown' WHEN EXISTS (SELECT 1 FROM p q WHERE q.yr <= {CUTOFF} AND q.u = p.u AND q.ck = p.ck) THEN 'removed' ELSE 'test' END FROM p WHERE yr IS NULL OR yr > {CUTOFF}",
    "partition_random": f"{W}, {_fold('rf')} SELECT id, part FROM q",
    "partition_family": f"{W}, {_fold('ff')} SELECT id, part FROM q",
    "partition_ligand": f"{W}, {_fold('lf')} SELECT id, part FROM q",
    "partition_double_held_out": f"{W}, {PURGED} SELECT id, part FROM z",
    "partition_scaffold": f"{W}, {PURGED}, {SETS} SELECT id, part FROM z WHERE part = 'test' UNION ALL SELECT id, part FROM vv UNION ALL SELECT id, part FROM z WHERE part = 'train' AND id NOT IN (SELECT id FROM sx WHERE m IN (SELECT m FROM bm))",
    "partition_overlaps": f"{W}, {_fold('rf')} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM q WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(DISTINCT part) > 1" for c in ("id", "ck", "fam")),
    "leave_one_family_out": f"{W}, t AS (SELECT * FROM p WHERE fam = {FAMILY_SQL}) SELECT id, 'test' AS part FROM t UNION ALL SELECT id, 'train' FROM p WHERE id NOT IN (SELECT id FROM t) AND NOT coalesce(ck IN (SELECT ck FROM t WHERE ck IS NOT NULL), false)",
    "frozen_partition": f"{W} SELECT part, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, count(DISTINCT u) AS n_a, count(DISTINCT k) AS n_b FROM (SELECT *, CASE rf WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS part FROM p WHERE rf IS NOT NULL) GROUP BY part",
    "time_split_cohorts": f"{W} SELECT id, CASE WHEN yr IS NULL THEN 'unknown' WHEN yr <= {CUTOFF} THEN 'early' WHEN EXISTS (SELECT 1 FROM p q WHERE q.yr <= {CUTOFF} AND q.u = p.u AND q.ck = p.ck) THEN 'removed' ELSE 'future' END AS part FROM p",
    "chronological_boundary": f"{W}, x AS (SELECT * FROM p WHERE yr <= {CUTOFF}), x1 AS ({_both('x', 'u')}), x2 AS ({_both('x', 'k')}) SELECT * FROM ("
    + " UNION ALL ".join([_bound("every_pair", "x"), _bound("both_class_proteins", "x1"), _bound("both_class_ligands", "x2")]) + ") WHERE boundary IS NOT NULL",
    "training_weights": f"{W} SELECT id, round(tot / CAST(labels AS DOUBLE) / g / c, 9) AS weight FROM (SELECT id, u, y, count(*) OVER (PARTITION BY u, y) AS c, count(*) OVER () AS tot FROM p) JOIN (SELECT y, count(DISTINCT u) AS g FROM p GROUP BY y) USING (y), (SELECT count(DISTINCT y) AS labels FROM p)",
    "family_components": f"""WITH RECURSIVE {PAIRS}, e AS (SELECT DISTINCT p.u, f.m FROM p JOIN (SELECT u, min(fam) AS m FROM p GROUP BY u) f ON f.u = p.u),
l AS (SELECT DISTINCT p.fam AS a, e.m AS b FROM p JOIN e ON e.u = p.u UNION SELECT e.m, p.fam FROM p JOIN e ON e.u = p.u),
w AS (SELECT DISTINCT fam AS n, fam AS r FROM p UNION SELECT w.n, l.b FROM w JOIN l ON l.a = w.r)
SELECT p.id, min(w.r) AS component FROM p JOIN w ON w.n = p.fam GROUP BY p.id""",
    "novelty_flags": f"WITH {PAIRS}, {SCORED}, x AS (SELECT id, coalesce((u, ck) IN (SELECT (u, ck) FROM p WHERE u IS NOT NULL AND ck IS NOT NULL), false) AND ck IS NOT NULL AS a, u IN (SELECT u FROM p WHERE u IS NOT NULL) AS b, coalesce(ck IN (SELECT ck FROM p WHERE ck IS NOT NULL), false) AS c FROM r) SELECT id, a AS training_pair, NOT b AS a_unseen, NOT c AS b_unseen, NOT b AND NOT c AS both_unseen FROM x",
    "exact_pair_anti": f"WITH {PAIRS}, {SCORED} SELECT id FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.u = r.u AND p.ck = r.ck)",
    "blocked_pairs_semi": f"WITH {PAIRS}, {SCORED} SELECT id FROM r WHERE EXISTS (SELECT 1 FROM p WHERE p.u = r.u AND p.ck = r.ck)",
    "integrate_pairs": f"""WITH {RESOLVED} SELECT 'PAIR_' || substr(sha256(u || chr(124) || k), 1, 20) AS main_row_id, u AS uniprot, k AS full_inchikey, substr(k, 1, 14) AS connectivity_key,
  min(y) AS binary_label, arg_min(c, [CAST(length(c) AS VARCHAR).lpad(9, '0'), c]) AS canonical_smiles, array_to_string(list_sort(list(DISTINCT source)), ';') AS sources, count(*) AS source_records
  FROM rows GROUP BY u, k HAVING min(y) = max(y)""",
    "label_conflicts": f"WITH {RESOLVED} SELECT u AS uniprot, k AS full_inchikey, count(*) AS source_records, CAST(sum(y) AS BIGINT) AS positives, array_to_string(list_sort(list(DISTINCT source)), ';') AS sources FROM rows GROUP BY u, k HAVING min(y) <> max(y)",
    "unresolved_records": f"WITH {RESOLVED} SELECT DISTINCT source, source_record_id FROM s WHERE NOT ok",
    "shared_finite_rows": "SELECT DISTINCT ood_row_id AS id FROM ranking_condition WHERE " + " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c})" for c in ("model_score", "logp", "tpsa")),
    "ensemble_seeds": f"""WITH {SCORED}, x AS (SELECT id, u, model, s / 1000 + k * CAST(1e-4 AS DOUBLE) AS v FROM r, (VALUES (1), (2), (3)) t(k) WHERE model IN ('ligand', 'protein', 'c2')),
e AS (SELECT id, model, u, avg(v) AS score, stddev_samp(v) AS sd FROM x GROUP BY id, model, u)
SELECT id, model, u, round(CASE WHEN model = 'protein' THEN avg(score) OVER (PARTITION BY model, u) ELSE score END, 9) AS score, round(sd, 9) AS seed_sd FROM e""",
    "explicit_booleans": "SELECT lower(has_allosteric_text) IN ('true', '1') AS b, count(DISTINCT ood_row_id) AS n FROM ranking_condition GROUP BY 1",
}
