"""Queries that write and read back tables, and data contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.booleans import stars
from pairloom.operators import checks
from pairloom.plans.base import PAIRS, SCORED, pairs, scored
from pairloom.session import scratch_root, table
from pairloom.sources import tables as S

PAIR_TYPES = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("u", T.StringType()), ("k", T.StringType()), ("y", T.IntegerType()), ("yr", T.IntegerType()))])
SCORE_TYPES = T.StructType([T.StructField("id", T.StringType()), T.StructField("s", T.DoubleType()), T.StructField("logp", T.DoubleType())])


def _new(spark, name):
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def tsv_round_trip(spark, d):
    path = _new(spark, "pairs")
    S.write_tsv(pairs(spark, d, "u", "k", "y", "yr"), path)
    return S.read_tsv(spark, path, PAIR_TYPES)


def tsv_round_trip_floats(spark, d):
    """Doubles come back as they were."""
    path = _new(spark, "scores")
    S.write_tsv(scored(spark, d, "s", "logp"), path, compression="none")
    return S.read_tsv(spark, path, SCORE_TYPES)


def tsv_union(spark, d):
    """Two files, the second without a column."""
    a, b = _new(spark, "a"), _new(spark, "b")
    p = pairs(spark, d, "u", "k", "y", "yr")
    S.write_tsv(p.filter("yr <= 2010"), a)
    S.write_tsv(p.filter("yr > 2010").drop("y"), b)
    less = T.StructType([f for f in PAIR_TYPES.fields if f.name != "y"])
    return S.read_many(spark, [a, b], [PAIR_TYPES, less])


def cohort_files(spark, d):
    """One folder per cohort; an existing folder is refused."""
    path = _new(spark, "cohorts")
    rows = scored(spark, d, "cohort", "s")
    S.write_tsv(rows, path, partition_by=["cohort"])
    try:
        S.write_tsv(rows, path)
        refused = False
    except Exception:  # noqa: BLE001 - Spark's error for an existing path
        refused = True
    back = spark.read.csv(path, sep="\t", header=True)
    return back.groupBy("cohort").agg(F.count("*").alias("rows"), F.lit(refused).alias("refused"))


def json_round_trip(spark, d):
    path = _new(spark, "json")
    S.write_json(pairs(spark, d, "u", "k", "y", "yr"), path)
    return spark.read.schema(PAIR_TYPES).json(path)


def contract_counts(spark, d):
    r = table(spark, d, "ranking_condition")
    s = F.col("model_score")
    return checks.contract_counts(r, {"finite_score": s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")), "known_key": F.col("connectivity_key").isNotNull(), "weight_in_range": F.col("mw").between(150, 750)})


def repeated_rows(spark, d):
    return checks.duplicates(table(spark, d, "ranking_condition").select(F.col("ood_row_id").alias("id")), ["id"])


def different_rows(spark, d):
    p = pairs(spark, d, "u", "yr")
    return checks.same_rows(p.filter("yr >= 2005"), p.filter("yr <= 2015")).select("id", "side")


def varying_labels(spark, d):
    return checks.inconsistent(pairs(spark, d, "k", "y", "yr"), ["k"], ["y", "yr"])


def path_safety(spark, d):
    p = table(spark, d, "pairs").select(F.col("ligand_embedding_path").alias("path")).distinct()
    x = p.select(F.explode(F.array("path", F.concat(F.lit("/"), "path"), F.concat(F.lit("../"), "path"), F.concat(F.lit("a/../"), "path"), F.concat("path", F.lit("..x")))).alias("path")).filter("path IS NOT NULL")
    return x.select("path", checks.safe_relative_path(F.col("path")).alias("safe"))


def significance(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", stars(F.pow(F.abs("s_acctbal") / 20000, F.lit(3.0))).alias("stars"))


QUERIES = {f.__name__: f for f in (tsv_round_trip, tsv_round_trip_floats, tsv_union, cohort_files, json_round_trip, contract_counts, repeated_rows, different_rows, varying_labels, path_safety, significance)}

W = f"WITH {PAIRS}, {SCORED}"
SQL = {
    "tsv_round_trip": f"{W} SELECT id, u, k, y, yr FROM p",
    "tsv_round_trip_floats": f"{W} SELECT id, s, logp FROM r",
    "tsv_union": f"{W} SELECT id, u, k, CASE WHEN yr <= 2010 THEN y END AS y, yr FROM p WHERE yr IS NOT NULL",
    "cohort_files": f"{W} SELECT cohort, count(*) AS rows, true AS refused FROM r GROUP BY cohort",
    "json_round_trip": f"{W} SELECT id, u, k, y, yr FROM p",
    "contract_counts": "SELECT count(*) FILTER (WHERE NOT coalesce(model_score IS NOT NULL AND NOT isnan(model_score) AND NOT isinf(model_score), false)) AS finite_score, count(*) FILTER (WHERE connectivity_key IS NULL) AS known_key, count(*) FILTER (WHERE NOT coalesce(mw BETWEEN 150 AND 750, false)) AS weight_in_range FROM ranking_condition",
    "repeated_rows": "SELECT ood_row_id AS id, count(*) AS copies FROM ranking_condition GROUP BY 1 HAVING count(*) > 1",
    "different_rows": f"{W} SELECT id, CASE WHEN yr > 2015 THEN 'left' ELSE 'right' END AS side FROM p WHERE yr > 2015 OR yr < 2005",
    "varying_labels": f"{W} SELECT k FROM p GROUP BY k HAVING min(y) <> max(y) OR min(yr) <> max(yr) OR count(y) < count(*) OR count(yr) < count(*)",
    "path_safety": "WITH p AS (SELECT DISTINCT ligand_embedding_path AS f FROM pairs WHERE ligand_embedding_path IS NOT NULL) SELECT CASE k WHEN 0 THEN f WHEN 1 THEN '/' || f WHEN 2 THEN '../' || f WHEN 3 THEN 'a/../' || f ELSE f || '..x' END AS path, k IN (0, 4) AS safe FROM p, range(0, 5) t(k)",
    "significance": "SELECT s_suppkey, CASE WHEN p < 1e-3 THEN '***' WHEN p < 1e-2 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM (SELECT s_suppkey, pow(abs(s_acctbal) / 20000, 3) AS p FROM supplier)",
}
