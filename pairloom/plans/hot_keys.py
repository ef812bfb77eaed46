"""Queries on keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.hotkeys import dominant_keys, matches_between, salted_profile
from pairloom.operators.keys import clean_key
from pairloom.session import table, written


def _profiles(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k = clean_key(F.col("uniprot"))
    r, p = table(spark, d, "ranking_condition"), table(spark, d, "pairs")
    return {
        "ranking_condition": salted_profile(r, k, F.col("ood_row_id"), F.col("connectivity_key"), F.col("model_score")),
        "pairs": salted_profile(p, k, F.col("main_row_id"), F.col("connectivity_key")),
    }


def _all(spark: SparkSession, d: str) -> DataFrame:
    parts = [f.withColumn("table_name", F.lit(n)) for n, f in _profiles(spark, d).items()]
    return written(parts[0].unionByName(parts[1]), "profiles")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    every = _all(spark, d)
    out = [dominant_keys(every.filter(F.col("table_name") == n)).select(F.lit(n).alias("table_name"), F.col("k").alias("uniprot")) for n in ("ranking_condition", "pairs")]
    return out[0].unionByName(out[1])


def p5_profiles(spark: SparkSession, d: str) -> DataFrame:
    k = clean_key(F.col("uniprot"))
    r, p = table(spark, d, "ranking_condition"), table(spark, d, "pairs")
    both = matches_between(
        r, p, (k, F.col("connectivity_key"), F.col("ood_row_id")), (k, F.col("connectivity_key"), F.col("main_row_id"))
    )
    return (
        _all(spark, d).filter("k IS NOT NULL").join(both, "k", "left")
        .select(
            "table_name", F.col("k").alias("uniprot"), "n_rows", "n_items", "best_row", "best_score",
            F.coalesce("n_matched_items", F.lit(0)).alias("n_matched_items"),
            F.coalesce("n_matched_rows", F.lit(0)).alias("n_matched_rows"),
        )
    )


QUERIES = {"p5_found": p5_found, "p5_profiles": p5_profiles}

_BASE = """WITH r0 AS (SELECT ood_row_id AS r, nullif(nullif(upper(trim(uniprot)), ''), 'NA') AS k, connectivity_key AS i,
  CASE WHEN NOT isnan(model_score) AND NOT isinf(model_score) THEN model_score END AS s FROM ranking_condition),
p0 AS (SELECT main_row_id AS r, nullif(nullif(upper(trim(uniprot)), ''), 'NA') AS k, connectivity_key AS i FROM pairs),
"""
SQL = {
    "p5_found": _BASE
    + """t AS (SELECT 'ranking_condition' AS table_name, k, count(DISTINCT r) AS n FROM r0 GROUP BY k
  UNION ALL SELECT 'pairs', k, count(DISTINCT r) FROM p0 GROUP BY k),
a AS (SELECT *, sum(n) OVER (PARTITION BY table_name) AS total FROM t)
SELECT table_name, k AS uniprot FROM a WHERE k IS NOT NULL AND n * 100 >= total * 3""",
    "p5_profiles": _BASE
    + """u AS (SELECT DISTINCT 'ranking_condition' AS t, r, k, s FROM r0 WHERE k IS NOT NULL
  UNION ALL SELECT DISTINCT 'pairs', r, k, CAST(NULL AS DOUBLE) FROM p0 WHERE k IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY t, k ORDER BY s DESC NULLS LAST, r) AS o FROM u),
x AS (SELECT t, k, count(*) AS n_rows, min(CASE WHEN o = 1 AND s IS NOT NULL THEN r END) AS best_row, max(s) AS best_score FROM b GROUP BY t, k),
y AS (SELECT 'ranking_condition' AS t, k, count(DISTINCT i) AS n_items FROM r0 GROUP BY k UNION ALL SELECT 'pairs', k, count(DISTINCT i) FROM p0 GROUP BY k),
m1 AS (SELECT k, i, count(DISTINCT r) AS n FROM r0 WHERE k IS NOT NULL AND i IS NOT NULL GROUP BY k, i),
m2 AS (SELECT k, i, count(DISTINCT r) AS n FROM p0 WHERE k IS NOT NULL AND i IS NOT NULL GROUP BY k, i),
m AS (SELECT k, CAST(count(*) AS BIGINT) AS a, CAST(sum(m1.n * m2.n) AS BIGINT) AS b FROM m1 JOIN m2 USING (k, i) GROUP BY k)
SELECT x.t AS table_name, x.k AS uniprot, n_rows, n_items, best_row, best_score, coalesce(a, 0) AS n_matched_items, coalesce(b, 0) AS n_matched_rows
FROM x JOIN y ON x.t = y.t AND x.k = y.k LEFT JOIN m ON x.k = m.k""",
}
