"""Cleaned base tables of the queries, and the SQL of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.booleans import strict_bool
from pairloom.operators.keys import clean_key, finite
from pairloom.session import table, written


def pairs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row per main_row_id: late copies and spellings of the protein fall together.

    With ``cols``, only these columns (and the id) are read and compared.
    """
    p = table(spark, d, "pairs").select(
        F.col("main_row_id").alias("id"), clean_key(F.col("uniprot")).alias("u"), F.col("full_inchikey").alias("k"),
        F.col("connectivity_key").alias("ck"), F.col("binary_label").alias("y"), F.col("family_component_id").alias("fam"),
        F.col("matrix_row_fold").alias("rf"), F.col("matrix_family_fold").alias("ff"), F.col("matrix_ligand_fold").alias("lf"),
        F.col("matrix_evaluation_eligible").alias("e"), F.col("murcko_scaffolds_json").alias("sc"), F.col("role_year").alias("yr"),
    )
    return (p.select("id", *cols) if cols else p).distinct()


PAIRS = """p AS (SELECT DISTINCT main_row_id AS id, nullif(nullif(upper(trim(uniprot)), ''), 'NA') AS u, full_inchikey AS k,
  connectivity_key AS ck, binary_label AS y, family_component_id AS fam, matrix_row_fold AS rf, matrix_family_fold AS ff,
  matrix_ligand_fold AS lf, matrix_evaluation_eligible AS e, murcko_scaffolds_json AS sc, role_year AS yr FROM pairs)"""


def scored(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Distinct scored rows of the screen; ``y`` says whether the text names an allosteric role.

    With ``cols``, only these columns (and the id) are read and compared, and the rows are written
    once, as sampling, sorting and joining back each read them.
    """
    r = table(spark, d, "ranking_condition")
    r = r.select(
        F.col("ood_row_id").alias("id"), clean_key(F.col("uniprot")).alias("u"), F.col("connectivity_key").alias("ck"),
        finite(F.col("model_score")).alias("s"), F.col("logp"), F.col("mw"), F.col("tpsa"), F.col("cohort"), F.col("model_name").alias("model"),
        strict_bool(F.col("has_allosteric_text")).cast("int").alias("y"), F.col("ligand_chembl_id").alias("lig"),
        strict_bool(F.col("has_orthosteric_text")).cast("int").alias("o"),
    ).filter("u IS NOT NULL AND s IS NOT NULL")
    return written(r.select("id", *cols).distinct(), "scored") if cols else r.distinct()


SCORED = """r AS (SELECT DISTINCT ood_row_id AS id, nullif(nullif(upper(trim(uniprot)), ''), 'NA') AS u, connectivity_key AS ck,
  model_score AS s, logp, mw, tpsa, cohort, model_name AS model, CAST(lower(has_allosteric_text) IN ('true', '1') AS INT) AS y,
  ligand_chembl_id AS lig, CAST(lower(has_orthosteric_text) IN ('true', '1') AS INT) AS o
  FROM ranking_condition WHERE model_score IS NOT NULL AND NOT isnan(model_score) AND NOT isinf(model_score)
  AND upper(trim(uniprot)) NOT IN ('', 'NA'))"""


def rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})
