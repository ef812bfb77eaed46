"""Queries of the training-data operators, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import capping, cutoffs, leakage, mojibake, packing, splits, topn
from pairloom.operators.keys import clean_key
from pairloom.session import table, written

TOP = 10
CAP = 150
CAP_SHARED = 4
FRACTION = (1, 5)
MIN_SCORED = 20

PROTEIN = lambda: clean_key(F.col("uniprot"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_top_rows(spark, d).select(F.col("item_id").alias("ood_row_id"))


def p1_top_rows(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "ranking_condition")
    return topn.top_n(r, PROTEIN(), F.col("model_score"), F.col("ood_row_id"), TOP)


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs")
    return splits.grouped_splits(p, F.col("main_row_id"), [PROTEIN(), F.col("connectivity_key")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    g = p2_splits(spark, d)
    protein = F.when(F.col("group_label").startswith("0:"), F.expr("substr(group_label, 3)"))
    return g.select(F.col("row_id").alias("main_row_id"), protein.alias("group_uniprot"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.report(written(p2_splits(spark, d), "splits"))


def p3_capped(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "ranking_condition")
    return capping.cap_contributors(r, F.array(PROTEIN()), F.col("model_score"), F.col("ood_row_id"), max_records=CAP)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_capped(spark, d).filter("NOT kept").select(F.col("item_id").alias("ood_row_id"))


def _shared(spark: SparkSession, d: str) -> tuple[DataFrame, tuple]:
    r = table(spark, d, "ranking_condition")
    return r, (F.array(PROTEIN(), F.col("connectivity_key")), F.col("model_score"), F.col("ood_row_id"), CAP_SHARED)


def p3_shared(spark: SparkSession, d: str) -> DataFrame:
    """Each row counts for its protein and for its compound."""
    r, args = _shared(spark, d)
    return capping.cap_contributors(r, *args)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    r, args = _shared(spark, d)
    return capping.report(r, *args, written(p3_shared(spark, d), "shared"))


def p4_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "ranking_condition")
    c, _ = cutoffs.keep_fraction(r, PROTEIN(), F.col("model_score"), F.col("ood_row_id"), FRACTION, MIN_SCORED)
    return c.select(F.col("g").alias("protein"), "n", "k", "cutoff", "kept")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "ranking_condition")
    _, kept = cutoffs.keep_fraction(r, PROTEIN(), F.col("model_score"), F.col("ood_row_id"), FRACTION, MIN_SCORED)
    return kept.select(F.col("item_id").alias("ood_row_id"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), F.col("doc_id"), F.col("text"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.report(docs, F.col("doc_id"), F.col("text"), written(p6_packed(spark, d), "packed"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return leakage.leaks(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), F.col("source"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), F.col("source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_top_rows, p2_found, p2_splits, p2_report, p3_found, p3_capped, p3_shared, p3_report, p4_found, p4_cutoffs,
                  p6_packed, p6_report, p7_found, p8_found, p8_restored)
    }


SCORED = """WITH x AS (SELECT DISTINCT ood_row_id, upper(trim(uniprot)) AS p, model_score AS s FROM ranking_condition),
scored AS (SELECT * FROM x WHERE p <> '' AND p <> 'NA' AND s IS NOT NULL AND NOT isnan(s) AND NOT isinf(s)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s DESC, ood_row_id) AS place,
  count(*) OVER (PARTITION BY p) AS n FROM scored)
"""
CUTOFFS = (
    SCORED
    + f""", cut AS (SELECT p, n, (n + 4) // 5 AS k, min(s) AS cutoff FROM ranked WHERE n >= {MIN_SCORED} AND place <= (n + 4) // 5 GROUP BY p, n)
"""
)
GROUPS = """WITH RECURSIVE r AS (SELECT DISTINCT main_row_id, upper(trim(uniprot)) AS p, connectivity_key AS k FROM pairs),
s AS (SELECT DISTINCT p, m FROM r JOIN (SELECT k, min(p) AS m FROM r GROUP BY k) USING (k)),
e AS (SELECT p AS a, m AS b FROM s UNION SELECT m, p FROM s),
walk AS (SELECT DISTINCT p AS node, p AS reach FROM r UNION SELECT w.node, e.b FROM walk w JOIN e ON e.a = w.reach)
SELECT r.main_row_id, min(w.reach) AS group_uniprot FROM r JOIN walk w ON w.node = r.p GROUP BY r.main_row_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": SCORED + f"SELECT ood_row_id FROM ranked WHERE place <= {TOP}",
        "p1_top_rows": SCORED + f"SELECT p AS group_key, ood_row_id AS item_id, s AS score, place FROM ranked WHERE place <= {TOP}",
        "p2_found": GROUPS,
        "p2_report": """SELECT 'rows' AS measure, count(DISTINCT main_row_id) AS value FROM pairs
UNION ALL SELECT m, CAST(0 AS BIGINT) FROM (VALUES ('torn'), ('off')) v(m)""",
        "p3_report": """SELECT count(*) AS records, CAST(0 AS BIGINT) AS wrong FROM (SELECT DISTINCT ood_row_id FROM ranking_condition
WHERE model_score IS NOT NULL AND NOT isnan(model_score) AND NOT isinf(model_score) AND (connectivity_key IS NOT NULL OR upper(trim(uniprot)) NOT IN ('', 'NA')))""",
        "p3_found": SCORED + f"SELECT ood_row_id FROM ranked WHERE place > {CAP}",
        "p3_capped": SCORED + f"SELECT ood_row_id AS item_id, place <= {CAP} AS kept FROM ranked",
        "p4_cutoffs": CUTOFFS
        + "SELECT p AS protein, cut.n, cut.k, cutoff, count(*) AS kept FROM ranked JOIN cut USING (p) WHERE s >= cutoff GROUP BY p, cut.n, cut.k, cutoff",
        "p6_report": """SELECT 'texts' AS measure, count(DISTINCT doc_id) AS value FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\x0b\\f\\r]')
UNION ALL SELECT m, CAST(0 AS BIGINT) FROM (VALUES ('missing'), ('cut'), ('overfull'), ('wrong'), ('loose'), ('uneven')) v(m)""",
        "p4_found": CUTOFFS + "SELECT ood_row_id FROM ranked JOIN cut USING (p) WHERE s >= cutoff",
    }
