"""Queries on ranks, top-k, classification metrics and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import enrich, metrics, ranks
from pairloom.plans.base import SCORED, rounded, scored



def average_rank(spark, d):
    return rounded(ranks.ranked(scored(spark, d, "u", "s"), ["u"], F.col("s")).select("id", "u", "rank"), "rank")


def global_rank_fraction(spark, d):
    return rounded(ranks.rank_fraction(scored(spark, d, "s"), [], F.col("s")).select("id", "rank", "fraction"), "fraction", "rank")


def rank_fraction(spark, d):
    return rounded(ranks.rank_fraction(scored(spark, d, "u", "s"), ["u"], F.col("s")).select("id", "fraction"), "fraction")


def percentile_rank(spark, d):
    return rounded(ranks.percentile_rank(scored(spark, d, "u", "s"), ["u"], F.col("s")).select("id", "pct"), "pct")


def topk_deterministic(spark, d):
    return ranks.top_fraction(scored(spark, d, "u", "s"), ["u"], F.col("s"), F.col("id"), 0.01).select("id", "u", "place")


def topk_pooled(spark, d):
    return ranks.top_fraction(scored(spark, d, "s"), [], F.col("s"), F.col("id"), 0.001).select("id", "place")


def topk_fractional(spark, d):
    return rounded(ranks.fractional_top(scored(spark, d, "u", "s"), ["u"], F.col("s"), 0.05).filter("weight > 0").select("id", "weight"), "weight")


def best_per_key(spark, d):
    return ranks.best_per_key(scored(spark, d, "u", "ck", "s").filter("ck IS NOT NULL").select("u", "ck", "s", "id"), ["u", "ck"], F.col("s"), "id").select("u", "ck", "id", "s")


def pooled_binary_metrics(spark, d):
    m = metrics.binary_metrics(scored(spark, d, "cohort", "model", "y", "s"), ["cohort", "model"], F.col("y"), F.col("s"))
    return rounded(m, "auroc", "ap_pos", "ap_neg", "ap_symmetric")


def conditional_auroc(spark, d):
    return rounded(metrics.conditional_auroc(scored(spark, d, "model", "u", "y", "s"), ["model"], ["u"], F.col("y"), F.col("s")), "auroc", "row_coverage")


def checkpoint_selection(spark, d):
    return rounded(metrics.checkpoint_selection(scored(spark, d, "cohort", "model", "u", "ck", "y", "s"), ["cohort", "model"], ["u", "ck"], F.col("y"), F.col("s")), "value")


def spearman_by_group(spark, d):
    return rounded(metrics.spearman(scored(spark, d, "u", "s", "logp"), ["u"], "s", "logp"), "rho", digits=8)


def top_choice_agreement(spark, d):
    x = scored(spark, d, "u", "s", "logp").filter("logp IS NOT NULL")
    return rounded(metrics.top_choice_agreement(x, ["u"], "s", "logp").filter("n >= 2"), "agreement")


def keyword_enrichment(spark, d):
    return rounded(enrich.keyword_enrichment(scored(spark, d, "u", "s", "y"), "u", "s", "id", "y", 0.01), "enrichment")


def ranking_recovery(spark, d):
    return rounded(enrich.recovery(scored(spark, d, "cohort", "model", "u", "s", "y", "o"), ["cohort", "model"], "u", "s", ["y", "o"], [0.01, 0.05]), "selected", "hits", "expected", "recall", "enrichment", digits=6)


QUERIES = {
    f.__name__: f
    for f in (
        average_rank, global_rank_fraction, rank_fraction, percentile_rank, topk_deterministic, topk_pooled, topk_fractional, best_per_key,
        pooled_binary_metrics, conditional_auroc, checkpoint_selection, spearman_by_group, top_choice_agreement, keyword_enrichment, ranking_recovery,
    )
}

W = f"WITH {SCORED} "


def _rank(part: str, order: str = "s DESC") -> str:
    over = f"PARTITION BY {part} " if part else ""
    peers = f"PARTITION BY {part}, s" if part else "PARTITION BY s"
    return f"rank() OVER ({over}ORDER BY {order}) + (count(*) OVER ({peers}) - 1) / 2.0"


def _auc(part: str, src: str = "r") -> str:
    return f"""t AS (SELECT {part}, s, count(*) AS n, sum(y) AS p FROM {src} GROUP BY {part}, s),
c AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(n) OVER (PARTITION BY {part}) AS tn, sum(p) OVER (PARTITION BY {part}) AS tp
  FROM t WINDOW w AS (PARTITION BY {part} ORDER BY s DESC)),
m AS (SELECT {part}, CAST(max(tn) AS BIGINT) AS n, CAST(max(tp) AS BIGINT) AS n_pos,
  sum(CASE WHEN tp > 0 AND tn > tp THEN p * ((tn - tp) - (cn - cp) + (n - p) / 2.0) END) / nullif(CAST(max(tp) * (max(tn) - max(tp)) AS DOUBLE), 0) AS auroc,
  sum(CASE WHEN tp > 0 AND tn > tp THEN p / tp * (cp / cn) END) AS ap_pos,
  sum(CASE WHEN tp > 0 AND tn > tp THEN (n - p) / (tn - tp) * (((tn - tp) - (cn - cp) + (n - p)) / (tn - cn + n)) END) AS ap_neg
  FROM c GROUP BY {part})"""


def _cond(outer: str, ident: str, name: str) -> str:
    both = f"{outer}, {ident}"
    return _auc(both, f"(SELECT * FROM r WHERE {ident} IS NOT NULL)").replace("t AS", f"t{name} AS").replace("FROM t ", f"FROM t{name} ").replace(
        "c AS (", f"c{name} AS ("
    ).replace("FROM c ", f"FROM c{name} ").replace("m AS (", f"m{name} AS (") + f""",
x{name} AS (SELECT {outer}, avg(auroc) AS auroc, CAST(coalesce(sum(n) FILTER (WHERE auroc IS NOT NULL), 0) AS BIGINT) AS n_rows_used,
  count(auroc) AS n_groups_used, count(*) - count(auroc) AS n_groups_skipped FROM m{name} GROUP BY {outer})"""


def _enrich(scope: str, src: str, part: str) -> str:
    over = f"PARTITION BY {part}" if part else ""
    return f"""SELECT '{scope}' AS scope, count(*) AS eligible_rows, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(sel) AS BIGINT) AS selected_rows,
  CAST(sum(sel * y) AS BIGINT) AS selected_positives, round(sum(sel * y) / sum(sel) / nullif(sum(y) / count(*), 0), 9) AS enrichment
  FROM (SELECT y, CAST(row_number() OVER ({over} ORDER BY s DESC, id) <= greatest(1, ceil(count(*) OVER ({over}) * CAST(0.01 AS DOUBLE))) AS INT) AS sel FROM {src})"""


def _recover(mode: str, f: str, y: str) -> str:
    part = "cohort, model" if mode == "pooled" else "cohort, model, u"
    return f"""SELECT cohort, model, '{mode}' AS ranking, CAST({f} AS DOUBLE) AS fraction, '{y}' AS evidence, CAST(sum(n) AS BIGINT) AS n_rows,
  CAST(sum(pos) AS BIGINT) AS positives, sum(sel) AS selected, sum(hit) AS hits,
  {"sum(sel) * sum(pos) / sum(n)" if mode == "pooled" else "sum(sel * pos / n)"} AS expected
  FROM (SELECT cohort, model, u, count(*) AS n, sum({y}) AS pos, sum(w) AS sel, sum(w * {y}) AS hit FROM (
    SELECT *, greatest(0, least(1, (greatest(1, ceil(count(*) OVER (PARTITION BY {part}) * CAST({f} AS DOUBLE)))
      - (rank() OVER (PARTITION BY {part} ORDER BY s DESC) - 1)) / CAST(count(*) OVER (PARTITION BY {part}, s) AS DOUBLE))) AS w FROM r)
   GROUP BY cohort, model, u) GROUP BY cohort, model"""


SQL = {
    "average_rank": W + f"SELECT id, u, round({_rank('u')}, 9) AS rank FROM r",
    "global_rank_fraction": W + f"SELECT id, rank, round((rank - 0.5) / n, 9) AS fraction FROM (SELECT id, {_rank('')} AS rank, count(*) OVER () AS n FROM r)",
    "rank_fraction": W + f"SELECT id, round((rank - 0.5) / n, 9) AS fraction FROM (SELECT id, {_rank('u')} AS rank, count(*) OVER (PARTITION BY u) AS n FROM r)",
    "percentile_rank": W + f"SELECT id, round(({_rank('u', 's')}) / count(*) OVER (PARTITION BY u), 9) AS pct FROM r",
    "topk_deterministic": W
    + "SELECT id, u, place FROM (SELECT id, u, row_number() OVER (PARTITION BY u ORDER BY s DESC, id) AS place, count(*) OVER (PARTITION BY u) AS n FROM r) WHERE place <= greatest(1, ceil(n * CAST(0.01 AS DOUBLE)))",
    "topk_pooled": W
    + "SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS place, count(*) OVER () AS n FROM r) WHERE place <= greatest(1, ceil(n * CAST(0.001 AS DOUBLE)))",
    "topk_fractional": W
    + """SELECT id, round(w, 9) AS weight FROM (SELECT id, greatest(0, least(1, (greatest(1, ceil(count(*) OVER (PARTITION BY u) * CAST(0.05 AS DOUBLE)))
  - (rank() OVER (PARTITION BY u ORDER BY s DESC) - 1)) / CAST(count(*) OVER (PARTITION BY u, s) AS DOUBLE))) AS w FROM r) WHERE w > 0""",
    "best_per_key": W + "SELECT u, ck, id, s FROM (SELECT *, row_number() OVER (PARTITION BY u, ck ORDER BY s DESC, id) AS q FROM r WHERE ck IS NOT NULL) WHERE q = 1",
    "pooled_binary_metrics": W + ", " + _auc("cohort, model")
    + " SELECT cohort, model, n, n_pos, round(auroc, 9) AS auroc, round(ap_pos, 9) AS ap_pos, round(ap_neg, 9) AS ap_neg, round((ap_pos + ap_neg) / 2, 9) AS ap_symmetric FROM m",
    "conditional_auroc": W + ", " + _cond("model", "u", "1")
    + " SELECT model, round(auroc, 9) AS auroc, n_rows_used, n_groups_used, n_groups_skipped, round(n_rows_used / CAST(c.n AS DOUBLE), 9) AS row_coverage FROM x1 JOIN (SELECT model, count(*) AS n FROM r GROUP BY model) c USING (model)",
    "checkpoint_selection": W + ", " + _auc("cohort, model") + ", " + _cond("cohort, model", "u", "1") + ", " + _cond("cohort, model", "ck", "2")
    + """ SELECT cohort, model, round(CASE WHEN x1.n_groups_used >= 8 AND x2.n_groups_used >= 8 THEN (x1.auroc + x2.auroc) / 2 ELSE (ap_pos + ap_neg) / 2 END, 9) AS value,
  NOT (x1.n_groups_used >= 8 AND x2.n_groups_used >= 8) AS fallback FROM m JOIN x1 USING (cohort, model) JOIN x2 USING (cohort, model)""",
    "spearman_by_group": W
    + f""", q AS (SELECT * FROM r WHERE logp IS NOT NULL), k AS (SELECT u, {_rank('u')} AS a, rank() OVER (PARTITION BY u ORDER BY logp DESC) + (count(*) OVER (PARTITION BY u, logp) - 1) / 2.0 AS b FROM q)
SELECT u, count(*) AS n, round(CASE WHEN count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN corr(a, b) END, 8) AS rho FROM k GROUP BY u""",
    "top_choice_agreement": W
    + """, q AS (SELECT *, s = max(s) OVER (PARTITION BY u) AS ia, logp = max(logp) OVER (PARTITION BY u) AS ib FROM r WHERE logp IS NOT NULL)
SELECT u, count(*) AS n, round(count(*) FILTER (WHERE ia AND ib) / CAST(count(*) FILTER (WHERE ia) * count(*) FILTER (WHERE ib) AS DOUBLE), 9) AS agreement FROM q GROUP BY u HAVING count(*) >= 2""",
    "keyword_enrichment": W + _enrich("pooled", "r", "") + " UNION ALL " + _enrich("within_group", "(SELECT * FROM (SELECT *, sum(y) OVER (PARTITION BY u) AS h FROM r) WHERE h > 0)", "u"),
    "ranking_recovery": W
    + "SELECT cohort, model, ranking, fraction, evidence, n_rows, positives, round(selected, 6) AS selected, round(hits, 6) AS hits, round(expected, 6) AS expected, round(hits / nullif(positives, 0), 6) AS recall, round(hits / nullif(expected, 0), 6) AS enrichment FROM ("
    + " UNION ALL ".join(_recover(m, f, y) for m in ("pooled", "within_group") for f in ("0.01", "0.05") for y in ("y", "o")) + ")",
}
