import ast
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
NAMES = ["p5_found", "p5_profiles", "average_rank", "conditional_auroc", "topk_fractional", "keyword_enrichment", "both_class_fixpoint", "partition_scaffold", "time_split_cohorts", "family_components",
         "integrate_pairs", "contact_consensus", "qnb_bins", "radius_contacts", "attention_metrics", "zero_runs", "stitch_segments", "holm_adjust",
         "temporal_counts", "input_availability", "scaffolds_added", "endpoint_targets", "imaged_contacts", "residue_changes", "tsv_round_trip", "cohort_files", "path_safety"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 6)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = __spark_entry__.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(__spark_entry__.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    want = sorted(str([norm(x[k]) for k in at]) for x in r.fetchall())
    assert sorted(str([norm(x[c]) for c in cols]) for x in df.collect()) == want


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_import_the_subpackage():
    for f in (ROOT / "pairloom").rglob("*.py"):
        if f.parent.name == "llm":
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            name = getattr(node, "module", None) or "".join(a.name for a in getattr(node, "names", []) if isinstance(node, ast.Import))
            assert not str(name).startswith("pairloom.llm"), f
