import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from pairloom.plans import signals
from tests.test_entry import norm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def attended(q, k):
    e = np.exp(q @ k.T / np.sqrt(q.shape[1]))
    return ((e / e.sum(axis=1, keepdims=True)) @ k).mean(axis=0)


def test_network_reads_all_vectors(spark, monkeypatch):
    seen = {}
    predict = signals.vectors.predict

    def spy(df, row_id, left, right, weights, model):
        seen.update(weights=weights, rows={r[row_id]: (r[left], r[right]) for r in df.collect()})
        return predict(df, row_id, left, right, weights, model)

    monkeypatch.setattr(signals.vectors, "predict", spy)
    got = {r["label"]: r["score"] for r in signals.network_scores(spark, DATA).collect()}
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    assert set(got) == set(e["label"])
    w = seen["weights"]
    for label, x in e.groupby("label"):
        a, b = (np.stack(x[x["vec_id"] % 2 == k].sort_values("vec_id")["embedding"].to_list()).astype(float) for k in (0, 1))
        l, r = seen["rows"][label]
        assert len(l) + len(r) == len(x) and {len(v) for v in l + r} == {64}
        p, q = attended(a, b), attended(b, a)
        h = np.maximum(0, np.concatenate([p, q, p * q, np.abs(p - q)]) @ w["w1"] + w["b1"])
        assert got[label] == pytest.approx(1 / (1 + np.exp(-(h @ w["w2"] + w["b2"]))), abs=2e-6)


def rows(df):
    cols = sorted(df.columns)
    return sorted(str([norm(r[c]) for c in cols]) for r in df.collect())


@pytest.mark.parametrize("name", ["box_coverage_all", "pose_classification_all", "clash_counts_all", "medoid_all", "repeated_support_all"])
def test_whole_geometry_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    r = con.execute(signals.SQL[name])
    names = [x[0] for x in r.description]
    at = [names.index(c) for c in sorted(names)]
    assert rows(signals.QUERIES[name](spark, DATA)) == sorted(str([norm(x[k]) for k in at]) for x in r.fetchall())


def test_whole_geometry_reads_all_points(spark):
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    p = {k: np.round(np.stack(x["embedding"].to_list())[:, :3].astype(float) * 10, 3) for k, x in e.groupby("label")}
    near = {k: int(((x[:, None] - x[None]) ** 2).sum(-1).__le__(36).sum(1).max()) for k, x in p.items()}
    assert {r["label"]: r["n_near"] for r in signals.medoid_all(spark, DATA).collect()} == near
    assert {r["label"] for r in signals.box_coverage_all(spark, DATA).collect()} == set(e["label"])
