import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pairloom.operators import likelihood as L
from pairloom.operators import wide_ranks as W
from pairloom.plans import structure

DATA = "/root/testdata/sf0.001"


def _scored(spark, rows=900):
    """An entity of many rows, one without a name, ties, scores of many digits, unknown ones, a column without any."""
    r = np.random.default_rng(21)
    x = [
        (f"r{k}", None if k % 11 == 10 else f"e{0 if k < 300 else k % 40}", None if r.random() < 0.1 else float(r.normal()), float(r.integers(-3, 4)) / 4, float("nan") if k % 3 else float(round(r.normal(), 6)), None if k < 890 else float(k), None)
        for k in range(rows)
    ]
    return spark.createDataFrame(x, "id string, e string, s0 double, s1 double, s2 double, s3 double, s4 double")


@pytest.mark.parametrize(("block", "values"), [(W.BLOCK, W.RANGE), (64, 100), (16, 7)])
def test_column_ranks_equal_the_joined_ones(spark, block, values):
    df = _scored(spark)
    named = {f"s{i}": m for i, (m, _) in zip(range(5), L.methods())}
    long = df.select("id", "e", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.when(~F.isnan(n), F.col(n)).alias("score")) for n, m in named.items()])).alias("m")).select("id", "e", "m.*")
    want = L.rank_candidates(long, "id", "e")
    want = want.withColumns({c: F.round(c, 9) for c in ("global_fraction", "within_fraction")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = W.column_ranks(df, "id", "e", named, block=block, values=values)
        assert sorted(got.columns) == sorted(want.columns)
        want = want.select(got.columns)
        key = lambda x: (x["id"], x["method"])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert len({key(x) for x in got.collect()}) == 900 * 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packed_numbers_come_back():
    for x in (np.array([], dtype=float), np.array([-1.5, 0.0, 2.000001]), np.array([-1e300, 0.1 + 0.2, 5.0]), np.array([3, 4, 2**60]), np.array([0.25, np.nan])):
        for ordered in (False, True):
            assert np.array_equal(W._unpacked(W._packed(x, ordered)), x, equal_nan=x.dtype.kind == "f")


def test_bins_by_fold_equal_those_of_the_fits(spark):
    r = np.random.default_rng(22)
    rows = [(None if k % 5 == 4 else k % 5, int(r.integers(0, 2)), float(r.integers(1, 9)), float(r.normal()), float(round(r.random(), 1)), float(r.integers(0, 4))) for k in range(400)]
    for train in (rows, [x for x in rows if x[0] == 0], [(0, *x[1:]) if k < 3 else (None, *x[1:]) for k, x in enumerate(rows)]):
        df = spark.createDataFrame(train, "fold int, y int, D double, MW double, LP double, AR double").repartition(3)
        got, want = L.fold_bin_models(df, "fold", "y", L.CODES), L._bin_models(df, "fold", "y", list(L.CODES))
        assert got.keys() == want.keys()
        for k, (edges, llr, continuous) in want.items():
            assert list(got[k][0]) == pytest.approx(list(edges), abs=1e-12) and list(got[k][1]) == pytest.approx(list(llr), abs=1e-12) and got[k][2] == continuous


def test_scores_of_six_digits(spark):
    r = np.random.default_rng(23)
    df = spark.createDataFrame([(k, k % 3, int(r.integers(0, 2)), float(r.integers(1, 9)) / 3, float(r.normal()), float(r.normal()), float(r.integers(0, 4))) for k in range(300)], "id int, fold int, y int, D double, MW double, LP double, AR double")
    names = [m for m, _ in L.methods()]
    want = L.wide_scores(df, df, "fold", "y", names)
    want = want.withColumns({f"s{i}": F.round(f"s{i}", 6) for i in range(46)})
    assert sorted(map(tuple, L.wide_scores(df, df, "fold", "y", names, 6).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_all_methods_are_ranked(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    df = structure.rank_candidates(spark, DATA)
    got = sorted(map(tuple, df.collect()))
    assert {x[2] for x in got} == {m for m, _ in L.methods()}
    assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()['rank_candidates']})").fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_incomplete_candidates_stay_without_ranks(spark, monkeypatch):
    own = structure._obs
    whole = structure.observation_pairs(spark, DATA).count()
    monkeypatch.setattr(structure, "_obs", lambda *a: own(*a).withColumn("l_extendedprice", F.when((F.col("a") != 3) | (F.col("b") > 9), F.col("l_extendedprice"))))
    got = structure.rank_candidates(spark, DATA).collect()
    missing = [x for x in got if x["score"] is None]
    assert len(got) == 46 * whole and missing and {x["a"] for x in missing} == {3} and len(missing) % 46 == 0
    assert all(x["global_rank"] is None and x["within_fraction"] is None for x in missing)
    known = [x for x in got if x["score"] is not None]
    assert max(x["within_rank"] for x in known if x["a"] == 3) <= len([x for x in known if x["a"] == 3]) / 46


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_rankings_raise_for_a_pair_of_two_folds(spark, monkeypatch):
    own = structure._obs
    monkeypatch.setattr(structure, "_obs", lambda *a: own(*a).withColumn("fold", F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("fold"))))
    with pytest.raises(ValueError, match="Inconsistent assignment"):
        structure.rank_candidates(spark, DATA)
