"""Kernel densities from moments of cells against the kernels one by one."""

import os

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from pairloom.operators import likelihood as L
from pairloom.operators import observations as O
from pairloom.plans import structure

DATA = "/root/testdata/sf0.001"


def direct(x, n, z):
    mean = np.average(x, weights=n)
    m = n.sum()
    h = np.sqrt((n * (x - mean) ** 2).sum() / (m - 1)) * m**-0.2
    return (np.exp(-0.5 * ((z[:, None] - x) / h) ** 2) @ n) / (m * h * np.sqrt(2 * np.pi))


def tables(spark, values):
    rows = [(fit, c, y, float(x), int(n)) for (fit, c, y), (xs, ns) in values.items() for x, n in zip(xs, ns)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["fit", "code", "y", "x", "n"]), "fit int, code string, y int, x double, n long")


def test_densities_equal_kernels_one_by_one(spark):
    r = np.random.default_rng(4)
    shapes = {"D": lambda k: r.normal(0, 1e-4, k), "MW": lambda k: np.append(r.lognormal(9, 1, k - 1), 3e6) + 1e7, "LP": lambda k: np.round(r.uniform(0, 0.1, k), 2)}
    values = {}
    for fit in (0, 1):
        for c, of in shapes.items():
            for y in (0, 1):
                x = np.unique(of(700 + 100 * y))
                values[fit, c, y] = (x, r.integers(1, 4, len(x)))
    values[1, "LP", 1] = (np.array([0.05]), np.array([1]))  # one value has no width
    z = {(fit, c): np.unique(np.concatenate([values[fit, c, 0][0][::7], of(150), [-1e9, 1e9]])) for fit in (0, 1) for c, of in shapes.items()}
    queries = spark.createDataFrame([(fit, c, float(x)) for (fit, c), v in z.items() for x in v], "fit int, code string, x double")
    out = L.kde_components(tables(spark, values), queries)
    assert out.schema["fit"].dataType == queries.schema["fit"].dataType
    got = {(x["fit"], x["code"], x["x"]): x["llr"] for x in out.collect()}
    assert len(got) == sum(len(v) for v in z.values())
    for (fit, c), v in z.items():
        (x0, n0), (x1, n1) = values[fit, c, 0], values[fit, c, 1]
        at = np.clip(v, min(x0[0], x1[0]), max(x0[-1], x1[-1]))
        if len(x1) == 1:
            assert all(got[fit, c, float(x)] is None for x in v)
        else:
            want = np.log((direct(x1, n1, at) + L.FLOOR) / (direct(x0, n0, at) + L.FLOOR))
            assert [got[fit, c, float(x)] for x in v] == pytest.approx(list(want), abs=1e-9)


def test_cells_do_not_grow_with_values(spark):
    count = {}
    for k in (500, 16_000):
        x = np.linspace(0, 1, k)
        long = tables(spark, {(0, "MW", 1): (x, np.ones(k))})
        h = x.std(ddof=1) * k**-0.2
        width = spark.createDataFrame([(0, "MW", 1, k, 0.0, float(h))], "fit long, code string, y int, m long, lo double, h double")
        row = L.kernel_cells(long, width).first()
        count[k] = len(row["cell"])
        assert sum(row["w"][:: L.TERMS]) == pytest.approx(k, rel=0.04) and list(row["cell"]) == sorted(row["cell"])
    assert count[16_000] <= 2.1 * count[500]


def test_bins_by_halving(spark):
    r = np.random.default_rng(8)
    rows = [(sorted(r.integers(0, 50, k).astype(float).tolist()), float(x)) for k in (0, 1, 2, 7, 8, 133) for x in r.integers(-1, 51, 20)]
    df = spark.createDataFrame(rows, "e array<double>, x double")
    got = df.select("e", "x", L._bin(df["e"], df["x"]).alias("b")).collect()
    assert all(g["b"] == np.searchsorted(g["e"], g["x"], side="right") for g in got) and len(got) == 120


def test_medians_of_pairs_over_many_batches(spark):
    r = np.random.default_rng(9)
    rows = [(None if k % 11 == 0 else int(k % 11), f"s{r.integers(0, 4)}", float(r.integers(0, 40)), None if k == 1205 else float("inf") if k == 7 else float(r.normal()), "c", bool(k % 13 or k % 11 != 3)) for k in range(1500)]
    df = spark.createDataFrame(rows, "p int, s string, x double, z double, t string, f boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {x["p"]: x for x in O.aggregate_observations(df, ["p"], "", "s", {"X": "x", "Z": "z"}, ["t"], {"ok": F.col("f")}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf = pd.DataFrame(rows, columns=["p", "s", "x", "z", "t", "f"])
    pdf["p"] = pdf["p"].fillna(-1)
    assert len(got) == 11
    for p, g in pdf.groupby("p"):
        x = got[None if p == -1 else int(p)]
        per = g.groupby("s")[["x", "z"]].median().median()
        assert (x["observations"], x["sources"], x["t"], x["ok"]) == (len(g), g.s.nunique(), "c", bool(g.f.all()))
        assert x["X"] == per["x"] and (x["Z"] is None if p in (6, 7) else x["Z"] == pytest.approx(per["z"])) and x["feature_complete"] == (p not in (6, 7))


def test_named_methods_alone_are_scored(spark):
    r = np.random.default_rng(10)
    rows = [(k, k % 3, int(r.integers(0, 2)), *(float(x) for x in r.normal(size=3)), float(r.integers(0, 3))) for k in range(90)]
    df = spark.createDataFrame(rows, "id int, fold int, y int, D double, MW double, LP double, AR double")
    every = {(x["id"], x["method"]): x["score"] for x in L.method_scores(df, df, "fold", "y", ["id"]).collect()}
    some = {(x["id"], x["method"]): x["score"] for x in L.method_scores(df, df, "fold", "y", ["id"], L.VIEWS).collect()}
    assert len(every) == 90 * 46 and some == pytest.approx({k: v for k, v in every.items() if k[1] in L.VIEWS}, abs=1e-11)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_funnel_fits_its_pairs_once(spark, monkeypatch):
    calls, own = [], structure._pairs
    monkeypatch.setattr(structure, "_pairs", lambda *a: calls.append(a) or own(*a))
    assert structure.review_funnel(spark, DATA).count() > 0 and len(calls) == 1


def test_pieces_equal_kernels_one_by_one(spark):
    r = np.random.default_rng(11)
    rows = []
    for fold in (0, 1, 2, None):
        for y in (0, 1):
            k = 500 + 70 * y
            rows += [(fold, y, *x) for x in zip(r.normal(0, 1e-4, k), np.append(r.lognormal(9, 1, k - 1), 3e6 * (fold or 0) ** 2) + 1e7, np.round(r.uniform(0, 0.1, k), 2))]
    pdf = pd.DataFrame(rows, columns=["fold", "y", "D", "MW", "LP"]).astype({"fold": "Int64"})
    df = spark.createDataFrame([(None if pd.isna(f) else int(f), int(y), *map(float, x)) for f, y, *x in pdf.itertuples(index=False)], "fold int, y int, D double, MW double, LP double")
    models = L._kernel_models(df.repartition(3), "fold", "y", ["D", "MW", "LP"])
    assert len(models) == 12
    for (fit, c), model in models.items():
        of = pdf if fit is None else pdf[pdf.fold.notna() & (pdf.fold != fit)]
        z = np.concatenate([pdf[c].to_numpy()[::5], r.uniform(of[c].min(), of[c].max(), 400), [-1e9, 1e9]])
        at = np.clip(z, of[c].min(), of[c].max())
        d0, d1 = (direct(v, np.ones(len(v)), at) for v in (of[of.y == y][c].to_numpy() for y in (0, 1)))
        assert list(L._kernel_value(model, z)) == pytest.approx(list(np.log((d1 + L.FLOOR) / (d0 + L.FLOOR))), abs=1e-9)


def test_wide_scores_equal_the_joined_ones(spark):
    r = np.random.default_rng(12)
    rows = [(k, None if k % 4 == 3 else k % 4, int(r.integers(0, 2)), *(None if r.random() < 0.02 and k % 4 == 1 else float(x) for x in (r.integers(1, 9), r.normal(), r.normal(), r.integers(0, 4)))) for k in range(200)]
    rows += [(200, 0, 1, 99.0, 9.0, 9.0, 77.0)]  # beyond the training values, a category of its own
    only = (*L.VIEWS, "KDE100:LP", "QNB:MW+LP+AR")
    for train in (rows, [x for x in rows if x[1] == 0], [(*x[:2], int(x[0] == 4), *x[3:]) for x in rows]):  # whole, a single fold, a class of one value
        df = spark.createDataFrame(train, "id int, fold int, y int, D double, MW double, LP double, AR double")
        want = {(x["id"], x["method"]): x["score"] for x in L.method_scores(df, df, "fold", "y", ["id"], only).collect()}
        got = {(x["id"], m): x[f"s{i}"] for x in L.wide_scores(df, df, "fold", "y", only).collect() for i, m in enumerate(only)}
        assert len(got) == len(train) * len(only) and {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, abs=1e-9)


@pytest.mark.parametrize("held", [100_000, 40, 0])
def test_votes_equal_the_ranks(spark, monkeypatch, held):
    monkeypatch.setattr(L, "HELD", held)
    r = np.random.default_rng(13)
    rows = [(k, None if k % 7 == 6 else f"e{min(k % 7, int(r.integers(0, 3)))}", float(r.integers(0, 30)), None if r.random() < 0.1 else float(r.normal()), float("nan") if k % 3 else 1.0, None) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, e string, s0 double, s1 double, s2 double, s3 double")
    names = [f"s{i}" for i in range(4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for cut in (0.1, 0.5, 0.995, 1e-6):
            long = df.select("id", "e", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(n).alias("score")) for m, n in zip(L.VIEWS, names)])).alias("m")).select("id", "e", "m.*")
            ranks = L.rank_candidates(long, "id", "e").groupBy("id").agg(*[F.sum((F.col(f"{a}_fraction") <= cut).cast("long")) for a in ("global", "within")])
            got = L.votes(df, ["id"], "e", names, cut)
            assert sorted(map(tuple, got.select("id", "global_hit", "protein_hit").collect())) == sorted(map(tuple, ranks.collect()))
            assert sorted(x["id"] for x in got.filter("s0 >= 0").collect()) == list(range(400))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_means_and_constants_in_the_pass_over_pairs(spark):
    r = np.random.default_rng(14)
    rows = [(k % 9, f"s{r.integers(0, 4)}", 1.0, None if k % 9 == 2 or r.random() < 0.1 else float(r.integers(0, 2)), None if k == 3 else "c" if k != 4 else "d", bool(k % 9 != 5), None if k == 15 else True) for k in range(300)]
    df = spark.createDataFrame(rows, "p int, s string, x double, v double, t string, f boolean, g boolean")
    got = {x["p"]: x for x in O.aggregate_observations(df, ["p"], "", "s", {"X": "x"}, ["t"], {"f": F.col("f"), "g": F.col("g")}, {"mean": F.col("v")}, False).collect()}
    want = {x["p"]: x["mean"] for x in O.mean_of_source_means(df, ["p"], "s", F.col("v"), "mean").collect()}
    assert {p: x["mean"] for p, x in got.items()} == pytest.approx(want) and want[2] is None and len(want) == 9
    assert {p for p, x in got.items() if not x["consistent"]} == {3, 4}
    assert {p for p, x in got.items() if not x["f"]} == {5} and {p for p, x in got.items() if not x["g"]} == {6}


def test_means_of_thirds_do_not_depend_on_order(spark):
    shares = [(3, 2), (3, 1), (1, 1), (2, 1), (3, 3), (1, 1)]
    rows = [(k, (i * (k + 1)) % 7, 1.0, float(j < hits)) for k in range(6) for i, (n, hits) in enumerate(shares) for j in range(n)]
    df = spark.createDataFrame(rows, "p int, s int, x double, v double")
    got = [x["mean"] for x in O.aggregate_observations(df, ["p"], "", "s", {"X": "x"}, means={"mean": F.col("v")}).collect()]
    assert got == [0.75] * 6


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_funnel_fits_what_its_views_add_up(spark, monkeypatch):
    """Prices and discounts have no bins in the views, and no rows are joined to ranks."""
    fitted, ranked, own, tied = [], [], L.training_long, L.rank_candidates
    monkeypatch.setattr(L, "training_long", lambda *a: fitted.append(list(a[3])) or own(*a))
    monkeypatch.setattr(L, "rank_candidates", lambda *a: ranked.append(a) or tied(*a))
    assert structure.review_funnel(spark, DATA).count() > 0
    assert fitted == [["D", "AR"]] and not ranked


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_funnel_raises_for_a_pair_of_two_folds(spark, monkeypatch):
    own = structure._obs
    monkeypatch.setattr(structure, "_obs", lambda *a: own(*a).withColumn("fold", F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("fold"))))
    with pytest.raises(ValueError, match="Inconsistent assignment"):
        structure.review_funnel(spark, DATA)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_funnel_equals_that_of_the_rankings(spark):
    p = structure._fitted(spark, DATA)
    r = L.rank_candidates(structure._some_scores(p, *L.VIEWS), "id", "a")
    f = O.mean_of_source_means(structure._obs(spark, DATA), ["a", "b"], "pdb", (F.col("l_quantity") >= 10).cast("double"), "fraction_ge10")
    p = p.withColumn("id", F.concat_ws(":", "a", "b")).withColumn("min_heavy_distance", F.col("D") / 3).join(f, ["a", "b"])
    got = structure.review_funnel(spark, DATA)
    want = L.review_funnel(p, r, "id").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
