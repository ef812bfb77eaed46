import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions.booleans import strict_bool
from pairloom.operators import checks, cohorts, enrich, geometry, hotkeys, integrate, match, metrics, observations, resample, series, vectors
from pairloom.operators.graph import components, related_groups
from pairloom.operators.keys import clean_key, finite


def pairs(r, *cols):
    return sorted((tuple(x[c] for c in cols) for x in r.collect()), key=str)


def test_keys(spark):
    df = spark.createDataFrame([(" ab1 ",), ("NA",), ("",), (None,), ("na ",)], "k string")
    assert [r[0] for r in df.select(clean_key(F.col("k"))).collect()] == ["AB1", None, None, None, None]
    v = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (-0.0,)], "s double")
    got = [r[0] for r in v.select(finite(F.col("s"))).collect()]
    assert got == [1.0, None, None, None, 0.0] and math.copysign(1, got[4]) == 1


def test_components_on_chains_and_hubs(spark):
    edges = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(40)] + [("hub", f"x{k}") for k in range(30)] + [("z", "z"), (None, "q")]
    got = dict(pairs(components(spark.createDataFrame(edges, "a string, b string")), "node", "label"))
    assert all(got[f"n{k:03d}"] == "n000" for k in range(41)) and all(got[f"x{k}"] == "hub" for k in range(30)) and got["z"] == "z" and "q" not in got
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_related_groups_nulls_and_copies(spark):
    df = spark.createDataFrame([("1", "p", "k"), ("2", "q", "k"), ("2", "q", "k"), ("3", "r", None), ("4", None, "m"), ("5", None, None), ("6", "r", "m"), (None, "p", "k")], "i string, a string, b string")
    got = dict(pairs(related_groups(df, F.col("i"), [F.col("a"), F.col("b")]), "row_id", "group_label"))
    assert got == {"1": "0:p", "2": "0:p", "3": "0:r", "4": "0:r", "5": "~:5", "6": "0:r"}


def test_salted_profile(spark):
    data = [("hot", f"r{k}", f"c{k % 5}", float(k % 50)) for k in range(300)] * 2 + [("a", "x", None, None), ("a", "y", "c", float("nan")), (None, "z", "c", 1.0)]
    df = spark.createDataFrame(data, "k string, r string, i string, s double").repartition(4)
    got = {r["k"]: tuple(r)[1:] for r in hotkeys.salted_profile(df, F.col("k"), F.col("r"), F.col("i"), F.col("s"), salts=4).collect()}
    assert got == {"hot": (300, 5, "r149", 49.0), "a": (2, 1, None, None), None: (1, 1, "z", 1.0)}
    p = hotkeys.salted_profile(df, F.col("k"), F.col("r"), F.col("i"))
    assert pairs(hotkeys.dominant_keys(p, 991, 1000), "k") == [] and pairs(hotkeys.dominant_keys(p), "k") == [("hot",)]
    assert hotkeys.salted_profile(df.limit(0), F.col("k"), F.col("r"), F.col("i")).count() == 0


def test_matches_between(spark):
    a = spark.createDataFrame([("k", "i", "1"), ("k", "i", "1"), ("k", "i", "2"), ("k", None, "3"), (None, "i", "4")], "k string, i string, r string")
    b = spark.createDataFrame([("k", "i", "9"), ("k", "j", "8")], "k string, i string, r string")
    c = (F.col("k"), F.col("i"), F.col("r"))
    assert pairs(hotkeys.matches_between(a, b, c, c), "k", "n_matched_items", "n_matched_rows") == [("k", 1, 2)]


def test_auroc_against_pairs(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 12, 200).astype(float)
    df = spark.createDataFrame([("a", int(b), float(v)) for b, v in zip(y, s)] + [("b", 1, 1.0), ("b", 1, 2.0)], "g string, y int, s double")
    m = {r["g"]: r for r in metrics.binary_metrics(df, ["g"], F.col("y"), F.col("s")).collect()}
    p, n = s[y == 1], s[y == 0]
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert abs(m["a"]["auroc"] - want) < 1e-12 and m["b"]["auroc"] is None and m["b"]["ap_pos"] is None
    ap = sum(((s == v) & (y == 1)).sum() / y.sum() * ((s >= v) & (y == 1)).sum() / (s >= v).sum() for v in set(s))
    assert abs(m["a"]["ap_pos"] - ap) < 1e-12
    tied = metrics.binary_metrics(df.withColumn("s", F.lit(1.0)), ["g"], F.col("y"), F.col("s")).filter("g = 'a'").first()
    assert tied["auroc"] == 0.5


def test_bootstrap_matrix_equals_weighted_auroc(spark):
    rng = np.random.default_rng(5)
    c, y, s = rng.integers(0, 6, 150), rng.integers(0, 2, 150), rng.integers(0, 20, 150).astype(float)
    df = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(c, y, s)], "c int, y int, s double")
    m = np.zeros((6, 6))
    for r in resample.cluster_pair_matrix(df, "c", "y", "s").collect():
        m[r["pos"], r["neg"]] = r["wins"]
    w = np.concatenate(list(resample.drawn(6, 5, 1))).astype(float)
    for d in w:
        u = d[c]
        pos, neg = y == 1, y == 0
        brute = ((s[pos][:, None] > s[neg]) + 0.5 * (s[pos][:, None] == s[neg])) * u[pos][:, None] * u[neg]
        assert abs(d @ m @ d - brute.sum()) < 1e-9


def test_sign_flip_switch_and_wilcoxon(spark):
    few = spark.createDataFrame([(k, float(k - 3)) for k in range(12)], "c int, v double")
    many = spark.createDataFrame([(k, float(k - 3)) for k in range(13)], "c int, v double")
    assert resample.sign_flip(few, "c", "v").first()["method"] == "exact" and resample.sign_flip(many, "c", "v").first()["method"] == "monte_carlo"
    x = [0.5, -1.5, 2.5, 3.5, -4.5, 6.0]
    ranks = {abs(v): i + 1 for i, v in enumerate(sorted(x, key=abs))}
    up = sum(ranks[abs(v)] for v in x if v > 0)
    sums = [sum(k + 1 for k in range(6) if b >> k & 1) for b in range(64)]
    low = min(up, 21 - up)
    assert abs(resample.wilcoxon_exact(x) - min(1, 2 * sum(v <= low for v in sums) / 64)) < 1e-12
    lo, hi, n = resample.interval(np.array([np.nan] * 10 + [1.0] * 90))
    assert (lo, hi, n) == (None, None, 90)


def test_fold_partition_null_fold_trains(spark):
    df = spark.createDataFrame([("a", 0, 1), ("b", 0, 0), ("c", 1, 1), ("d", None, 1), ("e", 3, 0)], "id string, f int, e int")
    assert pairs(cohorts.fold_partition(df, "f", 0, F.col("e") == 1), "id", "part") == [("a", "test"), ("c", "validation"), ("d", "train"), ("e", "train")]


def test_fixpoint_runs_several_rounds_and_empties(spark):
    chain = []
    for k in range(6):
        chain += [(f"u{k}", f"k{k}", 0), (f"u{k + 1}", f"k{k}", 1)]
    end, history = cohorts.role_fixpoint(spark.createDataFrame(chain, "u string, k string, y int"), ["u", "k"])
    assert end.count() == 0 and len(history) > 3
    square = spark.createDataFrame([("u", "k", 0), ("u", "l", 1), ("v", "k", 1), ("v", "l", 0)], "u string, k string, y int")
    assert cohorts.role_fixpoint(square, ["u", "k"])[0].count() == 4


def test_scaffold_purge(spark):
    df = spark.createDataFrame([("t", "test", ["s", ""]), ("v", "validation", ["s"]), ("w", "validation", ["z"]), ("x", "train", ["z"]), ("y", "train", [""]), ("n", "train", None)], "id string, part string, m array<string>")
    assert pairs(cohorts.purge_shared_sets(df, "id", F.col("m")), "id") == [("n",), ("t",), ("w",), ("y",)]


def test_chronological_boundary_ties_to_later_year(spark):
    rows = [(2000 + k, k % 2) for k in range(10) for _ in range(4)]
    assert cohorts.chronological_boundary(spark.createDataFrame(rows, "yr int, y int"), "yr", "y").first()["boundary"] == 2007
    tie = [(y, b) for y, n in ((1, 60), (2, 20), (3, 20)) for b in (0, 1) for _ in range(n // 2)]
    assert cohorts.chronological_boundary(spark.createDataFrame(tie, "yr int, y int"), "yr", "y", share=0.3).first()["boundary"] == 2


def test_frozen_membership(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    m = spark.createDataFrame(list(zip("abcd", ("train", "validation", "test", "excluded"))), "id string, partition string")
    assert pairs(cohorts.frozen_partition(df, m, "id"), "id", "part") == [("a", "train"), ("b", "validation"), ("c", "test")]
    with pytest.raises(ValueError, match="Duplicate"):
        cohorts.frozen_partition(df, m.union(m), "id")


def test_ensemble(spark):
    df = spark.createDataFrame([("x", s, v) for s, v in ((1, 0.1), (2, 0.2), (3, 0.3))], "id string, seed int, score double")
    r = integrate.ensemble(df, ["id"], "seed", "score").first()
    assert abs(r["score"] - 0.2) < 1e-12 and abs(r["seed_sd"] - 0.1) < 1e-12
    with pytest.raises(ValueError):
        integrate.ensemble(df.withColumn("seed", F.least("seed", F.lit(2))), ["id"], "seed", "score")
    single = spark.createDataFrame([("p", "f", 0.2), ("p", "f", 0.20003), ("c", "f", 0.9)], "model string, k string, score double")
    got = integrate.average_identical_inputs(single, F.col("model") == "p", ["model", "k"])
    assert [round(r["score"], 6) for r in got.orderBy("score").collect()] == [0.200015, 0.200015, 0.9]
    with pytest.raises(ValueError):
        integrate.average_identical_inputs(single.withColumn("score", F.col("score") * 1000), F.col("model") == "p", ["model", "k"])


def test_alias_and_booleans(spark):
    df = spark.createDataFrame([(0.1, 0.1), (None, None)], "p double, score double")
    assert integrate.merge_alias(df, "p", "score").columns == ["score"]
    with pytest.raises(ValueError, match="Conflicting"):
        integrate.merge_alias(spark.createDataFrame([(0.1, 0.2)], "p double, score double"), "p", "score")
    with pytest.raises(Exception, match="explicit boolean"):
        spark.createDataFrame([("yes",)], "b string").select(strict_bool(F.col("b"))).collect()
    assert integrate.finite_in_all(spark.createDataFrame([("1", "2"), ("x", "2"), ("NaN", "1")], "a string, b string"), ["a", "b"]).count() == 1


def test_integration(spark):
    key, other = "AAAAAAAAAAAAAA-BBBBBBBBBB-C", "DAAAAAAAAAAAAA-BBBBBBBBBB-C"
    rec = [("s2", "1", "P", key, "CCO", 1), ("s1", "2", "P", key, "CO", 1), ("s1", "2", "P", key, "CO", 1), ("s1", "3", "P", other, "C", 1), ("s1", "4", "P", other, "C", 0), ("s1", "5", "P", "bad", "C", 0), ("s1", "6", None, key, "C", 1)]
    df = integrate.resolved(spark.createDataFrame(rec, "source string, source_record_id string, uniprot string, full_inchikey string, canonical_smiles string, binary_label int"))
    p, c = integrate.integrate(df.filter("resolved"))
    r = p.first()
    assert (r["canonical_smiles"], r["sources"], r["source_records"], p.count(), c.count(), df.filter("NOT resolved").count()) == ("CO", "s1;s2", 2, 1, 1, 2)


def test_consensus_is_exact(spark):
    # 1/3 + 2/3 + 4/5 over three sources is 3/5 exactly
    sets = [("a", [1]), ("a", []), ("a", None)] + [("b", [1]), ("b", [1]), ("b", [2])] + [("c", [1])] * 4 + [("c", [3])]
    df = spark.createDataFrame([("p", s, r) for s, r in sets], "p string, s string, r array<int>")
    got = {r["residue"]: (r["frequency"], r["kept"]) for r in observations.contact_consensus(df, ["p"], "s", F.col("r")).collect()}
    assert Fraction(1, 3) + Fraction(2, 3) + Fraction(4, 5) == Fraction(9, 5)
    assert got[1][1] is True and abs(got[1][0] - 0.6) < 1e-9 and got[2][1] is False


def test_observations_with_missing_feature(spark):
    df = spark.createDataFrame([("p", "a", 1.0, 5.0), ("p", "a", 3.0, None), ("p", "b", 10.0, 5.0)], "p string, s string, x double, z double")
    r = observations.aggregate_observations(df, ["p"], "", "s", {"X": "x", "Z": "z"}).first()
    assert (r["observations"], r["sources"], r["X"], r["Z"], r["feature_complete"]) == (3, 2, 6.0, None, False)


def test_zero_runs(spark):
    data = [("a", t, v) for t, v in ((0, 0), (1, 0), (2, 5), (3, 0), (10, 0), (11, 0))]
    got = pairs(series.zero_runs(spark.createDataFrame(data, "k string, t int, v int"), ["k"], "t", "v", 2), "start", "end", "reason")
    assert got == [(0, 2, "recovered"), (10, 11, "last"), (3, 3, "gap")]


def test_nearest_unused(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(10)], "i int, v double")
    assert series.nearest_unused(df, [4.0, 4.0, 4.4], "v", "i") == [4, 3, 5]


def test_min_image_against_more_images():
    rng = np.random.default_rng(1)
    cell = np.array([[6.0, 0, 0], [2.0, 7, 0], [1.0, 2, 8]])
    x, y = rng.normal(size=(5, 3)) * 9, rng.normal(size=(4, 3)) * 9
    shifts = np.array([[i, j, k] for i in range(-9, 10) for j in range(-9, 10) for k in range(-9, 10)]) @ cell
    brute = np.sqrt((((x[:, None, :] - y[None])[:, :, None, :] + shifts) ** 2).sum(-1)).min(-1)
    assert np.allclose(geometry.min_image_matrix(x, y, cell), brute)


def test_kabsch(spark):
    p = np.random.default_rng(2).normal(size=(8, 3))
    t = 0.7
    rot = np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
    df = spark.createDataFrame([(1, p.tolist(), (p @ rot.T + 3).tolist()), (2, p.tolist(), p[:3].tolist())], "i int, p array<array<double>>, q array<array<double>>")
    got = dict(pairs(geometry.kabsch_rmsd(df, "i", "p", "q"), "i", "rmsd"))
    assert got[1] < 1e-6 and got[2] is None


def test_attention_status(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], [False, False]), (2, [0.5, 0.5], [True, True]), (3, [0.9, 0.5], [True, False]), (4, [0.25, 0.75], [False, True])], "i int, a array<double>, m array<boolean>")
    got = {r["i"]: r for r in vectors.attention_metrics(df, "i", "a", "m").collect()}
    assert [got[k]["status"] for k in (1, 2, 3, 4)] == ["no_positive_residues", "no_negative_residues", "invalid", "evaluated"] and got[4]["auroc"] == 1.0


def test_matched_selection_against_sequential(spark):
    rng = np.random.default_rng(9)
    rows = [(f"r{k:03d}", f"U{k % 3}", f"c{k}", f"l{k}", float(rng.integers(0, 40)) / 40, 300 + 40 * float(rng.random()), float(rng.random()), 50 + 30 * float(rng.random()), 0, 0) for k in range(180)]
    df = spark.createDataFrame(rows, "id string, u string, ck string, lig string, s double, mw double, logp double, tpsa double, y int, o int")
    prep = spark.createDataFrame([(f"l{k}", "complete" if k % 7 else "failed", f"c{k}", k % 2, 0) for k in range(180)], "lig string, status string, computed string, q1 int, q2 int")
    got = pairs(match.matched_selection(df, prep, 8, 3), "match", "candidate", "comparison")
    pool, q = {}, {f"l{k}": (k % 7 != 0, k % 2) for k in range(180)}
    for u in ("U0", "U1", "U2"):
        mine = [r for r in rows if r[1] == u]
        pct = {r[0]: (sum(x[4] < r[4] for x in mine) + (sum(x[4] == r[4] for x in mine) + 1) / 2) / len(mine) for r in mine}
        pool[u] = ([r for r in mine if pct[r[0]] <= 0.1], sorted((r for r in mine if pct[r[0]] >= 0.9), key=lambda r: (-pct[r[0]], -r[4], r[0])))
    order = sorted(((n, u, r) for u in pool for n, r in enumerate(pool[u][1])), key=lambda x: x[:2])
    used, counts, want = set(), {}, []
    for _, u, r in order:
        if counts.get(u, 0) >= 3 or len(want) == 8 or not q[r[3]][0]:
            continue
        fit = [x for x in pool[u][0] if x[0] not in used and q[x[3]] == (True, q[r[3]][1]) and x[4] < r[4] and abs(x[5] - r[5]) <= 0.25 * r[5] and abs(x[6] - r[6]) <= 1.5 and abs(x[7] - r[7]) <= 40]
        if fit:
            best = min(fit, key=lambda x: (((x[5] - r[5]) / (0.25 * r[5])) ** 2 + ((x[6] - r[6]) / 1.5) ** 2 + ((x[7] - r[7]) / 40) ** 2, x[0]))
            used.add(best[0])
            counts[u] = counts.get(u, 0) + 1
            want.append((len(want) + 1, r[0], best[0]))
    assert got == sorted(want, key=str) and want


def test_checks(spark):
    df = spark.createDataFrame([("a/b",), ("../x",), ("/x",), ("a/../b",), ("C:\\x",), (None,), ("..b",)], "p string")
    assert [r[0] for r in df.select(checks.safe_relative_path(F.col("p"))).collect()] == [True, False, False, False, False, False, True]
    x = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "k int, v int")
    assert pairs(checks.inconsistent(x, ["k"], ["v"]), "k") == [(1,)] and checks.duplicates(x, ["k"]).count() == 1
    assert checks.same_rows(x, x).count() == 0 and checks.same_rows(x, x.limit(2)).count() == 1
    with pytest.raises(ValueError, match="Missing"):
        checks.require_columns(x, ["z"])


def test_enrichment_without_positives(spark):
    df = spark.createDataFrame([("a", 1.0, "1", 0), ("a", 2.0, "2", 0)], "u string, s double, id string, y int")
    r = enrich.keyword_enrichment(df, "u", "s", "id", "y", 0.5).filter("scope = 'pooled'").first()
    assert (r["eligible_rows"], r["positives"], r["enrichment"]) == (2, 0, None)


def test_stitch_drops_what_follows_the_last_kept_row(spark):
    seg = spark.createDataFrame([("a", 0, 1000, None), ("b", 0, 1000, None)], "seg string, start_step long, end_step long, valid_to_step long")
    t = [0.0, 4e-10, 9e-10, 1.3e-9, 0.5, 0.5 + 2e-10, 0.5 + 3e-9, 1.0]
    rows = spark.createDataFrame([("a" if k % 2 else "b", x, k) for k, x in enumerate(t)], "seg string, local_t double, v int")
    got = sorted(r["v"] for r in series.stitch(seg, rows, "seg", 1.0).collect())
    assert got == [0, 3, 4, 6, 7]
    assert series.stitch(seg, rows.limit(0), "seg", 1.0).count() == 0


def test_nearest_widens_its_search(spark):
    a = spark.createDataFrame([("m", 1, 0.0, 0.0, 0.0), ("m", 2, 100.0, 0.0, 0.0), ("n", 3, 0.0, 0.0, 0.0), (None, 4, 0.0, 0.0, 0.0)], "k string, i int, x double, y double, z double")
    b = spark.createDataFrame([("m", 1.0, 0.0, 0.0), ("m", 60.0, 30.0, 0.0), ("m", float("nan"), 0.0, 0.0)], "k string, x double, y double, z double")
    got = {r["i"]: r["min_distance"] for r in geometry.nearest(a, b, ["k"], ["i"]).collect()}
    assert got == {1: 1.0, 2: pytest.approx(50.0)}


def test_block_statistics():
    rng = np.random.default_rng(20261012)
    s, n = np.array([1.0, -2.0, 3.0, 0.5]), np.array([2.0, 2.0, 3.0, 1.0])
    picks = rng.integers(0, 4, (500, 4))
    boot = s[picks].sum(1) / n[picks].sum(1)
    got = resample.block_statistics(s, n, 500)
    assert got["ci_low"] == pytest.approx(np.quantile(boot, 0.025)) and got["ci_high"] == pytest.approx(np.quantile(boot, 0.975))
    every = [abs(sum(a * b for a, b in zip(s, f))) >= abs(s.sum()) - 1e-12 for f in itertools.product([-1, 1], repeat=4)]
    assert got["p"] == np.mean(every) and got["method"] == "exact"
    s, n = np.arange(14) - 5.0, np.ones(14)
    rng = np.random.default_rng(20261012)
    rng.integers(0, 14, (300, 14))
    null = rng.choice([-1, 1], size=(10_000, 14)) @ s / 14
    assert resample.block_statistics(s, n, 300)["p"] == pytest.approx((1 + (abs(null) >= abs(s.mean()) - 1e-12).sum()) / 10_001)


def test_draws_do_not_depend_on_blocks(monkeypatch):
    one = np.concatenate(list(resample.drawn(5, 50, 3)))
    monkeypatch.setattr(resample, "BLOCK_CELLS", 35)
    assert (one == np.concatenate(list(resample.drawn(5, 50, 3)))).all()
    s, n = np.arange(14) - 5.0, np.ones(14)
    small = resample.block_statistics(s, n, 300)
    monkeypatch.setattr(resample, "BLOCK_CELLS", 1 << 22)
    assert small == resample.block_statistics(s, n, 300)


def test_bootstrap_within(spark):
    r = np.random.default_rng(5)
    rows = [(f"c{k % 4}", f"p{k % 8}", f"l{k % 10}", int(r.integers(0, 2)), float(r.integers(0, 6)), float(r.integers(0, 6))) for k in range(160)]
    df = spark.createDataFrame(rows, "c string, p string, l string, y int, a double, b double")
    names = sorted({x[0] for x in rows})

    def auc(part, col, w):
        pos, neg = [x for x in part if x[3] == 1], [x for x in part if x[3] == 0]
        top = sum(w[x[0]] * w[z[0]] * ((x[col] > z[col]) + 0.5 * (x[col] == z[col])) for x in pos for z in neg)
        bottom = sum(w[x[0]] for x in pos) * sum(w[z[0]] for z in neg)
        return top / bottom if bottom else None

    for key, col in (("p", 1), ("l", 2)):
        groups = [[x for x in rows if x[col] == v] for v in sorted({x[col] for x in rows})]
        groups = [g for g in groups if len({x[3] for x in g}) == 2]
        boot = []
        for draw in np.concatenate([np.ones((1, 4)), *resample.drawn(4, 40, 20260902)]):
            w = dict(zip(names, draw))
            means = [[v for g in groups if (v := auc(g, k, w)) is not None] for k in (4, 5)]
            if key == "p":  # groups in one cluster count by its draws
                ws = np.array([w[g[0][0]] for g in groups])
                fixed = [np.array([auc(g, k, dict.fromkeys(names, 1.0)) for g in groups]) for k in (4, 5)]
                boot.append((ws @ (fixed[0] - fixed[1])) / ws.sum() if ws.sum() else np.nan)
            else:
                boot.append(np.mean(means[0]) - np.mean(means[1]))
        got = resample.bootstrap_within(df, "c", [key], "y", "a", "b", 40).first()
        assert got["delta"] == pytest.approx(boot[0]) and got["ci_low"] == pytest.approx(np.nanquantile(boot[1:], 0.025)) and got["ci_high"] == pytest.approx(np.nanquantile(boot[1:], 0.975))


def test_bootstrap_within_takes_any_number_of_groups(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(f"c{k % 5}", f"l{k % 33}", int(r.integers(0, 2)), float(r.integers(0, 6)), float(r.integers(0, 6))) for k in range(300)]
    df = spark.createDataFrame(rows, "c string, l string, y int, a double, b double")
    want = resample.bootstrap_within(df, "c", ["l"], "y", "a", "b", 30).first()
    monkeypatch.setattr(resample, "MAX_CELLS", 20)
    monkeypatch.setattr(resample, "BLOCK_CELLS", 50)
    monkeypatch.setattr(resample, "GROUP_CELLS", 70, raising=False)
    got = resample.bootstrap_within(df, "c", ["l"], "y", "a", "b", 30).first()
    assert list(got) == pytest.approx(list(want))


def test_exact_signed_ranks_are_used(spark):
    v = [1.5, -2.0, 3.0, 4.0, 5.5, 7.0]
    df = spark.createDataFrame([("a", x) for x in v] + [("b", float(k % 9 - 3)) for k in range(90)] + [("c", 0.0)], "g string, v double")
    got = {r["g"]: r["p"] for r in resample.wilcoxon(df, ["g"], "v").collect()}
    assert got["a"] == pytest.approx(resample.wilcoxon_exact(v)) == pytest.approx(0.09375) and set(got) == {"a", "b"}


def test_weights_leave_out_rows_without_entity(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), (None, 1), ("a", 1)], "u string, y int")
    got = cohorts.training_weights(df, "u", "y").collect()
    assert len(got) == 4 and sum(r["weight"] for r in got) == pytest.approx(4.0)


def test_construct_datasets_checks_frozen_rows(spark):
    df = spark.createDataFrame([("a", "k", 0, 1), ("a", "k", 1, 1), ("b", "m", 1, 1)], "u string, k string, y int, e int")
    with pytest.raises(ValueError):
        cohorts.construct_datasets(df, F.col("e") == 1)
    got = cohorts.construct_datasets(df.filter("u = 'a'"), F.col("e") == 1).groupBy("dataset").count().collect()
    assert {r["dataset"]: r["count"] for r in got} == dict.fromkeys(["every_pair", "both_class_proteins", "both_class_ligands", "both_class_proteins_ligands"], 2)
