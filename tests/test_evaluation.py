"""Contracts of released tables, docking endpoints and frame checks on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import compare, endpoints, release, trajectory


def test_predictions_under_old_names(spark):
    df = spark.createDataFrame([("every_pair", "0.1"), ("x", "0.2")], "cohort_arm string, p_allosteric string")
    got = {(r["dataset"], r["score"]) for r in release.prediction_frame(df, {"x": "main"}).collect()}
    assert got == {("every_pair", 0.1), ("main", 0.2)}
    with pytest.raises(ValueError):
        release.prediction_frame(df.withColumn("score", F.lit("0.3")))
    with pytest.raises(ValueError):
        release.prediction_frame(df.drop("p_allosteric"))
    with pytest.raises(ValueError):
        release.select_rows(df, {"regime": "random"})
    with pytest.raises(ValueError):
        release.select_rows(df, {"cohort_arm": "none"})


def test_released_scores_cover_both_sides(spark):
    p = spark.createDataFrame([("a",), ("b",)], "id string")
    s = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "id string, p_v1_c1_mean double")
    assert {r["id"]: r["c1"] for r in release.released_scores(p, s, "id", ["c1"]).collect()} == {"a": 0.1, "b": 0.2}
    for left, right in ((p.limit(1), s), (p, s.unionAll(s))):
        with pytest.raises(ValueError):
            release.released_scores(left, right, "id", ["c1"])
    with pytest.raises(ValueError):
        release.released_scores(p, s, "id", ["d1"])
    with pytest.raises(ValueError):
        release.with_identity(p, s.filter("id = 'a'"), "id")
    with pytest.raises(ValueError):
        release.annotated(p, s.unionAll(s), "id")


def test_deployment(spark):
    fits = [("c", s, f, 3 + f) for s in (1, 2, 3) for f in range(5)]
    df = spark.createDataFrame(fits, "model string, seed int, outer_fold int, best_epoch int")
    assert release.deployment_epochs(df, ["model"], [1, 2, 3], 5).first()["epochs"] == 5
    with pytest.raises(ValueError):
        release.deployment_epochs(df.filter("seed < 3 OR outer_fold > 0"), ["model"], [1, 2, 3], 5)
    index = spark.createDataFrame([("deployment", "m", k, f"p{k}") for k in range(3)] + [("other", "m", 1, "p9")], "experiment string, model string, seed int, path string")
    assert release.deployment_models(index, ["model"]).count() == 3
    with pytest.raises(ValueError):
        release.deployment_models(index.filter("seed < 2"), ["model"])


def test_docking_jobs(spark, tmp_path):
    job = '{"job_id": "j1", "system_id": "s", "pocket_id": "b", "scoring": "vina", "seed": 1, "exhaustiveness": 8, "cpu": 1, "num_modes": 9, "chembl_id": "C1", "role": "candidate", "uniprot": "P1", "match_id": "m", "receptor": "inputs/receptor/r.pdbqt", "ligand": "inputs/ligand/l.pdbqt", "pose": "poses/p.pdbqt", "center": [1.0, 2.0, 3.0], "size": [4.0, 5.0, 6.0]}'
    (tmp_path / "jobs.json").write_text(f"[{job}]")
    jobs = release.read_docking_jobs(spark, str(tmp_path / "jobs.json"))
    names = ["jobs.json", "inputs/receptor/r.pdbqt", "inputs/ligand/l.pdbqt", "poses/p.pdbqt"]
    members = lambda n: spark.createDataFrame([(x, True) for x in n], "path string, is_file boolean")
    got = release.docking_jobs(jobs, members(names), "/out").first()
    assert (got["center_z"], got["size_x"], got["ligand_id"], got["receptor"]) == (3.0, 4.0, "C1", "/out/archive/inputs/receptor/r.pdbqt")
    for bad in (names[:3], [*names, "poses/../x"], [*names, "other/x"], [*names, names[0]]):
        with pytest.raises(ValueError):
            release.docking_jobs(jobs, members(bad), "/out")


def test_temporal_rows_are_checked(spark):
    df = spark.createDataFrame([("a", "u", 2000, 0), ("b", "v", 2001, 1)], "id string, u string, yr int, y int")
    assert release.validate_temporal(df, "yr", 2015, "id", ["u"], "y").count() == 2
    for bad in (df.unionAll(df), df.withColumn("yr", F.lit(None).cast("int")), df.withColumn("yr", F.lit(2016)), df.filter("y = 1")):
        with pytest.raises(ValueError):
            release.validate_temporal(bad, "yr", 2015, "id", ["u"], "y")


def test_rankings_are_matched_whole(spark):
    left = spark.createDataFrame([("p", "m1", 1, 0.1), ("p", "m2", 1, 0.2), ("q", "m1", 0, 0.3), ("q", "m2", 0, float("nan"))], "id string, model string, y int, a double")
    right = spark.createDataFrame([("p", "x", 1, 1.0), ("q", "x", 0, 2.0)], "id string, method string, y int, b double")
    assert {(r["id"], r["model"]) for r in compare.matched_rankings(left, right, ["id"], "model", "method", 2, 1).collect()} == {("p", "m1"), ("p", "m2")}
    with pytest.raises(ValueError):
        compare.matched_rankings(left, right.withColumn("y", F.lit(5)), ["id"], "model", "method", 2, 1)
    with pytest.raises(ValueError):
        compare.against_baseline(left.filter("id = 'p'").select("id", "model", "a"), [], "id", "model", "a", "none")


def test_intervals_draw_all_clusters(spark):
    rows = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 3.0), ("m", "b", 5.0)], "model string, cluster string, v double")
    levels = spark.createDataFrame([("a",), ("b",), ("c",)], "cluster string")
    draws = np.random.RandomState(20260922).multinomial(3, np.ones(3) / 3, size=400)
    with np.errstate(invalid="ignore"):
        boot = (draws @ [1.0, 8.0, 0.0]) / (draws @ [1.0, 2.0, 0.0])
    got = compare.with_intervals(rows, ["model"], "cluster", "v", levels, 400).first()
    assert got["ci_low"] == pytest.approx(np.nanquantile(boot, 0.025)) and got["valid_replicates"] == np.isfinite(boot).sum()


def test_intervals_take_any_number_of_clusters(spark, monkeypatch):
    r = np.random.default_rng(3)
    v, names = r.normal(size=90), [f"c{k % 70:02d}" for k in range(90)]
    monkeypatch.setattr(compare, "MAX_CELLS", 50, raising=False)
    monkeypatch.setattr(compare, "PACKED_CELLS", 16, raising=False)
    rows = spark.createDataFrame([(None if k % 3 else "m", c, float(x)) for k, (c, x) in enumerate(zip(names, v))], "model string, cluster string, v double")
    got = {x["model"]: x for x in compare.with_intervals(rows, ["model"], "cluster", "v", rows, 300).collect()}
    draws = np.random.RandomState(20260922).multinomial(70, np.ones(70) / 70, size=300)
    for model, rest in (("m", [k for k in range(90) if k % 3 == 0]), (None, [k for k in range(90) if k % 3])):
        w = draws[:, [k % 70 for k in rest]]
        boot = (w @ v[rest]) / w.sum(axis=1)
        assert (got[model]["ci_low"], got[model]["ci_high"], got[model]["valid_replicates"]) == (pytest.approx(np.quantile(boot, 0.025)), pytest.approx(np.quantile(boot, 0.975)), 300)
    with pytest.raises(Exception, match="not among the levels"):
        compare.with_intervals(rows, ["model"], "cluster", "v", rows.filter("cluster <> 'c01'"), 300).collect()


def test_limited_references_are_not_strict(spark):
    schema = "t string, reference_kind string, strict_distinct_evaluable boolean, strict_distinct_exclusion_reason string, known_site_evaluable boolean, known_site_exclusion_reason string"
    df = spark.createDataFrame([("a", endpoints.LIMITED, None, None, None, None), ("b", "full", None, None, False, "gap")], schema)
    got = {r["t"]: (r["strict"], r["strict_reason"], r["known"], r["known_reason"]) for r in endpoints.evaluability(df, "t").collect()}
    assert got == {"a": (False, endpoints.STRICT_REASON, True, ""), "b": (True, "", False, "gap")}
    with pytest.raises(ValueError):
        endpoints.evaluability(df.withColumn("strict_distinct_evaluable", F.lit(True)), "t")


def test_endpoint_summary_matches_the_definition(spark):
    r = np.random.default_rng(2)
    rows = [("e", f"t{k // 4}", f"m{k}", role, bool(r.integers(0, 2))) for k in range(24) for role in ("candidate", "comparison")]
    df = spark.createDataFrame(rows, "endpoint string, t string, m string, role string, success boolean").withColumn("model", F.lit("x"))
    got = endpoints.endpoint_summary(df, ["model", "endpoint"], ["endpoint"], "t", "m", F.col("success"), 200).first()
    delta = {}
    for _, t, m, role, s in rows:
        delta[t] = delta.get(t, 0) + (int(s) if role == "candidate" else -int(s))
    assert got["delta"] == pytest.approx(sum(delta.values()) / 24) and (got["n_pairs"], got["n_blocks"]) == (24, 6)
    assert got["holm_p"] == pytest.approx(min(1.0, 16 * got["p"])) and got["candidate_only"] + got["comparison_only"] + got["both"] + got["neither"] == 24
    with pytest.raises(ValueError):
        endpoints.endpoint_summary(df, ["model", "endpoint"], ["endpoint"], "t", "m", F.col("success"), 200, 0)
    with pytest.raises(ValueError):
        endpoints.endpoint_summary(df.filter("m <> 'm1' OR role = 'candidate'"), ["model", "endpoint"], ["endpoint"], "t", "m", F.col("success"), 200)


FRAME = "f int, rl array<array<double>>, rp array<array<double>>, il array<array<double>>, ip array<array<double>>, r array<long>, c array<array<double>>"
CELL = [[20.0, 0.0, 0.0], [3.0, 18.0, 0.0], [1.0, 2.0, 17.0]]


def test_imaging_states(spark):
    prot = [[5.0, 5.0, 5.0], [6.0, 5.0, 5.0], [5.0, 7.0, 5.0]]
    lig = [[8.0, 5.0, 5.0], [9.0, 5.0, 5.0]]
    moved = lambda pts, by: [[a + b for a, b in zip(p, by)] for p in pts]
    far = moved(lig, CELL[0])
    rows = [
        (1, far, prot, lig, prot, [1, 2, 3], CELL),  # back by a whole cell
        (2, lig, prot, moved(lig, [0.5, 0.0, 0.0]), prot, [1, 2, 3], CELL),
        (3, lig, prot, [lig[0], moved(lig, [0.3, 0, 0])[1]], prot, [1, 2, 3], CELL),
        (4, moved(lig, [4.0, 5.0, 6.0]), prot, moved(lig, [4.0, 5.0, 6.0]), prot, [1, 2, 3], CELL),
        (5, far, prot, far, prot, [1, 2, 3], CELL),
    ]
    got = {r["frame"]: (r["state"], set(r["flags"])) for r in trajectory.imaging_check(spark.createDataFrame(rows, FRAME), "f", "rl", "rp", "il", "ip", "r", "c").collect()}
    assert got[1] == ("OK", set()) and "not_whole_cells" in got[2][1] and "ligand_deformed" in got[3][1]
    assert got[4][0] == "GENUINELY_DETACHED" and got[5][0] == "NEEDS_REVIEW" and {"contacts_differ", "not_nearest_copy"} <= got[5][1]


def test_a_turned_frame_fits_its_reference(spark):
    r = np.random.default_rng(1)
    core, lig = r.normal(size=(8, 3)) * 5, r.normal(size=(4, 3))
    a = 0.7
    turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    row = lambda k, c, x: (k, c.tolist(), x.tolist(), c.tolist(), list(range(8)))
    df = spark.createDataFrame([row(0, core @ turn + 3, lig @ turn + 3), row(1, core, lig + [2.0, 0, 0])], "f int, c array<array<double>>, l array<array<double>>, p array<array<double>>, r array<long>")
    got = {x["frame"]: x for x in trajectory.pose_metrics(df, "f", "c", "l", "p", "r", {"core": core, "ligand": lig, "protein": core}, [0, 1]).collect()}
    assert got[0]["core_rmsd"] == pytest.approx(0, abs=1e-6) and got[0]["ligand_rmsd"] == pytest.approx(0, abs=1e-6) and got[0]["kept"] == 1.0
    assert got[1]["ligand_rmsd"] == pytest.approx(2.0) and got[1]["internal_rmsd"] == pytest.approx(0, abs=1e-6) and got[1]["centroid"] == pytest.approx(2.0)


def test_preparation_and_seeds(spark):
    df = spark.createDataFrame([(1, [[0.0, 0.0, 0.0], [1.5, 0.0, 0.0]], [[0, 1]], CELL), (2, [[float("nan"), 0.0, 0.0]], [], CELL)], "s int, x array<array<double>>, b array<array<int>>, c array<array<double>>")
    got = {r["seed"]: r for r in trajectory.preparation_check(df, "s", "x", "b", "c").collect()}
    assert got[1]["longest_bond"] == 1.5 and got[1]["coherent"] and not got[2]["finite"]
    rows = [(leg, k, "s" if k == 1 else "o", 1.0) for leg in ("open", "closed") for k in (1, 2)]
    seeds = spark.createDataFrame(rows, "leg string, seed long, stratum string, wpd double")
    assert trajectory.contact_seeds(seeds, ["open", "closed"], 2, ["s", "o"], "s").count() == 2
    for bad in (seeds.filter("leg = 'open'"), seeds.filter("seed = 1"), seeds.withColumn("stratum", F.lit("x")), seeds.withColumn("wpd", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            trajectory.contact_seeds(bad, ["open", "closed"], 2, ["s", "o"], "s")
