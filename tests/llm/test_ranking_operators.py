"""Top-n, caps, cutoffs and splits against brute force, with nulls, ties, copies and clashing names."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import capping, splits
from pairloom.llm.capping import cap_contributors
from pairloom.llm.cutoffs import keep_fraction
from pairloom.llm.splits import allocate, balanced_bins, grouped_splits
from pairloom.llm.topn import top_n

SCHEMA = "g string, s double, i string, pos long, edge string, pid string, n double"
NAN, INF = float("nan"), float("inf")


def data(seed, n=500):
    r = random.Random(seed)
    rows = [(r.choice(["a"] * 5 + ["b", "c", f"t{k}"]), r.randint(0, 30) / 10, f"r{k:04d}", k, "x", None, 1.0) for k in range(n)]
    rows += rows[::7]
    return rows + [(None, 1.0, "n1", 0, None, None, NAN), ("a", None, "n2", 0, None, None, NAN), ("a", NAN, "n3", 0, None, None, NAN), ("a", INF, "n4", 0, None, None, NAN), ("a", 1.0, None, 0, None, None, NAN)]


def clean(rows):
    out = {}
    for g, s, i, *_ in rows:
        if g is not None and i is not None and s is not None and s == s and abs(s) != INF:
            out.setdefault(g, set()).add((-s, i))
    return {g: sorted(v) for g, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def args():
    return F.col("g"), F.col("s"), F.col("i")


@pytest.mark.parametrize("n", [0, 1, 10, 1000])
def test_top_n(spark, n):
    rows = data(n)
    got = {(r["group_key"], r["place"]): r["item_id"] for r in top_n(frame(spark, rows), *args(), n, partitions=7).collect()}
    assert got == {(g, k + 1): i for g, v in clean(rows).items() for k, (_, i) in enumerate(v[:n])}


def test_empty_tables(spark):
    df = frame(spark, [])
    assert top_n(df, *args(), 3).count() == 0
    assert cap_contributors(df, F.array("g"), F.col("s"), F.col("i"), 3).count() == 0
    cuts, kept = keep_fraction(df, *args())
    assert cuts.count() == 0 and kept.count() == 0
    assert grouped_splits(df, F.col("i"), [F.col("g")]).count() == 0


@pytest.mark.parametrize("cap", [0, 5, 10_000])
def test_cap_single_contributor(spark, cap):
    rows = data(cap)
    got = {r["item_id"]: r["kept"] for r in cap_contributors(frame(spark, rows), F.array("g"), F.col("s"), F.col("i"), cap).collect()}
    assert got == {i: k < cap for v in clean(rows).values() for k, (_, i) in enumerate(v)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cap_many_contributors(spark, seed):
    r = random.Random(seed)
    rows = [(f"r{k:03d}", r.randint(0, 40) / 10, r.sample("abcdef", r.randint(1, 3)) + ["a"] * r.randint(0, 2) + [None]) for k in range(150)]
    df = spark.createDataFrame(rows + rows[:20] + [("e", 1.0, []), ("f", 1.0, None)], "i string, s double, c array<string>")
    got = {x["item_id"]: x["kept"] for x in cap_contributors(df, F.col("c"), F.col("s"), F.col("i"), 12).collect()}
    held, want = {}, {}
    for i, s, c in sorted(rows, key=lambda x: (-x[1], x[0])):
        c = {x for x in c if x}
        want[i] = all(held.get(x, 0) < 12 for x in c)
        if want[i]:
            for x in c:
                held[x] = held.get(x, 0) + 1
    assert got == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    # each record waits for the one before it
    n = 3000
    rows = [(f"r{k:05d}", float(n - k), [f"c{k:05d}", f"c{k + 1:05d}"]) for k in range(n)]
    calls = []
    ranked = capping.grouped_positions
    monkeypatch.setattr(capping, "grouped_positions", lambda *a, **k: calls.append(1) or ranked(*a, **k))
    df = spark.createDataFrame(rows, "i string, s double, c array<string>")
    got = {r["item_id"]: r["kept"] for r in cap_contributors(df, F.col("c"), F.col("s"), F.col("i"), 1).collect()}
    assert got == {f"r{k:05d}": k % 2 == 0 for k in range(n)} and len(calls) <= 3


@pytest.mark.parametrize("alone", [0, 60])
def test_large_components_take_rounds(spark, monkeypatch, alone):
    monkeypatch.setattr(capping, "ALONE", alone)
    r = random.Random(alone)
    rows = [(f"r{k:03d}", r.randint(0, 400) / 10, r.sample("abcdef" if k < 90 else "uvwxyz", 2)) for k in range(130)]
    df = spark.createDataFrame(rows, "i string, s double, c array<string>")
    args = (F.col("c"), F.col("s"), F.col("i"), 7)
    got = cap_contributors(df, *args)
    assert capping.report(df, *args, got).first().asDict() == {"records": 130, "wrong": 0}
    worse = got.withColumn("kept", F.when(F.col("item_id") == "r005", ~F.col("kept")).otherwise(F.col("kept")))
    assert capping.report(df, *args, worse).first()["wrong"] > 0


def test_cap_share(spark):
    df = spark.createDataFrame([(f"r{k}", float(k), ["a"] if k < 8 else ["b"]) for k in range(10)], "i string, s double, c array<string>")
    assert cap_contributors(df, F.col("c"), F.col("s"), F.col("i"), max_share=0.3).filter("kept").count() == 5
    with pytest.raises(ValueError):
        cap_contributors(df, F.col("c"), F.col("s"), F.col("i"))


@pytest.mark.parametrize("run_rows", [3, 40, 10_000])
def test_cutoffs(spark, run_rows):
    rows = data(run_rows)
    cuts, kept = keep_fraction(frame(spark, rows), *args(), (1, 5), 3, run_rows)
    want = {}
    for g, v in clean(rows).items():
        if len(v) >= 3:
            k = -(-len(v) // 5)
            cut = -v[k - 1][0]
            want[g] = (len(v), k, cut, sum(-s >= cut for s, _ in v))
    assert {r["g"]: (r["n"], r["k"], r["cutoff"], r["kept"]) for r in cuts.collect()} == want
    assert {r["item_id"] for r in kept.collect()} == {i for g, v in clean(rows).items() if g in want for s, i in v if -s >= want[g][2]}


def test_all_scores_tied(spark):
    cuts, kept = keep_fraction(spark.createDataFrame([("a", 1.0, str(k)) for k in range(100)], "g string, s double, i string"), *args(), (1, 5), 1, 10)
    assert cuts.first()["kept"] == 100 and kept.count() == 100


def test_splits_keep_groups_and_shares(spark):
    r = random.Random(5)
    rows = [(f"r{k}", f"p{k % 200 if k > 300 else 0}", None if k % 3 else f"k{r.randint(0, 400)}") for k in range(1500)]
    df = spark.createDataFrame(rows + rows[:50] + [("x", None, None), (None, "p1", None)], "i string, p string, k string")
    got = grouped_splits(df, F.col("i"), [F.col("p"), F.col("k")], {"train": 0.6, "validation": 0.2, "test": 0.2}, bins=20).collect()
    assert len(got) == 1501 and {x["row_id"] for x in got} == {x[0] for x in rows} | {"x"}
    by = {}
    for x in got:
        by.setdefault(x["group_label"], set()).add(x["split"])
    assert all(len(v) == 1 for v in by.values())


def test_split_shares_do_not_depend_on_partitions(spark):
    r = random.Random(7)
    rows = [(f"r{k}", f"p{int(r.paretovariate(1.2) * 3)}" if k % 9 else None, f"k{k // 2}" if k % 5 == 0 else None) for k in range(4000)]
    df = spark.createDataFrame(rows, "i string, p string, k string")
    args = (F.col("i"), [F.col("p"), F.col("k")])
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append({x["row_id"]: (x["group_label"], x["split"]) for x in grouped_splits(df.repartition(int(parts)), *args).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
    largest = max(Counter(g for g, _ in got[0].values()).values())
    n = Counter(s for _, s in got[0].values())
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(n[name] - share * 4000) <= largest + 20
    assert {x["measure"]: x["value"] for x in splits.report(grouped_splits(df, *args)).collect()} == {"rows": 4000, "torn": 0, "off": 0}


def test_balance():
    w = np.random.default_rng(1).pareto(2, 3000) + 0.1
    b = np.bincount(balanced_bins(w, 50), w, 50)
    assert b.max() <= max(w.max(), 1.03 * b.mean()) and b.min() > 0.97 * b.mean()
    one = np.bincount(balanced_bins(np.array([100.0, 1, 1, 1]), 2), [100, 1, 1, 1], 2)
    assert sorted(one) == [3, 100]
    to = allocate(dict(enumerate([1.0] * 100)), [0.8, 0.1, 0.1])
    assert [sum(v == k for v in to.values()) for k in range(3)] == [80, 10, 10]
