import random

from pyspark.sql import functions as F

from pairloom.operators import ranks
from pairloom.operators.positions import grouped_positions

SCHEMA = "g string, s double, i string, w long"


def rows(seed, n=400):
    r = random.Random(seed)
    # one group holds most rows; scores tie
    return [(r.choice(["a"] * 6 + ["b", "c", None]), float(r.randint(0, 9)), f"r{k:04d}", r.randint(0, 3)) for k in range(n)]


def brute(data):
    out, seen, total = {}, {}, {}
    for g, s, i, w in sorted(data, key=lambda x: (x[0] is None, x[0] or "", -x[1], x[2])):
        seen[g] = seen.get(g, 0) + 1
        total[g] = total.get(g, 0) + w
        out[i] = (seen[g], total[g])
    return out


def test_positions_and_sums(spark):
    for seed, parts in ((1, 1), (2, 5), (3, 17)):
        data = rows(seed)
        df = spark.createDataFrame(data, SCHEMA).repartition(3)
        got = grouped_positions(df, F.col("g"), [(F.col("s"), True), (F.col("i"), False)], sums={"t": F.col("w")}, partitions=parts).collect()
        assert {r["o1"]: (r["pos"], r["t"]) for r in got} == brute(data)


def test_copies_count_once_and_up_to(spark):
    data = rows(4)
    df = spark.createDataFrame(data + data[:150], SCHEMA)
    got = grouped_positions(df, F.col("g"), [(F.col("s"), True), (F.col("i"), False)], distinct=True, up_to=7, partitions=9).collect()
    assert {r["o1"]: r["pos"] for r in got} == {i: p for i, (p, _) in brute(data).items() if p <= 7}


def test_empty_and_single_group(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert grouped_positions(empty, F.col("g"), [(F.col("i"), False)]).count() == 0
    one = spark.createDataFrame([("a", 1.0, f"{k:03d}", 1) for k in range(50)], SCHEMA)
    got = grouped_positions(one, F.col("g"), [(F.col("i"), False)], partitions=8).collect()
    assert sorted(r["pos"] for r in got) == list(range(1, 51))


def test_average_rank_with_ties_nan_and_null(spark):
    df = spark.createDataFrame([("a", 1.0, "1", 0), ("a", 2.0, "2", 0), ("a", 2.0, "3", 0), ("a", float("nan"), "4", 0), ("a", None, "5", 0), (None, 3.0, "6", 0)], SCHEMA)
    got = {r["i"]: (r["rank"], r["n_scored"]) for r in ranks.ranked(df, ["g"], F.col("s")).collect()}
    assert got["2"] == got["3"] == (1.5, 3) and got["1"] == (3.0, 3) and got["4"][0] is None and got["5"][0] is None and got["6"] == (1.0, 1)


def test_fractional_weights_sum_to_k(spark):
    df = spark.createDataFrame([("a", float(k // 7), str(k), 0) for k in range(40)], SCHEMA)
    w = ranks.fractional_top(df, ["g"], F.col("s"), 0.1).agg(F.sum("weight")).first()[0]
    assert abs(w - 4) < 1e-12


def test_percentile_rank(spark):
    df = spark.createDataFrame([("a", v, str(k), 0) for k, v in enumerate((1.0, 2.0, 2.0, 4.0))], SCHEMA)
    assert sorted(r["pct"] for r in ranks.percentile_rank(df, ["g"], F.col("s")).collect()) == [0.25, 0.625, 0.625, 1.0]
