"""Per-key results when a few keys hold most rows (problem 5): two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import shuffle_partitions, stored


def salted_profile(
    df: DataFrame, key: Column, row_id: Column, item: Column, score: Column | None = None, salts: int | None = None
) -> DataFrame:
    """One row per key: ``k``, ``n_rows``, ``n_items``, ``best_row``, ``best_score``.

    ``n_rows`` counts distinct row ids, ``n_items`` distinct non-null items, and the best row is the one with
    the highest finite score, then the smallest id (null without a score). The null key has a
    row of its own.

    Stage 1: keys with more rows than an average shuffle partition are heavy; there can be
    no more of them than shuffle partitions, so their list is safe to broadcast. A heavy key
    gets a salt from 0 to ``salts`` - 1, others 0. The salt is a hash of the row id, which
    spreads rows as evenly as a random number, puts copies of a row together, so that
    distinct counts of the salts add up, and is the same when a task runs again. Each (key,
    salt) gives a partial result; stage 2 merges the few partials of a key. Items are
    counted the same way, by (key, item). Repeated rows count once; empty tables give no
    rows; other columns of ``df`` are ignored.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    salts = salts or parts
    s = F.lit(None).cast("double") if score is None else score.cast("double")
    s = F.when(~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))), s)
    rows = df.select(key.alias("k"), row_id.alias("r"), item.alias("i"), s.alias("s")).filter("r IS NOT NULL")
    sizes, _ = stored(rows.groupBy("k").agg(F.count("*").alias("c")), "sizes")
    total = sizes.agg(F.sum("c")).first()[0] or 0
    heavy = sizes.filter(F.col("c") > F.lit(max(1, total // parts))).select(F.col("k").alias("hk"), F.lit(True).alias("hot"))
    salted = rows.join(F.broadcast(heavy), F.col("k").eqNullSafe(F.col("hk")), "left").select(
        "k", "r", "i", "s", F.when(F.col("hot"), F.pmod(F.xxhash64("r"), F.lit(salts))).otherwise(0).cast("int").alias("salt")
    )
    # copies of a row share key and salt: one exchange serves the row and the salt level
    unique = salted.repartition("k", "salt").groupBy("k", "salt", "r").agg(F.max("s").alias("s"))
    partial = unique.groupBy("k", "salt").agg(
        F.count("*").alias("n"),
        F.max("s").alias("bs"),
        F.min_by("r", F.when(F.col("s").isNotNull(), F.struct((-F.col("s")).alias("d"), F.col("r").alias("r")))).alias("br"),
    )
    per_row = partial.groupBy("k").agg(
        F.sum("n").alias("n_rows"),
        F.min_by("br", F.when(F.col("bs").isNotNull(), F.struct((-F.col("bs")).alias("d"), F.col("br").alias("r")))).alias("best_row"),
        F.max("bs").alias("best_score"),
    )
    per_item = rows.filter("i IS NOT NULL").select("k", "i").distinct().groupBy("k").agg(F.count("*").alias("n_items"))
    out = per_row.join(per_item.withColumnRenamed("k", "ik"), F.col("k").eqNullSafe(F.col("ik")), "left")
    return out.select("k", "n_rows", F.coalesce("n_items", F.lit(0)).alias("n_items"), "best_row", "best_score")


def matches_between(left: DataFrame, right: DataFrame, left_cols: tuple[Column, Column, Column], right_cols: tuple[Column, Column, Column]) -> DataFrame:
    """``k``, ``n_matched_items``, ``n_matched_rows`` per key found in both tables.

    Columns are given as (key, item, row id). A match is a key and item that both tables
    have; the number of matched row pairs is the product of the distinct rows on both
    sides, summed over the items, without listing the pairs. The join runs on (key, item),
    already reduced to one row each, so that a heavy key is spread over its items. Null keys,
    items and ids never match.
    """

    def counted(df: DataFrame, cols: tuple[Column, Column, Column], name: str) -> DataFrame:
        k, i, r = cols
        rows = df.select(k.alias("k"), i.alias("i"), r.alias("r")).dropna()
        return rows.distinct().groupBy("k", "i").agg(F.count("*").alias(name))

    both = counted(left, left_cols, "a").join(counted(right, right_cols, "b"), ["k", "i"])
    return both.groupBy("k").agg(F.count("*").alias("n_matched_items"), F.sum(F.col("a") * F.col("b")).alias("n_matched_rows"))


def dominant_keys(profile: DataFrame, share_num: int = 3, share_den: int = 100) -> DataFrame:
    """Keys of a profile that hold at least ``share_num`` / ``share_den`` of its distinct rows.

    Rows of the null key count in the total; the null key itself is not returned.
    """
    total = profile.agg(F.sum("n_rows").alias("t"))
    # one row against the profile
    return profile.filter("k IS NOT NULL").join(F.broadcast(total), F.expr(f"n_rows * {share_den}L >= t * {share_num}L")).select("k", "n_rows")
