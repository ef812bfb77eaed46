"""Capping records per dominant contributor (problem 3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.graph import components
from pairloom.operators.keys import finite
from pairloom.operators.positions import grouped_positions
from pairloom.session import drop_stored, stored, written

ALONE = 1_000_000  # open proposals of contributors that are linked, up to which one task settles them in order

def cap_contributors(
    df: DataFrame,
    contributors: Column,
    score: Column,
    item: Column,
    max_records: int | None = None,
    max_share: float | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``item_id`` and ``kept`` (BOOLEAN) for every scored record with a contributor.

    ``contributors`` is an ARRAY of the record's contributors. A kept record takes one place
    at each of them, and no contributor gives more places than ``max_records``, or
    floor(``max_share`` x records), whichever is lower. Suitor b-matching: each record
    proposes to all contributors it lists; a contributor holds its best proposals (score
    descending, then item ascending) up to its capacity and displaces the weakest. A record
    held by all is kept. One that a contributor turns down for records that are themselves
    settled is left out, withdraws its other proposals, and the places go to the next best
    in the following round. The result is that of going through the records from best to
    worst and keeping each one whose contributors all have a place left.

    A contributor's proposals are ranked by exact distributed positions, so it may hold any
    share of the rows. Records with a single contributor need no exchange between
    contributors: a table of only those is settled in one round. Where records wait for each other in long
    chains, rounds would be many: after the second round the contributors linked by open
    records are found as connected components (a number of steps logarithmic in the chain), and each component with up
    to ALONE open proposals is settled by one task; only larger ones take further rounds.
    Rounds are written to the shared folder, and what is superseded is dropped.

    Null and repeated entries of the array count once, and so do rows equal in item, score
    and contributors; rows of one item that differ in those are records of their own. Rows
    with a null item, no contributor or a score that is not finite take no part. An empty
    table gives no rows. ``max_records`` of 0 leaves all records out.
    """
    spark = df.sparkSession
    if max_records is None and max_share is None:
        raise ValueError("max_records or max_share is needed")
    s = finite(score)
    base = df.select(
        item.alias("i"), s.alias("s"), F.array_sort(F.array_distinct(F.filter(contributors, lambda c: c.isNotNull()))).alias("c")
    ).filter(F.col("i").isNotNull() & F.col("s").isNotNull() & (F.size("c") > 0))
    cap = max_records
    if max_share is not None:
        limit = int(base.distinct().count() * max_share + 1e-9)
        cap = limit if cap is None else min(cap, limit)
    links = F.size("c")
    edges = base.select(
        "i", "s", links.alias("links"), F.when(links > 1, F.xxhash64("c")).otherwise(0).alias("k"), F.explode("c").alias("c"), F.lit(False).alias("held")
    )

    settled: list[DataFrame] = []
    path, rounds = None, 0
    while True:
        rounds += 1
        ranked = grouped_positions(
            edges,
            F.col("c"),
            [(F.col("s"), True), (F.col("i"), False), (F.col("k"), False)],
            distinct=True,
            carry={"links": F.col("links"), "held": F.col("held"), "sure": ((F.col("links") == 1) | F.col("held")).cast("long")},
            sums={"ahead": ((F.col("links") == 1) | F.col("held")).cast("long")},
            partitions=partitions,
        )
        seen = ranked.select(
            F.col("g").alias("c"),
            F.col("o0").alias("s"),
            F.col("o1").alias("i"),
            F.col("o2").alias("k"),
            "links",
            "held",
            (F.col("pos") <= cap).alias("placed"),
            # places that are surely taken by better records
            (F.col("ahead") - F.col("sure") >= cap).alias("barred"),
        )
        single = seen.filter("links = 1 AND (placed OR barred)")
        settled.append(single.filter("NOT held").select("i", F.col("placed").alias("kept")))
        many = seen.filter("links > 1")
        if not many.limit(1).count():
            break  # with single contributors only, placed or barred holds for every record
        verdict, vpath = stored(
            many.groupBy("i", "s", "k").agg(F.min("placed").alias("kept"), F.max("barred").alias("out"), F.max("held").alias("was")), "verdict"
        )
        settled.append(verdict.filter("(kept OR out) AND NOT was").select("i", "kept"))
        open_records = verdict.filter("NOT kept AND NOT out").limit(1).count()
        open_singles = seen.filter("links = 1 AND NOT placed AND NOT barred").limit(1).count()
        if not open_records and not open_singles:
            break
        # settled records that were kept stay as holders; those left out withdraw
        after = (
            seen.join(verdict.select("i", "s", "k", "kept", "out"), ["i", "s", "k"], "left")
            .filter("CASE WHEN links = 1 THEN NOT barred ELSE NOT out END")
            .select("i", "s", "k", "links", "c", F.when(F.col("links") == 1, F.col("placed")).otherwise(F.col("kept")).alias("held"))
        )
        edges, new_path = stored(after, "proposals")
        drop_stored(spark, path)
        path = new_path
        if rounds > 1:
            small, edges = _settle_components(edges, cap)
            settled.append(small)
            if not edges.filter("NOT held").limit(1).count():
                break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(F.col("i").alias("item_id"), "kept")


def _settle_components(edges: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(``i``, ``kept`` of the records in components of up to ALONE open proposals, the edges of the others).

    A held record takes a place at each contributor whatever becomes of the open ones, so the
    open ones of a component go from best to worst through the places that are left.
    """
    open_ = edges.filter("NOT held")
    links = open_.filter("links > 1").groupBy("i", "s", "k").agg(F.min("c").alias("a"), F.collect_set("c").alias("all")).select("a", F.explode("all").alias("b"))
    label = components(links.unionByName(open_.select(F.col("c").alias("a"), F.col("c").alias("b")))).withColumnRenamed("node", "c")
    held = edges.filter("held").groupBy("c").agg(F.count("*").alias("taken"))
    todo = written(open_.join(label, "c").join(held, "c", "left").withColumn("room", F.lit(cap) - F.coalesce("taken", F.lit(0))), "open")
    sizes = todo.groupBy("label").agg(F.count("*").alias("n"))
    kind = edges.schema["i"].dataType.simpleString()

    def settle(df: pd.DataFrame) -> pd.DataFrame:
        room = dict(zip(df["c"], df["room"]))
        df = df.sort_values(["s", "i", "k"], ascending=[False, True, True], kind="stable")
        out = []
        for i, group in _records(df):
            kept = all(room[c] > 0 for c in group)
            if kept:
                for c in group:
                    room[c] -= 1
            out.append((i, kept))
        return pd.DataFrame(out, columns=["i", "kept"])

    small = todo.join(sizes.filter(F.col("n") <= ALONE).select("label"), "label")
    done = written(small.select("label", "i", "s", "k", "c", "room").groupBy("label").applyInPandas(settle, f"i {kind}, kept boolean"), "settled")
    large = label.join(sizes.filter(F.col("n") > ALONE), "label", "left_semi").select("c")
    return done, edges.join(large, "c", "left_semi").select(edges.columns)


def _records(df: pd.DataFrame):
    """(item, contributors) of successive rows that agree in item, score and mark; the rows are sorted by these."""
    last, own = None, []
    for i, s, k, c in zip(df["i"], df["s"], df["k"], df["c"]):
        if (i, s, k) != last:
            if own:
                yield last[0], own
            last, own = (i, s, k), []
        own.append(c)
    if own:
        yield last[0], own


def report(df: DataFrame, contributors: Column, score: Column, item: Column, max_records: int, result: DataFrame) -> DataFrame:
    """``records``, ``wrong`` of :func:`cap_contributors` on a table of unique items.

    A record has to be kept if and only if each of its contributors has fewer than ``max_records`` better
    records that are kept. Only one set of records has this property. ``wrong`` counts the records against it.
    """
    s = finite(score)
    c = F.array_distinct(F.filter(contributors, lambda x: x.isNotNull()))
    base = df.select(item.alias("i"), s.alias("s"), c.alias("c")).filter("i IS NOT NULL AND s IS NOT NULL AND size(c) > 0").distinct()
    rows = base.join(result.select(F.col("item_id").alias("i"), "kept"), "i", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    ranked = grouped_positions(
        rows.select("i", "s", "kept", F.explode("c").alias("c")), F.col("c"), [(F.col("s"), True), (F.col("i"), False)],
        carry={"kept": F.col("kept")}, sums={"better": F.col("kept").cast("long")},
    )
    free = ranked.withColumn("free", F.col("better") - F.col("kept").cast("long") < max_records)
    per = free.groupBy("o1").agg(F.min("free").alias("free"), F.max("kept").alias("kept"))
    return per.agg(F.count("*").alias("records"), F.count_if(F.col("free") != F.col("kept")).alias("wrong"))
