"""Connected components and the groups of records they induce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` of every node of ``edges`` (columns ``a``, ``b``); the label is the
    smallest node of the component.

    Alternating large-star and small-star steps, each a grouped minimum and an equi-join;
    the number of edges never grows and a chain shrinks geometrically. Every round is
    written to the shared folder. Edges with a null end are ignored; loops keep their node.
    """
    spark = edges.sparkSession
    e = edges.select("a", "b").dropna()
    start = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, path = stored(start, "stars")
    nodes = state  # the first table names every node
    before = None
    while True:
        both = state.filter("u <> v").select("u", "v").unionByName(state.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("x")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = (
            large.join(low2, F.col("u") == F.col("x"))
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        new, new_path = stored(small, "stars")
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if before is not None:
            drop_stored(spark, path)
        state, path = new, new_path
        if mark == before:
            break
        before = mark
    # stars now: every node that is not a label points at its label
    tops = nodes.select(F.col("v").alias("node")).unionByName(nodes.select(F.col("u").alias("node"))).distinct()
    return tops.join(state.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select(
        "node", F.coalesce("label", "node").alias("label")
    )


def related_groups(df: DataFrame, row_id: Column, links: Sequence[Column]) -> DataFrame:
    """``row_id``, ``group_label`` for every distinct row id.

    Rows belong together if they agree in the value of a link column, directly or through
    other rows. ``group_label`` is ``<i>:<value>``: the smallest value of the first link
    column that the group has a value of. A null value links nothing; a row without any
    value is its own group, labelled ``~:<row id>``. Rows repeated under one id count once, and if
    they differ, all their values link. Null row ids are ignored. Other columns are ignored.
    """
    nodes = F.filter(F.array(*[F.concat(F.lit(f"{i}:"), c.cast("string")) for i, c in enumerate(links)]), lambda x: x.isNotNull())
    records, _ = stored(
        df.select(row_id.alias("row_id"), nodes.alias("n"))
        .filter("row_id IS NOT NULL")
        .groupBy("row_id")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("n")))).alias("n")),
        "records",
    )
    edges, path = stored(records.filter("size(n) > 0").select(F.col("n")[0].alias("a"), F.explode("n").alias("b")).distinct(), "edges")
    # the first nodes that share a value are all linked to the smallest of them: values that only one first node has,
    # most as a rule, drop out before the rounds, and a value that many have is one star
    low = edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("c")).filter("c > 1").select("b", "m")
    linked = edges.join(low, "b").filter("a <> m").select("a", F.col("m").alias("b")).distinct()
    labels = components(linked)
    return records.select("row_id", F.expr("get(n, 0)").alias("node")).join(labels, "node", "left").select(
        "row_id", F.coalesce("label", "node", F.concat(F.lit("~:"), F.col("row_id").cast("string"))).alias("group_label")
    )
