"""Data contracts: all conditions of an operator are evaluated in one job, then raised together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(bad: dict[str, DataFrame]) -> None:
    """Raises ValueError naming each condition whose frame of offending rows is not empty."""
    parts = [df.limit(1).select(F.lit(message).alias("message")) for message, df in bad.items()]
    found = [r["message"] for r in reduce(DataFrame.unionAll, parts).collect()]
    if found:
        raise ValueError("; ".join(sorted(found)))


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")


def contract_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that break each condition (null counts as broken)."""
    return df.agg(*[F.sum((~F.coalesce(c, F.lit(False))).cast("long")).alias(n) for n, c in conditions.items()])


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def inconsistent(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys for which a column has a null or more than one value."""
    bad = reduce(lambda a, b: a | b, [(F.min(c) != F.max(c)) | (F.count(c) < F.count("*")) for c in columns])
    return df.groupBy(*keys).agg(bad.alias("bad")).filter("bad").select(*keys)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame that the other lacks, with ``side``; multiplicities count. Empty if equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def safe_relative_path(path: Column) -> Column:
    """A relative path without parent steps, home or drive prefixes."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"^[/\\~]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def safe_job_id(job: Column) -> Column:
    return F.coalesce(job.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"), F.lit(False))


def verified_files(spark, root: str, manifest: DataFrame) -> DataFrame:
    """``path``, ``ok`` of a manifest (``path``, ``sha256``) against the files below ``root``; a missing file is not ok."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    found = files.select(F.element_at(F.split("path", base), -1).alias("path"), F.sha2("content", 256).alias("found"))
    return manifest.join(found, "path", "left").select("path", F.coalesce(F.col("found") == F.lower("sha256"), F.lit(False)).alias("ok"))
