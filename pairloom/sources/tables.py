"""Text tables, side files and manifests, in and out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: texts that stand for a missing value
MISSING = ("NA", "NaN", "nan", "null", "NULL", "N/A", "n/a", "None", "")


def read_tsv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """TSV, gzip or not, with a header; typed by ``schema``, the MISSING texts and NaN read as null.

    Columns are read as text first, so that ids keep leading zeros and a missing mark in a number column is
    no error; text that is no number raises.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    df = spark.read.csv(list(paths) if not isinstance(paths, str) else paths, sep="\t", header=True, schema=raw, quote="", enforceSchema=False)
    return df.select(*[typed(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields])


def typed(c, dtype):
    v = F.when(~c.isin(*MISSING), c).cast(dtype)
    return F.when(~F.isnan(v), v) if isinstance(dtype, T.DoubleType | T.FloatType) else v


def read_many(spark: SparkSession, paths: Sequence[str], schemas: Sequence[T.StructType]) -> DataFrame:
    """Union by name of tables that may lack some columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_tsv(spark, p, s) for p, s in zip(paths, schemas)])


def write_tsv(df: DataFrame, path: str, compression: str = "gzip", partition_by: Sequence[str] = ()) -> None:
    """TSV parts with header and ``NA``; refuses an existing folder."""
    out = df.write.mode("errorifexists")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.csv(path, sep="\t", header=True, nullValue="NA", compression=compression, quote="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def read_index_map(spark: SparkSession, path: str, key: str = "entity", value: str = "place") -> DataFrame:
    """A JSON object of integer lists as rows (key, value)."""
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,array<int>>")
    return text.select(F.explode(m).alias(key, "p__")).select(key, F.explode("p__").alias(value))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Distinct white-space separated tokens of a text file."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("token")).filter("token <> ''").distinct()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``sha256``, ``path`` of a checksum file (two columns, an optional star before the path)."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+\*?", 2).alias("p")).filter("size(p) = 2")
    return t.select(F.lower(F.col("p")[0]).alias("sha256"), F.col("p")[1].alias("path"))


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """``key``, ``value`` of ``key=value`` tokens."""
    t = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("t")).filter("t LIKE '%=%'")
    return t.select(F.substring_index("t", "=", 1).alias("key"), F.expr("substr(t, instr(t, '=') + 1)").alias("value"))
