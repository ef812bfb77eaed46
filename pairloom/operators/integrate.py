"""Exact-pair integration of source records, novelty flags, alias merging and seed ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranks import null_safe_join

INCHIKEY = r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$"
SEP = "|"


def pair_id(a: Column, b: Column) -> Column:
    """``PAIR_`` and 20 hex digits of the SHA-256 of both keys joined by a bar."""
    return F.concat(F.lit("PAIR_"), F.substring(F.sha2(F.concat_ws(SEP, a, b), 256), 1, 20))


def json_pair_id(a: Column, b: Column) -> Column:
    """The same over the compact JSON array of both keys."""
    return F.concat(F.lit("PAIR_"), F.substring(F.sha2(F.to_json(F.array(a, b)), 256), 1, 20))


def resolved(df: DataFrame, structure_ok: Column | None = None) -> DataFrame:
    """``df`` with ``resolved``: complete, a well-formed structure key, label 0 or 1 and the optional structure check."""
    ok = F.col("full_inchikey").rlike(INCHIKEY) & F.col("uniprot").isNotNull() & F.col("canonical_smiles").isNotNull() & F.col("binary_label").isin(0, 1)
    return df.withColumn("resolved", F.coalesce(ok & (structure_ok if structure_ok is not None else F.lit(True)), F.lit(False)))


def integrate(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, conflicts) of resolved records: ``source``, ``source_record_id``, ``uniprot``,
    ``full_inchikey``, ``canonical_smiles``, ``binary_label``.

    A pair with two labels is a conflict and comes with its label counts; others give one row with the
    shortest, then first SMILES, the sorted sources and the number of records. A record
    delivered twice counts once. One aggregate on the pair does both.
    """
    rows = records.select("source", "source_record_id", "uniprot", "full_inchikey", "canonical_smiles", "binary_label").distinct()
    g = rows.groupBy("uniprot", "full_inchikey").agg(
        F.min("binary_label").alias("lo"), F.max("binary_label").alias("hi"),
        F.min(F.struct(F.length("canonical_smiles").alias("n"), F.col("canonical_smiles").alias("s"))).getField("s").alias("canonical_smiles"),
        F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"),
        F.count("*").alias("source_records"), F.sum(F.col("binary_label").cast("long")).alias("positives"),
    )
    pairs = g.filter("lo = hi").select(
        pair_id(F.col("uniprot"), F.col("full_inchikey")).alias("main_row_id"), "uniprot", "full_inchikey",
        F.substring("full_inchikey", 1, 14).alias("connectivity_key"), F.col("lo").alias("binary_label"), "canonical_smiles", "sources", "source_records",
    )
    conflicts = g.filter("lo <> hi").select("uniprot", "full_inchikey", "source_records", "positives", "sources")
    return pairs, conflicts


def novelty(df: DataFrame, training: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """``df`` with ``training_pair``, ``a_unseen``, ``b_unseen``, ``both_unseen`` against a training table.

    Joins run on distinct keys; Spark broadcasts them when they are small. Null keys are unseen.
    """
    out = df
    for name, cols in (("p__", [a, b]), ("a__", [a]), ("b__", [key])):
        seen = training.select(*cols).dropna().distinct().withColumn(name, F.lit(True))
        out = out.join(seen, cols, "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(
        *df.columns, known("p__").alias("training_pair"), (~known("a__")).alias("a_unseen"), (~known("b__")).alias("b_unseen"), (~known("a__") & ~known("b__")).alias("both_unseen")
    )


def merge_alias(df: DataFrame, old: str, new: str) -> DataFrame:
    """Renames ``old`` to ``new``; if both exist they must agree, nulls included, else ValueError."""
    if old not in df.columns:
        return df
    if new not in df.columns:
        return df.withColumnRenamed(old, new)
    from pairloom.operators.checks import require

    require({f"Conflicting {old} and {new}": df.filter(~F.col(old).eqNullSafe(F.col(new)))})
    return df.drop(old)


def finite_in_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every column is a finite number; text that is no number counts as missing."""
    out = df
    for c in columns:
        v = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        out = out.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return out


def ensemble(df: DataFrame, keys: Sequence[str], seed: str, score: str, metadata: Sequence[str] = (), seeds: int = 3) -> DataFrame:
    """Mean ``score`` and ``seed_sd`` per key; raises unless each key has ``seeds`` distinct seeds and constant metadata."""
    from pairloom.operators.checks import require

    g = df.groupBy(*keys).agg(
        F.count("*").alias("n__"), F.count_distinct(seed).alias("d__"), F.avg(score).alias("score__"), F.stddev_samp(score).alias("seed_sd"),
        *[F.min(c).alias(c) for c in metadata],
        F.greatest(F.lit(False), *[F.coalesce(F.min(c) != F.max(c), F.lit(False)) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))) for c in metadata], F.lit(False)).alias("mixed__"),
    )
    require({f"Ensemble requires {seeds} seeds with consistent metadata": g.filter((F.col("n__") != seeds) | (F.col("d__") != seeds) | F.col("mixed__"))})
    return g.select(*keys, *metadata, F.col("score__").alias("score"), "seed_sd")


def average_identical_inputs(df: DataFrame, applies: Column, group: Sequence[str], score: str = "score", tolerance: float = 0.01) -> DataFrame:
    """Rows to which ``applies`` get the mean score of their group; raises if a group spreads more than the tolerance."""
    from pairloom.operators.checks import require

    g = df.filter(applies).groupBy(*group).agg(F.avg(score).alias("m__"), (F.max(score) - F.min(score)).alias("span__"))
    require({"Identical inputs differ by more than the tolerance": g.filter(F.col("span__") > tolerance)})
    x = null_safe_join(df, g.drop("span__"), group, "left")
    return x.withColumn(score, F.when(applies, F.col("m__")).otherwise(F.col(score))).drop("m__")


def complete_grid(df: DataFrame, keys: Sequence[str], score: str, expected: int) -> DataFrame:
    """Rows of the keys that have exactly ``expected`` rows, all with a finite score."""
    ok = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    full = df.groupBy(*keys).agg(F.count("*").alias("n__"), F.min(ok).alias("ok__")).filter((F.col("n__") == expected) & F.col("ok__"))
    return df.join(full.select(*keys), list(keys), "left_semi")
