"""Fixed-column structure files, collective-variable logs and array stores, parsed with Spark expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: names that structure files use for solvent, and atom types of hydrogen
SOLVENT = ("HOH", "WAT", "SOL", "NA", "CL", "Na+", "Cl-")
HYDROGEN_TYPES = ("H", "HD", "HS")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_no``, ``line``; a file is one row before it is split, as order matters inside it."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("l"))
    return t.select("file", F.posexplode("l").alias("line_no", "line"))


def _number(line: str, start: int, length: int) -> Column:
    return F.expr(f"try_cast(trim(substr({line}, {start}, {length})) AS DOUBLE)")


def _atom_columns() -> list[Column]:
    return [
        F.trim(F.substring("line", 13, 4)).alias("atom"), F.trim(F.substring("line", 18, 3)).alias("res_name"), F.trim(F.substring("line", 22, 1)).alias("chain"),
        F.expr("try_cast(trim(substr(line, 23, 4)) AS INT)").alias("res_no"), _number("line", 31, 8).alias("x"), _number("line", 39, 8).alias("y"), _number("line", 47, 8).alias("z"),
    ]


def read_pdb(spark: SparkSession, path: str, keep_hydrogen: bool = False) -> DataFrame:
    """Atoms of PDB files without solvent: ``file``, ``line_no``, ``atom``, ``res_name``, ``chain``, ``res_no``, ``x``, ``y``, ``z``."""
    a = _lines(spark, path).filter(F.substring("line", 1, 6).isin("ATOM  ", "HETATM")).select("file", "line_no", *_atom_columns())
    a = a.filter(~F.col("res_name").isin(*SOLVENT))
    return a if keep_hydrogen else a.filter(~F.col("atom").rlike("^[0-9]*H"))


def read_pose(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(poses, atoms) of PDBQT files, first model only.

    poses: ``file``, ``score`` of the result remark, ``heavy_atoms``, ``dummies`` (glue atoms G0, G1, ..).
    atoms: ``file``, ``x``, ``y``, ``z`` of the heavy atoms.
    """
    lines = _lines(spark, path)
    end = lines.filter("line LIKE 'ENDMDL%'").groupBy("file").agg(F.min("line_no").alias("end"))
    first = lines.join(end, "file", "left").filter("end IS NULL OR line_no < end")
    score = first.filter("line LIKE 'REMARK VINA RESULT:%'").groupBy("file").agg(F.expr("min_by(try_cast(split(trim(line), ' +')[3] AS DOUBLE), line_no)").alias("score"))
    atoms = first.filter(F.substring("line", 1, 6).isin("ATOM  ", "HETATM")).withColumn("type", F.element_at(F.split(F.trim("line"), r"\s+"), -1))
    dummy = F.col("type").rlike(r"^G\d+$")
    heavy = atoms.filter(~dummy & ~F.col("type").isin(*HYDROGEN_TYPES)).select("file", *_atom_columns()[-3:])
    n = atoms.groupBy("file").agg(F.count_if(~dummy & ~F.col("type").isin(*HYDROGEN_TYPES)).alias("heavy_atoms"), F.count_if(dummy).alias("dummies"))
    return score.join(n, "file", "full"), heavy


def read_mol2(spark: SparkSession, path: str) -> DataFrame:
    """Heavy atoms of the ATOM section of MOL2 files: ``file``, ``atom``, ``type``, ``x``, ``y``, ``z``."""
    lines = _lines(spark, path)
    tags = lines.filter("line LIKE '@<TRIPOS>%'").groupBy("file").agg(
        F.min(F.when(F.col("line") == "@<TRIPOS>ATOM", F.col("line_no"))).alias("a"), F.array_sort(F.collect_list("line_no")).alias("all")
    )
    x = lines.join(tags, "file").withColumn("b", F.array_min(F.filter("all", lambda v: v > F.col("a")))).filter("line_no > a AND (b IS NULL OR line_no < b) AND trim(line) <> ''")
    p = F.split(F.trim("line"), r"\s+")
    x = x.select("file", F.get(p, F.lit(1)).alias("atom"), F.get(p, F.lit(5)).alias("type"), *[F.get(p, F.lit(i + 2)).cast("double").alias(c) for i, c in enumerate("xyz")])
    return x.filter("type IS NOT NULL AND type <> 'H' AND type NOT LIKE 'H.%'")


def read_colvar(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_no``, ``fields`` (name to value) of logs whose header line is ``#! FIELDS a b c``."""
    lines = _lines(spark, path)
    head = lines.filter("line LIKE '#! FIELDS%'").groupBy("file").agg(F.min_by("line", "line_no").alias("h"))
    names = F.slice(F.split(F.trim("h"), r"\s+"), 3, 1000)
    v = F.transform(F.split(F.trim("line"), r"\s+"), lambda s: s.cast("double"))
    rows = lines.filter("line NOT LIKE '#%' AND trim(line) <> ''").join(head, "file")
    return rows.select("file", "line_no", F.map_from_arrays(names, v).alias("fields"))


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """``k``, ``step``, ``at``, ``kappa`` of lines ``STEPk=.. ATk=a,b KAPPAk=c,d``."""
    one = lambda name, i: F.regexp_extract("line", rf"(?:^|\s){name}(\d+)=(\S+)", i)
    x = _lines(spark, path).filter(F.col("line").rlike(r"(?:^|\s)STEP\d+="))
    nums = lambda c: F.transform(F.split(c, ","), lambda v: v.cast("double"))
    return x.select(one("STEP", 1).cast("int").alias("k"), one("STEP", 2).cast("long").alias("step"), nums(one("AT", 2)).alias("at"), nums(one("KAPPA", 2)).alias("kappa"))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``name``, ``values`` of the arrays in NPZ files; pickled objects are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for name in z.files:
                        yield pd.DataFrame({"file": [file], "name": [name], "values": [z[name].astype(float).ravel()]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, name string, values array<double>")
