"""Prediction tables, score releases, input checks and job lists of a published benchmark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.checks import require, require_columns, safe_relative_path
from pairloom.operators.integrate import merge_alias


def prediction_frame(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Predictions with ``dataset`` and ``score`` under their present names; ``names`` maps old dataset spellings.

    Old and new columns must agree where both are given; a score that is no number raises.
    """
    out = merge_alias(merge_alias(df, "cohort_arm", "dataset"), "p_allosteric", "score")
    if "dataset" in out.columns and names:
        out = out.replace(names, subset=["dataset"])
    require_columns(out, ["score"])
    return out.withColumn("score", F.col("score").cast("double"))


def select_rows(df: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """Rows with the wanted values; a value of None asks for nothing. Raises if a column or every row is absent."""
    out = df
    for c, v in wanted.items():
        if v is not None:
            require_columns(df, [c])
            out = out.filter(F.col(c) == v)
    if not out.limit(1).count():
        raise ValueError("No rows match the selection")
    return out


def released_scores(pairs: DataFrame, scores: DataFrame, key: str, models: Sequence[str]) -> DataFrame:
    """``pairs`` with one column per model: the score column ``p_..._<model>_mean`` of a release.

    Both tables must hold the same row ids, each once, and each model one such column.
    """
    found = {m: [c for c in scores.columns if c.startswith("p_") and c.endswith(f"_{m}_mean")] for m in models}
    bad = [m for m, c in found.items() if len(c) != 1]
    if bad:
        raise ValueError(f"Ambiguous score columns: {bad}")
    require(
        {
            "Repeated pair": pairs.groupBy(key).count().filter("count > 1"),
            "Repeated score": scores.groupBy(key).count().filter("count > 1"),
            "Row ids differ": pairs.select(key).exceptAll(scores.select(key)).unionAll(scores.select(key).exceptAll(pairs.select(key))),
        }
    )
    return pairs.join(scores.select(key, *[F.col(c[0]).alias(m) for m, c in found.items()]), key)


def with_identity(scores: DataFrame, identity: DataFrame, key: str, names: dict[str, str] | None = None) -> DataFrame:
    """``scores`` with the columns of ``identity`` (unique by ``key``), none of them missing, and columns renamed by ``names``."""
    out = scores.join(identity, key, "left")
    missing = [c for c in identity.columns if c != key]
    require(
        {
            "Repeated identity": identity.groupBy(key).count().filter("count > 1"),
            "Missing pair identity": out.filter(F.greatest(F.lit(False), *[F.col(c).isNull() for c in missing], F.lit(False))),
        }
    )
    for a, b in (names or {}).items():
        out = out.withColumnRenamed(a, b)
    return out


def annotated(df: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """``df`` with the notes of its rows, one to one; rows without a note keep nulls. Raises on a key given twice on either side."""
    require({"Repeated row": df.groupBy(key).count().filter("count > 1"), "Repeated note": notes.groupBy(key).count().filter("count > 1")})
    return df.join(notes, key, "left")


def input_availability(df: DataFrame, files: DataFrame, pockets: DataFrame, models: Sequence[str], ligand: str, protein: str, entity: str) -> DataFrame:
    """``df`` once per model with ``available`` and ``score_status`` (``scored`` or ``input_unavailable``).

    All models but ``protein`` need the row's ligand file, all but ``ligand`` its protein file, and those whose
    name begins with d a pocket of the entity. ``files`` lists ``path``, ``pockets`` the entities that have a non-empty pocket.
    """
    have = files.select("path").dropna().distinct()
    x = df.join(have.select(F.col("path").alias(ligand), F.lit(True).alias("l__")), ligand, "left").join(have.select(F.col("path").alias(protein), F.lit(True).alias("p__")), protein, "left")
    x = x.join(pockets.select(entity).dropna().distinct().withColumn("q__", F.lit(True)), entity, "left").withColumn("model", F.explode(F.array(*map(F.lit, models))))
    ok = lambda c: F.coalesce(F.col(c), F.lit(False))
    model = F.col("model")
    available = ((model == "protein") | ok("l__")) & ((model == "ligand") | ok("p__")) & (~model.startswith("d") | ok("q__"))
    return x.withColumn("available", available).withColumn("score_status", F.when(F.col("available"), "scored").otherwise("input_unavailable")).select(*df.columns, "model", "available", "score_status")


def ensemble_ranks(df: DataFrame, seeds: Sequence[str], entity: str) -> DataFrame:
    """``df`` with ``score`` (mean of the seed columns), ``seed_sd`` (population form) and the average ranks ``global_rank`` and ``within_rank``."""
    from pairloom.operators.ranks import null_safe_join, ranked, tie_table

    n = float(len(seeds))
    mean = sum((F.col(c) for c in seeds), F.lit(0.0)) / n
    x = df.withColumn("score", mean).withColumn("seed_sd", F.sqrt(sum(((F.col(c) - F.col("score")) * (F.col(c) - F.col("score")) for c in seeds), F.lit(0.0)) / n))
    g = ranked(x, [], F.col("score")).select(*x.columns, F.col("rank").alias("global_rank"))
    # equal scores of an entity share a rank, so ranks join back by entity and score
    t = tie_table(x, [entity], F.col("score")).select(entity, "score", (F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)).alias("within_rank"))
    return null_safe_join(g, t, [entity, "score"], "left")


def deployment_epochs(reports: DataFrame, by: Sequence[str], seeds: Sequence[int], folds: int) -> DataFrame:
    """``epochs`` per ``by``: the median of ``best_epoch`` over exactly the fits seeds x folds (``seed``, ``outer_fold``), cut to a whole number; raises otherwise."""
    g = reports.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct("seed", "outer_fold").alias("d"),
        F.min(F.col("seed").isin(*seeds) & F.col("outer_fold").between(0, folds - 1)).alias("ok"), F.median("best_epoch").cast("int").alias("epochs"),
    )
    want = len(seeds) * folds
    require({f"Deployment requires all {want} distinct fits": g.filter((F.col("n") != want) | (F.col("d") != want) | ~F.coalesce("ok", F.lit(False)))})
    return g.select(*by, "epochs")


def deployment_models(index: DataFrame, by: Sequence[str], seeds: int = 3) -> DataFrame:
    """Rows of a model index that are deployed; raises on a repeated path and unless each of ``by`` has ``seeds`` distinct seeds."""
    rows = index.filter("experiment = 'deployment'")
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("seed").alias("d"))
    require({"Repeated path": index.groupBy("path").count().filter("count > 1"), f"Expected {seeds} deployment seeds": g.filter((F.col("n") != seeds) | (F.col("d") != seeds))})
    return rows


JOB_FIELDS = ("job_id", "system_id", "pocket_id", "scoring", "seed", "exhaustiveness", "cpu", "num_modes")


def docking_jobs(jobs: DataFrame, members: DataFrame, root: str) -> DataFrame:
    """The table of a job list (``jobs``) and the members of its archive (``path``, ``is_file``).

    Members must be files at relative paths of the known folders, each once; jobs must be unique, name members
    only, and have a box of three centres and three sizes. ``center`` and ``size`` become one column per axis.
    """
    known = (F.col("path") == "jobs.json") | F.col("path").rlike("^(inputs/receptor/|inputs/ligand/|poses/)")
    used = jobs.select(F.explode(F.array("receptor", "ligand", "pose")).alias("path"))
    require(
        {
            "Unsafe or repeated archive member": members.filter(~safe_relative_path(F.col("path")) | ~F.col("is_file")).select("path").unionAll(members.groupBy("path").count().filter("count > 1").select("path")),
            "Unexpected archive member": members.filter(~known),
            "Missing archived input": used.join(members, "path", "left_anti"),
            "Invalid box": jobs.filter((F.size("center") != 3) | (F.size("size") != 3)),
            "Repeated job": jobs.groupBy("job_id").count().filter("count > 1"),
        }
    )
    at = lambda c: F.concat(F.lit(root.rstrip("/") + "/archive/"), F.col(c)).alias(c)
    axes = [F.col(k)[i].alias(f"{k}_{axis}") for k in ("center", "size") for i, axis in enumerate("xyz")]
    return jobs.select(*JOB_FIELDS, F.col("chembl_id").alias("ligand_id"), F.col("role").alias("ligand_role"), "uniprot", "match_id", at("receptor"), at("ligand"), *axes)


def read_docking_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The ``jobs.json`` of an unpacked archive, one row per job."""
    return spark.read.json(path, multiLine=True)


def add_scaffolds(df: DataFrame, key: str, smiles: str, scaffold) -> DataFrame:
    """``df`` with ``murcko_scaffolds_json``: the sorted distinct non-empty scaffolds of all structures of its key.

    ``scaffold`` is a function from a structure column to a scaffold column (null raises); chemistry is not part of this library.
    """
    s = df.select(key, smiles).distinct().withColumn("s__", scaffold(F.col(smiles)))
    require({"Invalid structure": s.filter(F.col("s__").isNull() & F.col(smiles).isNotNull())})
    sets = s.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("s__") != "", F.col("s__")))).alias("v__"))
    quoted = F.transform("v__", lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit(chr(34)), F.lit("\\" + chr(34))))
    out = sets.select(key, F.when(F.size("v__") == 0, "[]").otherwise(F.concat(F.lit(chr(91) + chr(34)), F.array_join(quoted, chr(34) + ", " + chr(34)), F.lit(chr(34) + chr(93)))).alias("murcko_scaffolds_json"))
    return df.drop("murcko_scaffolds_json").join(out, key, "left")


def two_classes(df: DataFrame, by: Sequence[str], label: str) -> None:
    """Raises unless each of ``by`` (the whole table without) has both labels."""
    g = df.groupBy(*by).agg(F.count_distinct(label).alias("n")) if by else df.agg(F.count_distinct(label).alias("n"))
    require({"Both labels are needed": g.filter("n <> 2")})


def validate_temporal(df: DataFrame, year: str, cutoff: int, row_id: str, pair: Sequence[str], label: str) -> DataFrame:
    """``df``, if its row ids and pairs are unique, all years known and at most ``cutoff``, and both labels present; else raises with every reason."""
    require(
        {
            "Repeated row": df.groupBy(row_id).count().filter("count > 1"),
            "Repeated pair": df.groupBy(*pair).count().filter("count > 1"),
            "Undated records": df.filter(F.col(year).isNull()),
            "Future labels": df.filter(F.col(year) > cutoff),
            "Both labels are needed": df.agg(F.count_distinct(label).alias("n")).filter("n <> 2"),
        }
    )
    return df


def disagreements(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``keys``, ``field``, ``left``, ``right`` where joined records differ in a field or one side lacks it.

    ``fields`` maps a name to the column of each side; an empty result is agreement.
    """
    j = left.alias("l").join(right.alias("r"), list(keys))
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), text("l", a).alias("left"), text("r", b).alias("right")) for n, (a, b) in fields.items()])).alias("x")
    return j.select(*keys, x).select(*keys, "x.*").filter(F.col("left").isNull() | F.col("right").isNull() | (F.col("left") != F.col("right")))


def one_to_one(chosen: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``problem`` (repeated, missing, extra) of records that do not match one to one; empty if all do."""
    out = None
    for side in (chosen, other):
        r = side.groupBy(*keys).count().filter("count > 1").select(*keys, F.lit("repeated").alias("problem"))
        out = r if out is None else out.unionByName(r)
    missing = chosen.select(*keys).join(other.select(*keys), list(keys), "left_anti").withColumn("problem", F.lit("missing"))
    extra = other.select(*keys).join(chosen.select(*keys), list(keys), "left_anti").withColumn("problem", F.lit("extra"))
    return out.unionByName(missing).unionByName(extra)


def label_population(df: DataFrame, label: str, *flags: str) -> DataFrame:
    """Rows with a label of 0 or 1 and all flags 1."""
    ok: Column = F.col(label).isin(0, 1)
    for f in flags:
        ok = ok & (F.col(f) == 1)
    return df.filter(F.coalesce(ok, F.lit(False)))
