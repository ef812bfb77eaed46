"""Role-based cohorts, held-out partitions and time splits of labelled pairs.

All operators are parametric in column names and return DataFrames; removal of related rows is a
chain of anti joins on distinct keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import drop_stored, stored, written


def both_roles(df: DataFrame, identity: str, label: str = "y") -> DataFrame:
    """Rows whose identity occurs with both labels; a null identity never does.

    The identities are found by a partial aggregate and joined back, so that an identity with many rows is never
    collected in one window.
    """
    two = df.groupBy(identity).agg(F.min(label).alias("a__"), F.max(label).alias("b__")).filter("a__ <> b__").select(identity)
    return df.join(two, identity, "left_semi")


def role_fixpoint(df: DataFrame, identities: Sequence[str], label: str = "y") -> tuple[DataFrame, list[int]]:
    """Alternates :func:`both_roles` over the identities until no row goes; with the rows left after each round."""
    state, history = written(df, "roles"), []
    history.append(state.count())
    spark, path = df.sparkSession, None
    while True:
        new = state
        for i in identities:
            new = both_roles(new, i, label)
        new, new_path = stored(new, "roles")
        drop_stored(spark, path)
        path = new_path
        history.append(new.count())
        if history[-1] == history[-2]:
            return new, history
        state = new


def construct_datasets(df: DataFrame, eligible: Column, protein: str = "u", ligand: str = "k", label: str = "y", checked: bool = True) -> DataFrame:
    """``df`` once for each of the cohorts it belongs to, named in ``dataset``.

    ``every_pair`` has all rows, ``both_class_proteins`` the frozen (``eligible``) ones, ``both_class_ligands``
    those whose ligand has both labels, and ``both_class_proteins_ligands`` what alternating both rules
    leaves of the frozen rows. With ``checked``, raises where a frozen protein lacks a label.
    """
    from pairloom.operators.checks import require

    frozen = df.filter(F.coalesce(eligible, F.lit(False)))
    if checked:
        require({"Frozen membership must retain both labels": frozen.groupBy(protein).agg(F.count_distinct(label).alias("n")).filter("n <> 2")})
    parts = {
        "every_pair": df, "both_class_proteins": frozen, "both_class_ligands": both_roles(df, ligand, label),
        "both_class_proteins_ligands": role_fixpoint(frozen, [protein, ligand], label)[0],
    }
    return _named(parts)


def complete_cohorts(df: DataFrame, protein: str = "u", ligand: str = "k", label: str = "y") -> tuple[DataFrame, list[int]]:
    """(``df`` once per cohort, rows left of the last cohort after each round), from labels alone.

    The last cohort starts with the proteins that have both labels, then the ligands among them.
    """
    p = both_roles(df, protein, label)
    both, history = role_fixpoint(both_roles(p, ligand, label), [protein, ligand], label)
    return _named({"every_pair": df, "both_class_proteins": p, "both_class_ligands": both_roles(df, ligand, label), "both_class_proteins_ligands": both}), history


def _named(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, part in parts.items():
        own = part.withColumn("dataset", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def temporal_cohorts(df: DataFrame, year: str, cutoff: int, pair: Sequence[str], protein: str = "u", ligand: str = "k", label: str = "y") -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of a time split: the cohorts of the early rows with their chronological validation, and the later test.

    rows: ``df`` with ``dataset`` and ``part``: train or validation in a cohort, and test, unknown and removed with
    the dataset ``later``. counts: per dataset and part (``refit`` is train and validation
    together) rows, positives, distinct entities and the boundary year. Raises on undated or later rows in a cohort,
    single-label cohorts, and cohorts without a boundary.
    """
    from pairloom.operators.checks import require

    split = written(time_split(df, year, cutoff, pair), "split")
    cohorts, _ = complete_cohorts(split.filter("part = 'early'").drop("part"), protein, ligand, label)
    cohorts = written(cohorts, "cohorts")
    bound = written(chronological_boundary(cohorts, year, label, ["dataset"]), "boundaries")
    require(
        {
            "Undated or later rows": cohorts.filter(F.col(year).isNull() | (F.col(year) > cutoff)),
            "A cohort needs both labels": cohorts.groupBy("dataset").agg(F.count_distinct(label).alias("n")).filter("n <> 2"),
            "No chronological validation with both labels": cohorts.select("dataset").distinct().join(bound, "dataset", "left_anti"),
        }
    )
    dated = cohorts.join(F.broadcast(bound), "dataset").withColumn("part", F.when(F.col(year) <= F.col("boundary"), "train").otherwise("validation"))
    later = split.filter("part <> 'early'").withColumn("part", F.when(F.col("part") == "future", "test").otherwise(F.col("part"))).withColumn("dataset", F.lit("later"))
    cols = [*df.columns, "dataset", "part"]
    every = dated.withColumn("part", F.explode(F.array(F.lit("refit"), F.col("part"))))
    counts = dataset_counts(every, ["dataset", "part", "boundary"], label, protein, ligand)
    return dated.select(cols).unionByName(later.select(cols)), counts


def dataset_counts(df: DataFrame, by: Sequence[str], label: str = "y", a: str = "u", b: str = "k") -> DataFrame:
    """``rows``, ``positives``, ``n_a``, ``n_b`` per group: rows, label sum and distinct entities."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum(F.col(label).cast("long")).alias("positives"), F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b")
    )


def fold_partition(df: DataFrame, fold_column: str, fold: int, eligible: Column, folds: int = 5) -> DataFrame:
    """``df`` with ``part``: test is the fold, validation the next, train every other row.

    Rows of the two held-out folds that are not eligible get no part. A null fold trains.
    """
    f = F.col(fold_column)
    test, val = F.coalesce(f == fold, F.lit(False)), F.coalesce(f == (fold + 1) % folds, F.lit(False))
    part = F.when(~test & ~val, "train").when(test & eligible, "test").when(val & eligible, "validation")
    return df.withColumn("part", part).filter("part IS NOT NULL")


def purge_shared(parts: DataFrame, key: str) -> DataFrame:
    """Drops validation rows whose key is in test, then training rows whose key is in test or what validation is left."""
    test = parts.filter("part = 'test'")
    t = test.select(key).dropna().distinct()
    validation = parts.filter("part = 'validation'").join(t, key, "left_anti")
    blocked = t.unionByName(validation.select(key).dropna()).distinct()
    train = parts.filter("part = 'train'").join(blocked, key, "left_anti")
    cols = parts.columns
    return test.select(cols).unionByName(validation.select(cols)).unionByName(train.select(cols))


def purge_shared_sets(parts: DataFrame, row_id: str, members: Column) -> DataFrame:
    """Like :func:`purge_shared` for an array column: a row goes if its set meets a blocked member. Empty members never block."""

    def sets(df: DataFrame) -> DataFrame:
        return df.select(row_id, F.explode(members).alias("m__")).filter("m__ <> ''")

    test, val, train = (parts.filter(F.col("part") == p) for p in ("test", "validation", "train"))
    t = sets(test).select("m__").distinct()
    val = val.join(sets(val).join(t, "m__", "left_semi").select(row_id).distinct(), row_id, "left_anti")
    blocked = t.unionByName(sets(val).select("m__")).distinct()
    train = train.join(sets(train).join(blocked, "m__", "left_semi").select(row_id).distinct(), row_id, "left_anti")
    return test.select(parts.columns).unionByName(val.select(parts.columns)).unionByName(train.select(parts.columns))


def overlaps(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``value`` that occur in more than one part; empty if the parts are disjoint."""
    out = None
    for c in columns:
        x = parts.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct("part").alias("n")).filter("n > 1")
        x = x.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


def leave_one_out(df: DataFrame, family_column: str, family: str, key: str) -> DataFrame:
    """Test is one family; training has no row of it and none that shares its keys; there is no validation."""
    is_test = F.coalesce(F.col(family_column) == family, F.lit(False))
    test = df.filter(is_test)
    train = df.filter(~is_test).join(test.select(key).dropna().distinct(), key, "left_anti").select(df.columns)
    return test.withColumn("part", F.lit("test")).unionByName(train.withColumn("part", F.lit("train")))


def time_split(df: DataFrame, year: str, cutoff: int, pair: Sequence[str]) -> DataFrame:
    """``df`` with ``part``: early (year <= cutoff), unknown (no year), removed (later, but its
    pair is known early) and future."""
    early = df.filter(F.col(year) <= cutoff)
    late = df.filter(F.col(year) > cutoff)
    known = early.select(*pair).dropna().distinct()
    cols = df.columns
    return (
        early.withColumn("part", F.lit("early"))
        .unionByName(df.filter(F.col(year).isNull()).withColumn("part", F.lit("unknown")))
        .unionByName(late.join(known, list(pair), "left_semi").select(cols).withColumn("part", F.lit("removed")))
        .unionByName(late.join(known, list(pair), "left_anti").select(cols).withColumn("part", F.lit("future")))
    )


def chronological_boundary(df: DataFrame, year: str, label: str, by: Sequence[str] = (), share: float = 0.2, least: tuple[int, int] = (10, 6)) -> DataFrame:
    """``boundary`` per group: the last training year, for the validation share nearest to
    ``share``, ties to the later year, with enough rows and both labels on each side.

    Counts are made per year first; the running sums see one row per year. A group without a possible boundary has no row.
    """
    from pyspark.sql import Window

    per = df.filter(F.col(year).isNotNull()).groupBy(*by, year).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    w = Window.partitionBy(*by).orderBy(year) if by else Window.partitionBy(F.lit(0)).orderBy(year)
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    c = per.select(
        *by, F.col(year).alias("y__"), F.sum("n").over(w).alias("tr"), F.sum("p").over(w).alias("trp"), F.sum("n").over(every).alias("all"), F.sum("p").over(every).alias("allp")
    ).withColumns({"va": F.col("all") - F.col("tr"), "vap": F.col("allp") - F.col("trp")})
    ok = c.filter((F.col("tr") >= least[0]) & (F.col("va") >= least[1]) & (F.col("trp") > 0) & (F.col("trp") < F.col("tr")) & (F.col("vap") > 0) & (F.col("vap") < F.col("va")))
    return ok.groupBy(*by).agg(
        F.min_by("y__", F.struct(F.abs(F.col("va") / F.col("all").cast("double") - F.lit(share)).alias("d"), (-F.col("y__")).alias("l"))).alias("boundary")
    ).filter("boundary IS NOT NULL")


def training_weights(df: DataFrame, entity: str, label: str) -> DataFrame:
    """``df`` with ``weight``: 1 / rows of its (entity, label), scaled to equal totals per label and to n overall.

    Rows without an entity or a label get no weight and do not count in n.
    """
    df = df.filter(F.col(entity).isNotNull() & F.col(label).isNotNull())
    size = df.groupBy(entity, label).agg(F.count("*").alias("c__"))
    per = size.groupBy(label).agg(F.count("*").alias("groups__"))  # one unit of weight per (entity, label)
    n = df.count()
    labels = per.count()
    w = F.lit(float(n)) / F.lit(max(labels, 1)) / F.col("groups__") / F.col("c__")
    return df.join(size, [entity, label]).join(F.broadcast(per), label).withColumn("weight", w).drop("c__", "groups__")


def frozen_partition(df: DataFrame, membership: DataFrame, row_id: str, allowed: Sequence[str] = ("train", "validation", "test", "excluded")) -> DataFrame:
    """``df`` with the ``part`` a membership table (row id, ``partition``) gives; excluded rows go.

    Raises on a row id given twice, an unknown partition, or an id that ``df`` lacks.
    """
    from pairloom.operators.checks import require

    require(
        {
            "Duplicate membership": membership.groupBy(row_id).count().filter("count > 1"),
            "Unknown partition": membership.filter(~F.coalesce(F.col("partition").isin(*allowed), F.lit(False))),
            "Membership of unknown rows": membership.join(df.select(row_id), row_id, "left_anti"),
        }
    )
    m = membership.select(row_id, F.col("partition").alias("part")).filter("part <> 'excluded'")
    return df.join(m, row_id)
