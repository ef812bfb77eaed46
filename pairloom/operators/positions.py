"""Exact positions and running sums inside groups, without ever holding a group in one task.

The rows are range-partitioned and sorted on (group, order columns). Every partition numbers
the rows of each group it holds; only the first and the last group of a partition can
continue in a neighbour, so the counts of those two are all that has to be prefix-summed:
at most two rows per partition, however many rows or groups there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.session import shuffle_partitions, stored

POS = "pos"


def grouped_positions(
    df: DataFrame,
    group: Column,
    order: Sequence[tuple[Column, bool]],
    carry: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    distinct: bool = False,
    up_to: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Rows with their 1-based position within ``group``.

    ``order`` holds (column, descending) pairs and has to be a total order, else tied rows
    get positions in any order. Result: ``g``, ``o0..``, the columns of ``carry``, ``pos``
    and, for each entry of ``sums``, the running sum of that non-negative LONG up to and
    including the row. Nulls in the group form one group; nulls in an order column come
    last. ``distinct`` counts rows that agree in group and order once (the first of them
    is returned). ``up_to`` drops rows beyond that position; a row whose place inside its own partition
    already exceeds it is dropped before anything is written.
    """
    spark = df.sparkSession
    carry, sums = carry or {}, sums or {}
    names = [f"o{i}" for i in range(len(order))]
    picked = df.select(
        group.alias("g"),
        *[c.alias(n) for n, (c, _) in zip(names, order)],
        *[c.alias(n) for n, c in carry.items()],
        *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in sums.items()],
    )
    keys = [F.col("g").asc_nulls_last()] + [
        F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_last() for n, (_, down) in zip(names, order)
    ]
    n = partitions or shuffle_partitions(spark)
    ordered = picked.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ordered = ordered.withColumn("pid", F.spark_partition_id())
    schema = T.StructType(
        [*ordered.schema.fields, T.StructField(POS, T.LongType()), T.StructField("edge", T.IntegerType())]
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    same = ["g", *names] if distinct else []
    numbered, path = stored(ordered.mapInArrow(_numbering(list(sums), same, up_to), schema), "positions")

    # at most two rows per partition
    edges = numbered.filter("edge > 0").select("pid", "edge", "g", POS, *sums).orderBy("pid", "edge").collect()
    shifts = _shifts(edges, list(sums))
    shift_schema = "pid int, " + ", ".join(f"d_{c} long" for c in [POS, *sums])
    shift = spark.createDataFrame(shifts, shift_schema)
    rows = numbered.filter("edge <= 0").join(F.broadcast(shift), "pid", "left")
    for c in [POS, *sums]:
        # edge = -1 marks the rows of the partition's first group, edge = 0 all others
        rows = rows.withColumn(c, F.when(F.col("edge") == -1, F.col(c) + F.coalesce(f"d_{c}", F.lit(0))).otherwise(F.col(c)))
    if up_to is not None:
        rows = rows.filter(F.col(POS) <= up_to)
    return rows.select("g", *names, *carry, POS, *sums)


def _shifts(edges: list, sums: list[str]) -> list[tuple]:
    """What each partition's first group has already seen in the partitions before."""
    by_pid: dict[int, dict[int, object]] = {}
    for e in edges:
        by_pid.setdefault(e["pid"], {})[e["edge"]] = e
    out, open_group, seen, started = [], None, [0] * (1 + len(sums)), False
    for pid in sorted(by_pid):
        first, last = by_pid[pid][1], by_pid[pid].get(2)
        if started and first["g"] == open_group:
            out.append((pid, *seen))
            base = list(seen)
        else:
            base = [0] * (1 + len(sums))
        if last is None:  # the partition holds one group only
            values, open_group = first, first["g"]
            seen = [b + v for b, v in zip(base, [values[POS], *[values[s] for s in sums]])]
        else:
            open_group = last["g"]
            seen = [last[POS], *[last[s] for s in sums]]
        started = True
    return out


def _changes(batch: pa.RecordBatch, cols: list[str], before: dict | None) -> np.ndarray:
    """True where a row differs from the one before it in any of ``cols``."""
    n = batch.num_rows
    out = np.zeros(n, dtype=bool)
    for c in cols:
        a = batch.column(batch.schema.get_field_index(c))
        if n > 1:
            ne = pc.not_equal(a.slice(1), a.slice(0, n - 1))
            nulls = pc.not_equal(pc.is_null(a.slice(1)), pc.is_null(a.slice(0, n - 1)))
            out[1:] |= pc.fill_null(ne, False).to_numpy(zero_copy_only=False)
            out[1:] |= nulls.to_numpy(zero_copy_only=False)
        if before is None or before[c] != a[0].as_py():
            out[0] = True
    return out


def _numbering(sums: list[str], same: list[str], up_to: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key: dict | None = None
        last_g: dict | None = None
        count, totals = 0, {s: 0 for s in sums}
        in_first, first_edge, sample = True, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if same:
                fresh = _changes(batch, same, last_key)
                last_key = {c: batch.column(c)[-1].as_py() for c in same}
                batch = batch.filter(pa.array(fresh))
                if batch.num_rows == 0:
                    continue
            n = batch.num_rows
            start = _changes(batch, ["g"], last_g)
            opening = last_g is None
            last_g = {"g": batch.column("g")[-1].as_py()}
            idx = np.arange(n)
            at = np.maximum.accumulate(np.where(start, idx, -1))
            pos = np.where(at >= 0, idx - at + 1, idx + 1 + count)
            runs = {}
            for s in sums:
                v = batch.column(s).to_numpy(zero_copy_only=False).astype(np.int64)
                c = np.cumsum(v)
                base = np.where(at > 0, c[np.maximum(at, 1) - 1], 0)
                runs[s] = c - base + np.where(at >= 0, 0, totals[s])
            # where the first group of the partition ends
            cut = np.flatnonzero(start)
            if opening:
                cut = cut[1:]
            end = int(cut[0]) if len(cut) else n
            edge = np.zeros(n, dtype=np.int32)
            if in_first:
                edge[:end] = -1
                if len(cut):
                    in_first = False
                    if end:
                        first_edge = (int(pos[end - 1]), {s: int(runs[s][end - 1]) for s in sums}, batch.slice(end - 1, 1))
                    else:
                        first_edge = (count, dict(totals), sample)
            count = int(pos[-1])
            totals = {s: int(runs[s][-1]) for s in sums}
            sample = batch.slice(n - 1, 1)
            arrays = [
                pa.array(runs[name]) if name in runs else batch.column(i) for i, name in enumerate(batch.schema.names)
            ]
            out = pa.RecordBatch.from_arrays(
                [*arrays, pa.array(pos, pa.int64()), pa.array(edge, pa.int32())], names=[*batch.schema.names, POS, "edge"]
            )
            if up_to is not None:
                out = out.filter(pa.array(pos <= up_to))
            yield out
        if sample is not None:
            if in_first:
                yield _edge(sample, sums, count, totals, 1)
            else:
                yield _edge(first_edge[2], sums, first_edge[0], first_edge[1], 1)
                yield _edge(sample, sums, count, totals, 2)

    return run


def _edge(sample: pa.RecordBatch, sums: list[str], count: int, totals: dict, kind: int) -> pa.RecordBatch:
    arrays = [pa.array([totals[x]]) if x in sums else sample.column(i) for i, x in enumerate(sample.schema.names)]
    return pa.RecordBatch.from_arrays(
        [*arrays, pa.array([count], pa.int64()), pa.array([kind], pa.int32())], names=[*sample.schema.names, POS, "edge"]
    )
