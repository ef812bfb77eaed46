"""Average ranks of many score columns at once, over all rows and within an entity, from packed blocks of rows.

A block holds some thousand rows, column by column. Of each column a task sends the distinct scores of a block, with their
counts, to the task of their range of scores, which ranks them and sends the ranks back to the block: rows and ids stay where they are,
and no task holds more than a block or a range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.positions import _changes
from pairloom.session import written

BLOCK = 4096  # rows; an entity of more has blocks of its own, and is ranked by ranges too
RANGE = 1 << 20  # rows whose scores a task ranks at once
POINTS = 4  # scores of a block and column from which the ranges are cut; they decide only how even these are
MILLION = 1e6


def _packed(x: np.ndarray, ordered: bool = False) -> bytes:
    """Numbers as bytes: integers and multiples of a millionth as differences (if ``ordered``), the bytes of equal weight together."""
    kind = b"i"
    if x.dtype.kind == "f":
        with np.errstate(invalid="ignore"):
            k = np.rint(x * MILLION)
            exact = bool((np.abs(k) < 2.0**52).all()) and np.array_equal(k / MILLION, x)
        kind = b"m" if exact else b"d"
        x = k.astype(np.int64) if exact else x
    if ordered and kind != b"d":
        kind, x = kind.upper(), np.diff(x, prepend=0)
    planes = x.astype("<i8" if x.dtype.kind == "i" else "<f8").view(np.uint8).reshape(-1, 8).T
    return kind + zlib.compress(planes.tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    kind = b[:1]
    raw = np.frombuffer(zlib.decompress(b[1:]), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(raw.T).view("<f8" if kind == b"d" else "<i8").ravel()
    if kind in b"IM":
        x = np.cumsum(x)
    return x / MILLION if kind in b"mM" else x


def _blocks(entity: str, ids: list[str], names: list[str], limit: int):
    """Rows in the order of ``entity`` to a record per block; ``hot`` names the entity that has blocks of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0

        def record(parts: list[pa.RecordBatch], hot: bool) -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(parts).combine_chunks()
            kept = t.select(ids)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as w:
                w.write_table(kept)
            columns, points = [], []
            for n in names:
                x = t.column(n).to_numpy()  # null is NaN
                x = np.where(np.isfinite(x), x, np.nan)
                columns.append(_packed(x))
                x = x[~np.isnan(x)]
                at = (2 * np.arange(POINTS) + 1) * len(x) // (2 * POINTS)
                points.append(np.partition(x, at)[at] if len(x) else np.full(POINTS, np.nan))
            number += 1
            name = repr(t.column(entity)[0].as_py()) if hot else ""
            values = [[task << 32 | number], [t.num_rows], [name], [sink.getvalue().to_pybytes()], [columns], [np.concatenate(points).tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["block", "n", "hot", "ids", "scores", "points"])

        done, rows = [], 0  # whole entities
        held, size, hot, last = [], 0, False, None  # the last entity
        for b in batches:
            if not b.num_rows:
                continue
            starts = np.flatnonzero(_changes(b, [entity], last))
            last = {entity: b.column(entity)[-1].as_py()}
            first, final = (int(starts[0]), int(starts[-1])) if len(starts) else (b.num_rows, b.num_rows)
            if first:
                held.append(b.slice(0, first))
                size += first
            if not len(starts):
                if size > limit:
                    yield record(held, True)
                    held, size, hot = [], 0, True
                continue
            if hot and size:
                yield record(held, True)
            elif size:
                done, rows = [*done, *held], rows + size
            for start in starts[1:].tolist():
                if rows + start - first >= limit:
                    yield record([*done, b.slice(first, start - first)], False)
                    done, rows, first = [], 0, start
            if final > first:
                done, rows = [*done, b.slice(first, final - first)], rows + final - first
            held, size, hot = [b.slice(final)], b.num_rows - final, False
        if hot and size:
            yield record(held, True)
        elif size:
            done = [*done, *held]
        if done:
            yield record(done, False)

    return run


def _cuts(points: list, columns: int, values: int) -> list[np.ndarray]:
    """The scores, of each column, at which a range begins."""
    ranges = sum(r["n"] for r in points) // values + 1
    if ranges == 1:
        return [np.empty(0)] * columns
    at = np.stack([np.frombuffer(r["points"]).reshape(columns, POINTS) for r in points], axis=1).reshape(columns, -1)
    out = []
    for x in at:
        x = np.sort(x[~np.isnan(x)])
        out.append(np.unique(x[np.arange(1, ranges) * len(x) // ranges]) if len(x) else x)
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which scores are known; of these the distinct ones, where each row has its own, and how many rows have it."""
    known = ~np.isnan(x)
    return known, *np.unique(x[known], return_inverse=True, return_counts=True)


def _pieces(cuts: list[np.ndarray]):
    """Blocks to the distinct scores of each column and range, once for all rows and, of a block of one entity, for this entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, hot, columns in zip(b.column("block").to_pylist(), b.column("hot").to_pylist(), b.column("scores")):
                out = []
                for i, (x, cut) in enumerate(zip(columns, cuts)):
                    _, v, _, n = _distinct(_unpacked(x.as_py()))
                    ends = [0, *np.searchsorted(v, cut, side="left"), len(v)]
                    for part, (lo, hi) in enumerate(zip(ends, ends[1:])):
                        if hi > lo:
                            packed = (_packed(v[lo:hi], True), _packed(n[lo:hi]))
                            out += [(group, i, part, block, *packed) for group in dict.fromkeys(["", hot])]
                if out:
                    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=["group", "i", "part", "block", "v", "n"])

    return run


def _ranked(t: pa.Table) -> pa.Table:
    """The pieces of one group, column and range with ``twice``, twice the average rank of each score in it, and ``scored``, its rows."""
    v = [_unpacked(x.as_py()) for x in t.column("v")]
    n = np.concatenate([_unpacked(x.as_py()) for x in t.column("n")])
    ends = np.cumsum([len(x) for x in v])
    v = -np.concatenate(v)
    order = np.argsort(v, kind="stable")
    s = v[order]
    new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    rows = np.add.reduceat(n[order], new)
    twice = np.empty(len(v), dtype=np.int64)
    twice[order] = np.repeat(2 * np.cumsum(rows) - rows + 1, np.diff(np.append(new, len(v))))
    packed = pa.array([_packed(x, True) for x in np.split(twice, ends[:-1])], pa.binary())
    return t.select(["group", "i", "part", "block"]).append_column("twice", packed).append_column("scored", pa.array(np.full(len(ends), rows.sum())))


def _within(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the average rank of each of the rows of ascending ``group``, and the rows of its group."""
    order = np.lexsort((-x, group))
    g, v = group[order], x[order]
    new_group = np.append(True, g[1:] != g[:-1])
    new_score = new_group | np.append(True, v[1:] != v[:-1])
    groups, ties = np.flatnonzero(new_group), np.flatnonzero(new_score)
    peers = np.diff(np.append(ties, len(x)))
    of = np.cumsum(new_group) - 1
    twice, size = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    twice[order] = np.repeat(2 * (ties - groups[of[ties]]) + peers + 1, peers)
    size[order] = np.diff(np.append(groups, len(x)))[of]
    return twice, size


BLOCKS = "block long, n long, hot string, ids binary, scores array<binary>, points binary"


def blocks_of(row_id: str, entity: str, names: dict[str, str], block: int = BLOCK):
    """What makes records of BLOCKS, for :func:`block_ranks`, of batches of ``row_id``, ``entity`` and ``names`` in which an entity's rows follow each other."""
    return _blocks(entity, list(dict.fromkeys([row_id, entity])), list(names), block)


def column_ranks(scores: DataFrame, row_id: str, entity: str, names: dict[str, str], digits: int = 9, block: int = BLOCK, values: int = RANGE) -> DataFrame:
    """The result of :func:`pairloom.operators.likelihood.rank_candidates` for the columns of ``names``, each with its method: ``row_id``,
    ``entity``, ``method``, ``score``, ``global_rank``, ``global_fraction``, ``within_rank``, ``within_fraction``; fractions rounded half up at ``digits``.

    Every row is returned for every method. Scores that are null, NaN or infinite are null, have no ranks and do not count.
    """
    rows = scores.select(*dict.fromkeys([row_id, entity]), *[F.col(c).cast("double").alias(c) for c in names]).repartition(entity).sortWithinPartitions(entity)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (row_id, entity)}
    return block_ranks(rows.mapInArrow(blocks_of(row_id, entity, names, block), BLOCKS), row_id, entity, kinds, names, digits, values)


def block_ranks(blocks: DataFrame, row_id: str, entity: str, kinds: dict[str, str], names: dict[str, str], digits: int = 9, values: int = RANGE) -> DataFrame:
    """:func:`column_ranks` of the records of :func:`blocks_of`. ``kinds``: the types of ``row_id`` and ``entity``."""
    columns, labels, ids = list(names), list(names.values()), list(dict.fromkeys([row_id, entity]))
    packed = written(blocks, "blocks")
    cuts = _cuts(packed.select("n", "points").collect(), len(columns), values)
    pieces = packed.select("block", "hot", "scores").mapInArrow(_pieces(cuts), "group string, i int, part int, block long, v binary, n binary")
    ranked = written(pieces.groupBy("group", "i", "part").applyInArrow(_ranked, "group string, i int, part int, block long, twice binary, scored long"), "ranks")
    # higher ranges come first
    keys = ["group", "i", "part"]
    above, whole = Window.partitionBy("group", "i").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("group", "i")
    totals = ranked.select(*keys, "scored").distinct()
    totals = totals.select(*keys, F.coalesce(F.sum("scored").over(above), F.lit(0)).alias("above"), F.sum("scored").over(whole).alias("total"))
    found = ranked.drop("scored").join(totals, keys)
    unit = 10**digits

    def rows_of(left: pa.Table, right: pa.Table) -> pa.Table:
        hot = left.column("hot")[0].as_py()
        with pa.ipc.open_stream(left.column("ids")[0].as_py()) as s:
            own = s.read_all().combine_chunks()
        group = np.cumsum(_changes(own.to_batches()[0], [entity], None)) - 1
        at: dict[tuple[str, int], list] = {}
        for g, i, part, twice, before, total in zip(*[right.column(c).to_pylist() for c in ("group", "i", "part", "twice", "above", "total")]):
            at.setdefault((g, i), []).append((part, twice, before, total))
        out = []
        for i, (x, label) in enumerate(zip(left.column("scores")[0], labels)):
            x = _unpacked(x.as_py())
            known, v, inverse, _ = _distinct(x)
            ranks = []
            for g in ("", hot):
                if known.any() and (not ranks or hot):
                    parts = sorted(at[g, i])
                    twice = np.concatenate([_unpacked(t) + 2 * before for _, t, before, _ in parts])
                    if len(twice) != len(v):
                        raise ValueError("Ranks do not belong to the scores of their block")
                    ranks.append((twice[inverse], parts[0][3]))
                else:
                    ranks.append(_within(group[known], x[known]) if known.any() else (np.empty(0, dtype=np.int64), 1))
            arrays = [own.column(c).chunk(0) for c in ids] + [pa.array(np.full(len(x), i), pa.int32()), pa.array(x, mask=~known)]
            for twice, size in ranks:
                for some in (twice / 2.0, ((twice - 1) * unit + size) // (2 * size) / float(unit)):
                    full = np.zeros(len(x))
                    full[known] = some
                    arrays.append(pa.array(full, mask=~known))
            arrays[len(ids)] = pa.DictionaryArray.from_arrays(arrays[len(ids)], pa.array([*labels])).cast(pa.string())
            out.append(pa.RecordBatch.from_arrays(arrays, names=[*ids, "method", "score", "global_rank", "global_fraction", "within_rank", "within_fraction"]))
        return pa.Table.from_batches(out)

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in ids], "method string, score double, global_rank double, global_fraction double, within_rank double, within_fraction double"])
    return packed.select("block", "hot", "ids", "scores").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(rows_of, schema)
