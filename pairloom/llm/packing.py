"""Filling fixed-capacity containers with texts (problem 6).

Hierarchical multi-length packing: a container is one window of the full context size, or two
of half of it, four of a quarter and so on. Texts are routed to the tier of the smallest window
that holds them, each tier is packed window by window, and the gap that a text leaves in its
window is filled from shorter tiers.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.positions import grouped_positions
from pairloom.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
TIERS = 4
GROUP = 64  # containers of one training step
LOOSE = 0.01  # a window of a shorter tier with a larger part unused is not kept
# fixed value: the published pattern that cuts a text before its byte pairs are merged
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counter(tokenizer: str):
    """Text to its number of tokens, by a rank file of ``tiktoken`` or a file of the ``tokenizers`` library."""
    if tokenizer.endswith(".tiktoken"):
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(own.encode_ordinary(text))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def token_counts(df: DataFrame, doc_id: Column, text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``n_tokens`` of every text that is not blank.

    The file is read by every worker, so its path has to be one that all of them have.
    """
    kind = df.select(doc_id.alias("x")).schema["x"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = token_counter(tokenizer)
        for b in batches:
            # a text at a time holds one encoding in memory, however long the batch is
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": pd.Series([tokens(x) for x in b["text"]], dtype="int64")})

    picked = df.select(doc_id.alias("doc_id"), text.alias("text")).filter(F.col("text").rlike(r"\S"))
    return picked.mapInPandas(count, f"doc_id {kind}, n_tokens long").filter("n_tokens > 0")


ITEMS = 1 << 45  # more items than any length has; length x ITEMS + item is one sortable number


@dataclass
class Plan:
    """Where the items of each length go: the i-th item of a length falls into one of its ranges.

    Windows are numbered within their tier, in runs of equal filling. Everything here is as
    large as the number of distinct lengths, not of items or containers.
    """

    capacity: int
    sizes: list[int]  # window of each tier
    ranges: np.ndarray = field(default_factory=lambda: np.zeros((0, 5), dtype=np.int64))  # length x ITEMS + first item, items a window, tier, first window, length
    run_first: list[np.ndarray] = field(default_factory=list)  # per tier: first window of each run and one past the last
    run_unused: list[np.ndarray] = field(default_factory=list)  # per tier: unused space of all windows before the run
    full: list[int] = field(default_factory=list)  # containers that a tier fills alone
    bases: list[int] = field(default_factory=list)  # first container of each tier
    mixed: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)  # (tier, window left over) to container and its unused space
    containers: int = 0

    def unused_before(self, tier: int, window: np.ndarray) -> np.ndarray:
        first, total = self.run_first[tier], self.run_unused[tier]
        return np.interp(window, first, total).round().astype(np.int64) if len(first) > 1 else np.zeros(len(window), dtype=np.int64)

    def place(self, length: np.ndarray, item: np.ndarray) -> np.ndarray:
        """n x 4: container, its unused space, tier and window (within the tier) of the ``item``-th (from 0) items of ``length``."""
        r = self.ranges[np.searchsorted(self.ranges[:, 0], length * ITEMS + item, side="right") - 1]
        tier, window = r[:, 2], r[:, 3] + (item - (r[:, 0] - r[:, 4] * ITEMS)) // r[:, 1]
        container, unused = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for t, size in enumerate(self.sizes):
            own = np.flatnonzero(tier == t)
            w = window[own]
            c = w >> t
            container[own] = self.bases[t] + c
            unused[own] = self.capacity - (size << t) + self.unused_before(t, (c + 1) << t) - self.unused_before(t, c << t)
            for k in np.flatnonzero(c >= self.full[t]):
                container[own[k]], unused[own[k]] = self.mixed[t, int(w[k])]
        return np.stack([container, unused, tier, window], axis=1)

    def group(self, container: np.ndarray, groups: int) -> np.ndarray:
        """Containers dealt out forth and back. They are numbered by tier and unused space, so that the groups get the same mix of tiers and nearly the same tokens."""
        turn, at = container // groups, container % groups
        return np.where(turn % 2 == 0, at, groups - 1 - at)


def fill(size: int, first: int, left: np.ndarray) -> dict[int, int]:
    """Items (length to number) of a window of ``size`` that holds one of length ``first``.

    The gap goes to the item or the two items that fill it exactly; where there are none, to the longest that fits, and so on.
    """
    filling = {first: 1}
    left = left.copy()
    left[first] -= 1
    space = size - first
    while space > 0:
        fits = np.flatnonzero(left[1 : space + 1]) + 1
        if not len(fits):
            break
        if left[space]:
            take = [space]
        else:
            other = space - fits
            pair = fits[(other >= 1) & (left[np.maximum(other, 0)] > (other == fits)) & (other <= fits)]
            take = [int(pair[-1]), space - int(pair[-1])] if len(pair) else [int(fits[-1])]
        for n in take:
            filling[n] = filling.get(n, 0) + 1
            left[n] -= 1
            space -= n
    return filling


def plan(lengths: dict[int, int], capacity: int, tiers: int = TIERS) -> Plan:
    """Packs a histogram of lengths (each at most ``capacity``) tier by tier.

    Tier t has windows of capacity / 2^t. It takes the lengths above half its window, the last
    tier all shorter ones; what is left of a window is filled from shorter tiers (:func:`fill`).
    A filling is repeated as often as its lengths last, so each filling uses up a length and the
    work depends on the number of lengths, not of items. Short windows that keep more than the
    part LOOSE free, as when no shorter items are left, are given up and their items packed into
    full ones. 2^t windows make a container; the windows that are left over of all tiers share
    the last containers.
    """
    tiers = max(1, min(tiers, capacity.bit_length()))
    sizes = [capacity >> t for t in range(tiers)]
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in lengths.items():
        left[n] += c
    used = np.zeros(capacity + 1, dtype=np.int64)
    runs: list[list[tuple[dict[int, int], int, int]]] = [[] for _ in sizes]

    def pack_into(tier_of) -> None:
        for longest in range(capacity, 0, -1):
            tier = tier_of(longest)
            while left[longest]:
                filling = fill(sizes[tier], longest, left)
                times = min(int(left[n]) // c for n, c in filling.items())
                runs[tier].append((filling, sizes[tier] - sum(n * c for n, c in filling.items()), times))
                for n, c in filling.items():
                    left[n] -= c * times

    pack_into(lambda n: max(t for t in range(tiers) if n <= sizes[t]))
    for t in range(1, tiers):
        for filling, gap, times in runs[t]:
            if gap > LOOSE * sizes[t]:
                for n, c in filling.items():
                    left[n] += c * times
        runs[t] = [r for r in runs[t] if r[1] <= LOOSE * sizes[t]]
    pack_into(lambda n: 0)
    out = Plan(capacity, sizes)
    ranges = []
    rest: list[tuple[int, int, int]] = []
    for t, own in enumerate(runs):
        own.sort(key=lambda r: r[1])
        window, unused, first, total = 0, 0, [0], [0]
        for filling, gap, times in own:
            for n, c in filling.items():
                ranges.append((n * ITEMS + int(used[n]), c, t, window, n))
                used[n] += c * times
            window += times
            unused += gap * times
            first.append(window)
            total.append(unused)
        out.run_first.append(np.array(first, dtype=np.float64))
        out.run_unused.append(np.array(total, dtype=np.float64))
        out.full.append(window >> t)
        out.bases.append(out.containers)
        out.containers += window >> t
        rest += [(t, w, sizes[t] - int(np.diff(out.unused_before(t, np.array([w, w + 1])))[0])) for w in range((window >> t) << t, window)]
    # windows left over, the longer first: sizes are halves of each other, so none crosses a border
    at, unit, tokens = 0, 1 << (tiers - 1), {}
    for t, w, n in rest:
        out.mixed[t, w] = (out.containers + at // unit, 0)
        tokens[at // unit] = tokens.get(at // unit, 0) + n
        at += unit >> t
    out.mixed = {k: (c, capacity - tokens[c - out.containers]) for k, (c, _) in out.mixed.items()}
    out.containers += len(tokens)
    out.ranges = np.array(sorted(ranges), dtype=np.int64).reshape(-1, 5)
    return out


def pack(
    df: DataFrame,
    doc_id: Column,
    text: Column,
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    tiers: int = TIERS,
    group: int = GROUP,
) -> DataFrame:
    """``doc_id``, ``piece``, ``token_start``, ``n_tokens``, ``container``, ``unused``, ``tier``, ``window``, ``step_group``.

    One row per text, or per piece of a text that alone exceeds the capacity: its pieces
    are full ones and a rest. ``unused`` is the free space of the container; ``window`` numbers the
    windows of a tier. Texts are routed to context-size tiers by length, each tier is packed, and the gaps
    left beside long texts are filled from shorter tiers (:func:`plan`). The plan is made from the histogram of
    lengths, which has at most ``capacity`` entries however many texts there are, and is the
    only thing the driver sees; texts find their container by their exact position among
    those of equal length, so a length that a third of the texts share is no burden. Step
    groups of ``group`` containers are balanced in tokens and tiers (:meth:`Plan.group`).

    Null, empty and blank texts are left out; rows repeated under an id are packed each. An
    empty table gives no rows.
    """
    return place(token_counts(df, doc_id, text, tokenizer), capacity, tiers, group)


def place(counts: DataFrame, capacity: int = CAPACITY, tiers: int = TIERS, group: int = GROUP) -> DataFrame:
    """:func:`pack` from ``doc_id``, ``n_tokens``."""
    pieces = written(
        counts.select(
            "doc_id",
            F.posexplode(F.expr(f"transform(sequence(0L, (n_tokens - 1) div {capacity}), x -> least({capacity}L, n_tokens - x * {capacity}))")).alias("piece", "n"),
        ),
        "pieces",
    )
    lengths = {r["n"]: r["c"] for r in pieces.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most ``capacity`` rows
    made = plan(lengths, capacity, tiers)
    shared = counts.sparkSession.sparkContext.broadcast(made)
    ranked = grouped_positions(pieces, F.col("n"), [(F.col("doc_id"), False), (F.col("piece"), False)])
    kind = counts.schema["doc_id"].dataType.simpleString()
    groups = max(1, -(-made.containers // group))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for b in batches:
            at = p.place(b["g"].to_numpy(dtype=np.int64), b["pos"].to_numpy(dtype=np.int64) - 1)
            yield pd.DataFrame(
                {
                    "doc_id": b["o0"], "piece": b["o1"], "token_start": b["o1"].astype("int64") * capacity, "n_tokens": b["g"],
                    "container": at[:, 0], "unused": at[:, 1], "tier": at[:, 2].astype("int32"), "window": at[:, 3], "step_group": p.group(at[:, 0], groups),
                }
            )

    return ranked.mapInPandas(
        assign, f"doc_id {kind}, piece int, token_start long, n_tokens long, container long, unused long, tier int, window long, step_group long"
    )


def report(texts: DataFrame, doc_id: Column, text: Column, packed: DataFrame, capacity: int = CAPACITY, loose: float = 0.01, apart: float = 0.05) -> DataFrame:
    """``measure``, ``value`` of a packing held against its texts.

    ``texts``: ids with a text that is not blank. Of these ``missing`` have no piece and ``cut`` are cut without
    need. ``overfull`` containers hold more than the capacity, ``wrong`` ones another ``unused`` than is
    given. ``loose``: 1 if more than the part ``loose`` of all space, one container aside, is unused.
    ``uneven``: 1 if the mean tokens of a container differ between step groups by more than ``apart`` of the
    capacity (and one container in the smallest group).
    """
    real = texts.select(doc_id.alias("doc_id"), text.alias("t")).filter(F.col("t").rlike(r"\S")).select("doc_id").distinct()
    whole = packed.groupBy("doc_id").agg(F.count("*").alias("p"), F.max("n_tokens").alias("m"), F.count_if(F.col("piece") == 0).alias("copies"))
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.max("unused").alias("hi"), F.min("unused").alias("lo"), F.max("step_group").alias("g"))
    mean = full.groupBy("g").agg((F.sum("n") / F.count("*")).alias("n"), F.count("*").alias("c"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    parts = [
        real.agg(F.count("*").alias("texts")),
        real.join(packed.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("missing")),
        whole.agg(F.count_if((F.col("p") > F.col("copies")) & (F.col("m") < capacity)).alias("cut")),
        full.agg(
            F.count_if(F.col("n") > capacity).alias("overfull"),
            F.count_if((F.col("hi") != F.col("lo")) | (F.col("hi") != capacity - F.col("n"))).alias("wrong"),
            flag(F.sum(capacity - F.col("n")) > F.count("*") * loose * capacity + capacity).alias("loose"),
        ),
        mean.agg(flag(F.max("n") - F.min("n") > apart * capacity + capacity / F.min("c")).alias("uneven")),
    ]
    rows = [p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in p.columns])).alias("x")).select("x.*") for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
