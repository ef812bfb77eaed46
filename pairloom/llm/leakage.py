"""Evaluation texts leaking into training text (problem 7).

A positional inverted index of the training text is stored once: for each term that the test
items search for, the documents and the positions in them. Each item is searched from its
rarest terms: their position lists, shifted by their places in the item, are intersected,
which leaves the documents where two of them stand in the item's order and distance. Rows of
words that an item has in a row are terms of the index as well, so that a verbatim passage is
found however common its words. The places of the hits go along, and an exact check aligns
the words around them with the item.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.mojibake import LOOKALIKE
from pairloom.session import shuffle_partitions, written

WORD = re.compile(r"[^\W_]+")
UNSEEN = re.compile("[­​-‏⁠﻿̀-ͯ]")
TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>")
WINDOW = 4  # each so many successive words of an item give their rarest as an anchor
SPAN = 6  # anchors whose offsets differ by less stand in the item's order and distance
REACH = 4  # words that may be changed or left out between two words of a stretch
GAP_COST = 0.3  # for each of those words
COMMON = 0.3  # worth of a word that many items share; other words are worth 1
ALIKE = 0.5  # part of a word's worth that a changed word has
STRETCH = 2.2  # least score of a stretch
PASSAGE = 6.5  # least score of a document's stretches together
MATCHED = 11  # least number of words they match
ROW = 8  # words of the item in a row that are a passage whatever the words are worth,
WHOLE = 14  # if the stretches together match so many
OWN = 0.5  # part of an item's matched places that no better item has in the same document
SHARED_ITEMS = 0.02  # a word in more than this part of the items, and in over 3, is common
FILTER_BITS = 1 << 25  # size of the filter of searched terms that tasks get (4 MB), whatever the number of items
LEXICON = 400_000  # distinct words a task remembers


def plain(text: str) -> str:
    """``text`` without markup, invisible signs and case."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if not text.isascii() and UNSEEN.search(text):
        text = UNSEEN.sub("", text)
    return text.casefold()


def words(text: str) -> list[str]:
    """Words as the index knows them: no markup, case, accents, invisible signs or look-alike letters."""
    return [w if w.isascii() else _folded(w) for w in WORD.findall(plain(text))]


@lru_cache(maxsize=200_000)
def _folded(word: str) -> str:
    bare = unicodedata.normalize("NFKD", word.translate(LOOKALIKE))
    return "".join(WORD.findall(UNSEEN.sub("", bare))) or word


class Lexicon(dict):
    """Word as written, without case -> its number; ``hashes``, ``terms`` and ``kept`` by number. Number 0 is no word.

    Knows which words pass the filter of searched terms; None lets all pass.
    """

    def __init__(self, filter_bits: bytes | None = None):
        self.filter = filter_bits
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.terms: list[str] = [""]
        self.hashes: list[int] = [0]
        self.kept: list[bool] = [False]

    def __missing__(self, word: str) -> int:
        term = word if word.isascii() else _folded(word)
        h = word_hash(term)
        self[word] = at = len(self.terms)
        self.terms.append(term)
        self.hashes.append(h)
        self.kept.append(passes(self.filter, h))
        return at


def word_hash(term: str) -> int:
    """The 64-bit hash that Spark's xxhash64 gives a string, unsigned."""
    return xxhash.xxh64_intdigest(term.encode(), seed=42)


def passes(bits: bytes | None, h: int) -> bool:
    return bits is None or bool(bits[(h & (FILTER_BITS - 1)) >> 3] >> (h & 7) & 1)


def row_hashes(h: np.ndarray) -> np.ndarray:
    """One 64-bit number for each ROW successive word hashes; the order of the words counts."""
    if len(h) < ROW:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - ROW + 1, dtype=np.uint64)
    for k in range(ROW):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - ROW + 1 + k]
        out ^= out >> np.uint64(29)
    return out


def row_term(h: int) -> str:
    return f"#{int(h):016x}"


def rows_of(spelled: list[str]) -> list[tuple[int, int]]:
    """(place, hash) of every ROW successive words."""
    return list(enumerate(row_hashes(np.array([word_hash(w) for w in spelled], dtype=np.uint64)).tolist()))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def term_filter(terms: DataFrame) -> bytes:
    """Bit filter of the hashes in the column ``h``: FILTER_BITS bits however many terms there are.

    A term that is not searched passes it by chance; the join with the searched terms removes it.
    """
    at = F.pmod("h", F.lit(FILTER_BITS)) + 1
    parts = terms.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in parts.collect():  # FILTER_BITS / 32768 rows at most
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        out[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(part)] |= part
    return out.tobytes()


def postings(docs: DataFrame, doc_id: Column, text: Column, filter_bits: bytes | None = None) -> DataFrame:
    """The positional index: ``term``, ``doc_id``, ``positions`` (0-based, ascending).

    With a filter, only terms that pass it are indexed, and each ROW words in a row whose term
    (:func:`row_term`) passes. Null texts and ids are left out.
    """
    kind = docs.select(doc_id.alias("x")).schema["x"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        bits = None if shared.value is None else np.frombuffer(shared.value, dtype=np.uint8)
        for b in batches:
            if len(lexicon) > LEXICON:
                lexicon.clear()
            flat: list[int] = []
            start = np.zeros(b.num_rows, dtype=np.int64)
            for d, t in enumerate(b.column("text").to_pylist()):
                start[d] = len(flat)
                flat += map(lexicon.__getitem__, WORD.findall(plain(t)))
                flat.append(0)
            ids = np.array(flat, dtype=np.int64)
            doc = np.repeat(np.arange(b.num_rows), np.diff(np.append(start, len(ids))))
            at = np.flatnonzero(np.array(lexicon.kept)[ids])
            key, known, made = ids[at], len(lexicon.terms), []
            if bits is not None and len(ids) >= ROW:
                h = row_hashes(np.array(lexicon.hashes, dtype=np.uint64)[ids])
                whole = np.convolve((ids == 0).astype(np.int64), np.ones(ROW, dtype=np.int64), "valid") == 0
                bit = bits[(h & np.uint64(FILTER_BITS - 1)).astype(np.int64) >> 3] >> (h & np.uint64(7)).astype(np.uint8) & 1
                seen = np.flatnonzero(whole & (bit > 0))
                made, number = np.unique(h[seen], return_inverse=True)
                at, key = np.concatenate([at, seen]), np.concatenate([key, number + known])
            # a term written in several ways is one term
            used = np.unique(key)
            spelled: dict[str, int] = {}
            same = [spelled.setdefault(lexicon.terms[k] if k < known else row_term(made[k - known]), len(spelled)) for k in used.tolist()]
            key = np.array(same, dtype=np.int64)[np.searchsorted(used, key)] if len(at) else key
            order = np.lexsort((at, key, doc[at]))
            at, key = at[order], key[order]
            of = doc[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])  # one posting for each term and document
            first = np.flatnonzero(new)
            offsets = pa.array(np.append(first, len(at)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(spelled), pa.string()).take(pa.array(key[first])),
                    b.column("doc_id").take(pa.array(of[first])),
                    pa.ListArray.from_arrays(offsets, pa.array((at - start[of]).astype(np.int32))),
                ],
                names=["term", "doc_id", "positions"],
            )

    picked = docs.select(doc_id.alias("doc_id"), text.alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return picked.mapInArrow(index, f"term string, doc_id {kind}, positions array<int>")


def _anchors(df: pd.DataFrame) -> pd.DataFrame:
    """The rarest word of every window of an item, among its words that are not common.

    Where a window has only common words it gives none; in an item of only common words every window gives its rarest.
    """
    df = df.sort_values("ipos")
    terms, pos, freq, common = df["term"].tolist(), df["ipos"].tolist(), df["df"].tolist(), df["common"].tolist()
    picked = set()
    if all(common):
        common = [False] * len(common)
    for a in range(max(1, len(terms) - WINDOW + 1)):
        own = [k for k in range(a, min(a + WINDOW, len(terms))) if freq[k] > 0 and not common[k]]
        if own:
            picked.add(min(own, key=lambda k: (freq[k], k)))
    item = df["item_id"].iloc[0]
    return pd.DataFrame([(item, terms[k], pos[k]) for k in sorted(picked)], columns=["item_id", "term", "ipos"])


def stretches(doc: list[str], item: list[str], common: set[str], within: list[int] | None = None) -> tuple[float, int, int, set[int]]:
    """(score, matched words, most of them in a row, their places in ``doc``) of the passages of ``item`` in ``doc``.

    Words match in the order of the item, with up to REACH words between. A match is worth 1, or COMMON
    for a word that many items have; a changed word that is still alike counts ALIKE of that; every other word
    between costs GAP_COST. Stretches below STRETCH, and words of the item that a better stretch
    covers, do not count. Only the places ``within`` are looked at, all if it is None.
    """
    places: dict[str, list[int]] = {}
    for j, w in enumerate(item):
        places.setdefault(w, []).append(j)
    worth = [COMMON if w in common else 1.0 for w in item]
    best: list[tuple[float, int, int, int]] = []  # score, place in doc, in item, previous
    recent: list[int] = []
    for i in range(len(doc)) if within is None else within:
        w = doc[i]
        if w not in places:
            continue
        recent = [r for r in recent if i - best[r][1] <= REACH + 1]
        new = []
        for j in places[w]:
            score, back = worth[j], -1
            for r in recent:
                s, pi, pj, _ = best[r]
                di, dj = i - pi, j - pj
                if 0 < di and 0 < dj <= REACH + 1:
                    gain = s + worth[j]
                    if di == dj:
                        for k in range(1, di):
                            a, b = doc[pi + k], item[pj + k]
                            # words between count as what they are, so that nothing is won by passing over a match
                            gain += worth[pj + k] if a == b else ALIKE * worth[pj + k] if _alike(a, b) else -GAP_COST
                    else:
                        gain -= GAP_COST * (max(di, dj) - 1)
                    if gain > score:
                        score, back = gain, r
            best.append((score, i, j, back))
            new.append(len(best) - 1)
        recent += new
    used: set[int] = set()
    covered: set[int] = set()
    total, count, longest = 0.0, 0, 0
    for r in sorted(range(len(best)), key=lambda r: -best[r][0]):
        if best[r][0] < STRETCH:
            break
        chain, k = [], r
        while k >= 0 and best[k][1] not in used:
            chain.append(k)
            k = best[k][3]
        if not chain:
            continue
        # a chain whose beginning belongs to a better one counts without it
        score = best[r][0] - (best[k][0] if k >= 0 else 0.0)
        hits: list[tuple[int, int, bool]] = []
        linked = set(chain)
        for c in reversed(chain):
            _, i, j, back = best[c]
            if back in linked and i - best[back][1] == j - best[back][2]:
                for n in range(i - best[back][1] - 1, 0, -1):
                    if doc[i - n] == item[j - n] or _alike(doc[i - n], item[j - n]):
                        hits.append((i - n, j - n, doc[i - n] == item[j - n]))
            hits.append((i, j, True))
        hits = [h for h in hits if h[0] not in used]
        own = {j for _, j, _ in hits} - covered
        part = score * len(own) / max(1, len({j for _, j, _ in hits}))
        if part < STRETCH:
            continue
        total += part
        # a word of the document and one of the item count once, however many chains pass over them
        count += len(own)
        run = 0
        for n, (i, j, same) in enumerate(hits):
            follows = n and hits[n - 1][0] == i - 1 and hits[n - 1][1] == j - 1
            run = (run if follows else 0) + 1 if same else 0
            longest = max(longest, run)
        used |= {i for i, _, _ in hits}
        covered |= own
    return total, count, longest, used


def found_in(doc: list[str], items: list[tuple[object, list[str], list[int] | None]], common: set[str]) -> list[tuple[object, float, int]]:
    """(item, score, matched words) of the items that leaked into ``doc``; items with the places to look at.

    Where items are alike, a passage belongs to the one that fits it best: another item counts
    only with places of its own, or if it fits as well.
    """
    scored = [(i, *stretches(doc, w, common, at)) for i, w, at in items]
    scored = sorted(
        (x for x in scored if (x[1] >= PASSAGE and x[2] >= MATCHED) or (x[2] >= WHOLE and x[3] >= ROW)), key=lambda x: (-x[1], x[0])
    )
    taken: dict[int, float] = {}
    out = []
    for i, score, matched, _, where in scored:
        own = [p for p in where if taken.get(p, 0.0) <= score]
        if len(own) >= OWN * len(where):
            out.append((i, score, matched))
            for p in where:
                taken[p] = max(taken.get(p, 0.0), score)
    return out


@lru_cache(maxsize=200_000)
def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 3 or a.isdigit() or b.isdigit():
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.7


def around(hits: list[int], size: int, end: int) -> list[int]:
    """Places of a document at most ``size`` from a hit, ascending."""
    out: list[int] = []
    last = 0
    for p in sorted(hits):
        a, b = max(last, p - size), min(end, p + size + 1)
        if b > a:
            out += range(a, b)
            last = b
    return out


def leaks(docs: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column) -> DataFrame:
    """``doc_id``, ``item_id``, ``score``, ``matched`` of every document that carries a passage of an item.

    Every document is indexed as a whole. Markup, case, accents, invisible signs and look-alike
    letters make no difference, and changed, missing and inserted words and moved sentences are
    bridged. Equal documents each count. Items and documents with null or wordless text take no
    part; an empty table on either side gives no rows. Rows repeated under one id count once;
    other columns are ignored.

    Neither items nor documents come to the driver: tasks get a filter of fixed size of the
    searched terms, and item words reach the documents by joins. A term that many documents
    hold is salted by document, its anchors once per salt.
    """
    spark = docs.sparkSession
    ikind = items.select(item_id.alias("x")).schema["x"].dataType.simpleString()
    dkind = docs.select(doc_id.alias("x")).schema["x"].dataType.simpleString()

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for i, t in zip(b["item_id"], b["text"]):
                spelled = words(t)
                rows += [(i, k, w, _signed(word_hash(w)), False) for k, w in enumerate(spelled)]
                rows += [(i, k, row_term(h), _signed(h), True) for k, h in rows_of(spelled)]
            yield pd.DataFrame(rows, columns=["item_id", "ipos", "term", "h", "in_row"])

    tests = items.select(item_id.alias("item_id"), item_text.alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item_id"])
    spelled = written(tests.mapInPandas(spell, f"item_id {ikind}, ipos int, term string, h long, in_row boolean"), "items")
    single, in_row = spelled.filter("NOT in_row"), spelled.filter("in_row")
    n_items = single.select("item_id").distinct().count()
    shared = single.groupBy("term").agg(F.count_distinct("item_id").alias("c")).select("term", (F.col("c") > max(3, n_items * SHARED_ITEMS)).alias("common"))
    single = written(single.join(shared, "term"), "terms")
    dull = single.groupBy("item_id").agg(F.min("common").alias("dull")).filter("dull")  # items of common words only
    sought = single.filter("NOT common").select("h").unionByName(single.join(dull, "item_id", "left_semi").select("h")).unionByName(in_row.select("h"))
    index = written(postings(docs, doc_id, text, term_filter(sought)), "postings")

    freq = index.groupBy("term").agg(F.count("*").alias("df"))
    known = single.join(freq, "term", "left").select("item_id", "ipos", "term", F.coalesce("df", F.lit(0)).alias("df"), "common")
    anchors = known.groupBy("item_id").applyInPandas(_anchors, f"item_id {ikind}, term string, ipos int").withColumn("sure", F.lit(False))
    searches = written(anchors.unionByName(in_row.select("item_id", "term", "ipos", F.lit(True).alias("sure"))), "searches")

    # position lists shifted by the place in the item; no more terms than partitions can be above the average
    parts = shuffle_partitions(spark)
    total = freq.agg(F.sum("df")).first()[0] or 0
    hot = written(freq.filter(F.col("df") > max(1000, total // parts)).select("term", F.lit(parts).alias("salts")), "hot")
    left = index.join(F.broadcast(hot), "term", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1)))).drop("salts")
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)
    right = searches.join(F.broadcast(hot), "term", "left").withColumn("salt", F.explode(every)).drop("salts")
    hits = left.join(right, ["term", "salt"]).select("doc_id", "item_id", "ipos", "sure", F.explode("positions").alias("at"))
    met = hits.groupBy("doc_id", "item_id").agg(
        F.array_sort(F.collect_list(F.struct((F.col("at") - F.col("ipos")).alias("shift"), "ipos", "at"))).alias("h"), F.max("sure").alias("sure")
    )
    # among hits sorted by shift, two of different places within SPAN imply two neighbours of that kind
    close = F.expr(f"exists(zip_with(slice(h, 1, size(h) - 1), slice(h, 2, size(h) - 1), (a, b) -> b.shift - a.shift < {SPAN} AND a.ipos <> b.ipos), x -> x)")
    pairs = met.filter(F.col("sure") | ((F.size("h") > 1) & close)).select("doc_id", "item_id", F.array_distinct("h.at").alias("places"))
    tested = written(
        single.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("ipos", "term", "common"))).alias("w")).select(
            "item_id", F.col("w.term").alias("words"), F.col("w.common").alias("common")
        ),
        "tested",
    )
    # written, so that the size of this side is known when Spark chooses the join with the texts
    searched = written(
        written(pairs, "candidates").join(tested, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "places", "words", "common")).alias("items")),
        "searched",
    )
    bodies = docs.select(doc_id.alias("doc_id"), text.alias("text")).filter("text IS NOT NULL")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, near in zip(b["doc_id"], b["text"], b["items"]):
                common: set[str] = set()
                tests = []
                doc = words(t)
                for x in near:
                    w = list(x["words"])
                    common |= {w for w, c in zip(w, x["common"]) if c}
                    tests.append((x["item_id"], w, around(x["places"], len(w) + REACH, len(doc))))
                rows += [(d, *x) for x in found_in(doc, tests, common)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "matched"])

    return (
        bodies.join(searched, "doc_id")
        .mapInPandas(align, f"doc_id {dkind}, item_id {ikind}, score double, matched long")
        .groupBy("doc_id", "item_id")
        .agg(F.max("score").alias("score"), F.max("matched").alias("matched"))
    )
