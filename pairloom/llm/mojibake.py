"""Garbled text from wrong character encoding (problem 8).

A wrong code page turns letters into other symbols in a fixed way, so damage is a
substitution cipher. The unit of the cipher is a run of non-ASCII characters with the character before and
after it. The language model holds bigram counts of all documents; most text is sound, so
sound bigrams outweigh damaged ones. For each source, expectation-maximization learns which
letters each run stands for, the choices being the run itself and what any swap of two
encodings that Python knows can make of it. How many runs of a source a swap explains is its
weight there, which settles runs that have several readings; a swap of uncommon code pages has to
explain more than one run, as a page changes many letters, never one. Runs that stand for
something else are damage, and their letters go back by a translation table. Runs that read
as UTF-8 in characters the texts hold do not count for the bigrams, so that a source that is
damaged throughout does not vouch for itself.
"""

from __future__ import annotations

import encodings
import html
import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import shuffle_partitions, written

# fixed values: code pages that texts are commonly read with by mistake; they are tried first
SINGLE = ["latin_1", "cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_2", "iso8859_5", "cp1254", "cp1253"]
MULTI = ["gb18030", "big5", "cp932"]


def _pages() -> tuple[list[str], list[str]]:
    """All encodings of Python that keep ASCII: those of one byte a character, without repeats, and those of several."""
    ascii_bytes = bytes(range(32, 127))
    single: dict[tuple[str, ...], str] = {}
    multi: list[str] = []
    for name in [*SINGLE, *MULTI, *(m.name for m in pkgutil.iter_modules(encodings.__path__))]:
        try:
            if name.startswith("utf") or name.endswith("escape") or ascii_bytes.decode(name) != ascii_bytes.decode("ascii"):
                continue
            high = tuple(bytes([b]).decode(name, "ignore") for b in range(128, 256))
        except (LookupError, ImportError, UnicodeError, AttributeError):
            continue
        if any(len(bytes([b, 0xA1]).decode(name, "ignore")) == 1 and not high[b - 128] and bytes([b, 0xA1]).decode(name, "ignore") != high[0xA1 - 128] for b in range(0x81, 0xFF)):
            if name not in multi:
                multi.append(name)
        elif sum(len(c) == 1 for c in high) >= 64:
            single.setdefault(high, name)
    return list(single.values()), multi


RUN = re.compile(r"(?:[^\x00-\x7f]|&#?[A-Za-z0-9]{2,8};)+")
LOST = re.compile("[�\u0080-\u0084\u0086-\u009f]|ï¿½")  # a lost character, also one read wrongly again, or a control code that no text holds
UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")
CURRENT = 0.5  # chance of a run being sound, before anything is known
WORD_RUN = 3  # least length of a run that may stand for letters of an uncommon one-byte page
RARE = 1e-3  # part of the texts; pairs of letters in fewer of them make a word strange
UNCOMMON = 2  # runs of a source that a swap of uncommon code pages has to explain
MIN_GAIN = 3.0  # log ratio by which damage has to be likelier than the run as it stands
LONG_RUN = 24  # longer runs are judged by windows of so many characters; none is left out
WIDE_FROM, BLOCK = "\u2e80", 64  # beyond are scripts with thousands of characters; among themselves they count by blocks of so many, which bounds the bigrams
USUAL = frozenset([*SINGLE, *MULTI, "utf_8"])
PAGES, WIDE = _pages()
ORDER = [*SINGLE, *MULTI, *(c for c in PAGES if c not in SINGLE), *(c for c in WIDE if c not in MULTI)]


@lru_cache(maxsize=None)
def _table(codec: str) -> dict[str, int]:
    """Character to byte; bytes without a character stand for the control code of that number."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache(maxsize=None)
def _letters(codec: str) -> dict[int, str]:
    return {b: bytes([b]).decode(codec, "ignore") or chr(b) for b in range(128, 256)}


def _encode(s: str, codec: str) -> list[tuple[bool, object]]:
    """Pieces of ``s``: (True, bytes) where the code page has the characters, else (False, text)."""
    out: list[tuple[bool, object]] = []
    for c in s:
        if codec in MULTI:
            try:
                b = c.encode(codec)
            except UnicodeEncodeError:
                b = None
        else:
            b = bytes([ord(c)]) if c < "\x80" else bytes([_table(codec)[c]]) if c in _table(codec) else None
        if b is None:
            out.append((False, c))
        elif out and out[-1][0]:
            out[-1] = (True, out[-1][1] + b)
        else:
            out.append((True, b))
    return out


def _back(b: bytes, codec: str) -> str:
    if codec in MULTI:
        return b.decode(codec, "replace")
    return "".join(chr(x) if x < 128 else _letters(codec)[x] for x in b)


def _utf8_read_as(s: str, codec: str) -> str | None:
    """``s`` with the UTF-8 sequences decoded that someone read as ``codec``; None if there are none."""
    out, hit = [], False
    for known, piece in _encode(s, codec):
        if not known:
            out.append(piece)
            continue
        at = 0
        for m in UTF8.finditer(piece):
            out += [_back(piece[at : m.start()], codec), m.group().decode("utf-8", "replace")]
            at, hit = m.end(), True
        out.append(_back(piece[at:], codec))
    text = "".join(out)
    return text if hit and "�" not in text.replace("�", "", s.count("�")) else None


@lru_cache(maxsize=200_000)
def _marks(c: str) -> tuple[int, int, int, int]:
    """Sets of encodings (bits, in ORDER) that have the character; in which it holds the start of a UTF-8 sequence; ends with one; begins with the middle of one."""
    has = inside = last = first = 0
    for k, codec in enumerate(ORDER):
        if codec in WIDE:
            try:
                b = c.encode(codec)
            except UnicodeEncodeError:
                continue
        elif c in (t := _table(codec)):
            b = bytes([t[c]])
        elif c < "\x80":
            b = c.encode()
        else:
            continue
        bit = 1 << k
        has |= bit
        first |= bit if 0x80 <= b[0] <= 0xBF else 0
        last |= bit if 0xC2 <= b[-1] <= 0xF4 else 0
        inside |= bit if any(0xC2 <= x <= 0xF4 and 0x80 <= y <= 0xBF for x, y in zip(b, b[1:])) else 0
    return has, inside, last, first


ALL_WIDE = sum(1 << k for k, c in enumerate(ORDER) if c in WIDE)


@lru_cache(maxsize=200_000)
def suited(s: str) -> tuple[str, ...]:
    """Encodings in which ``s`` may hold a UTF-8 sequence; those of several bytes a character have to hold all of ``s``."""
    possible, last, has = 0, 0, -1
    for c in s:
        own, inside, ends, first = _marks(c)
        possible |= inside | (last & first)
        last = ends
        has &= own if c != "�" else -1
    possible &= has | ~ALL_WIDE
    return tuple(c for k, c in enumerate(ORDER) if possible >> k & 1)


@lru_cache(maxsize=200_000)
def utf8_swaps(run: str) -> dict[str, str]:
    """What ``run`` may have been if it is UTF-8 that was read as another encoding, once or more often, and the last of these, or one that is not usual.

    Every reading takes fewer bytes than what it is read from, so the search ends by itself.
    """
    found: dict[str, str] = {}
    level = [(html.unescape(run), "")]
    while level:
        new = []
        for s, by in level:
            for codec in suited(s):
                if by and codec != by and codec not in USUAL:
                    continue  # an uncommon page garbled all of it
                t = _utf8_read_as(s, codec)
                if t and t not in found and t != run and len(t.encode("utf-8", "replace")) < len(s.encode("utf-8", "replace")):
                    found[t] = by if by and (by not in USUAL or codec in USUAL) else codec
                    new.append((t, found[t]))
        level = new
    return found


@lru_cache(maxsize=200_000)
def telling(run: str) -> tuple[str, ...]:
    """Readings as UTF-8 that make a run suspect: by usual encodings, or by another if it decodes all of the run."""
    high = sum(c >= "\x80" for c in run)
    return tuple(t for t, c in utf8_swaps(run).items() if c in USUAL or 2 * sum(x >= "\x80" for x in t) <= high)


def common(swap: str) -> bool:
    return USUAL.issuperset(swap.split(">"))


@lru_cache(maxsize=200_000)
def swaps_of(run: str, every: bool = True) -> dict[str, str]:
    """What ``run`` may have been before one or more swaps of encodings, and the swap (right > wrong).

    With ``every``, swaps of two one-byte pages take all pages, not the common ones only.
    """
    pages, wide = (PAGES, WIDE) if every else (SINGLE, MULTI)
    found = {t: f"utf_8>{c}" for t, c in utf8_swaps(run).items()}
    if html.unescape(run) == run:
        read: dict[bytes, str] = {}
        for wrong in pages:
            pieces = _encode(run, wrong)
            if len(pieces) == 1 and pieces[0][0]:
                read.setdefault(pieces[0][1], wrong)
        for b, wrong in read.items():
            for right in pages:
                t = _back(b, right)
                if t != run and t not in found and not any("\x80" <= c <= "\x9f" or c.isspace() or c == "\xad" for c in t):
                    found[t] = f"{right}>{wrong}"
            for right in wide:
                try:
                    found.setdefault(b.decode(right), f"{right}>{wrong}")
                except UnicodeDecodeError:
                    pass
        for codec in ("latin_1", "cp1252"):
            t = _back(run.encode("utf-8"), codec)
            if "�" not in run and ("\u0080" > t or not any("\x80" <= c <= "\x9f" for c in t)):
                found.setdefault(t, f"{codec}>utf_8")
    found.pop(run, None)
    return found


def readings(run: str) -> tuple[str, ...]:
    return tuple(swaps_of(run))


# fixed values: letters of other scripts that look like Latin ones, by their code names
LOOKALIKE = {ord(a): b for a, b in zip("асеорхуіјѕһԁАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijshdABEKMHOPCTXIJSABEZHIKMNOPTYX")}


def lookalike(run: str) -> str | None:
    """``run`` in Latin letters if all its characters look like some: a disguise, not damage."""
    return run.translate(LOOKALIKE) if all(ord(c) in LOOKALIKE for c in run) else None


def _script(c: str) -> str:
    return "" if not c.isalpha() else "c" if "\u0400" <= c <= "\u04ff" else "h" if c >= "\u3000" else "l"


def sensible(before: str, run: str, after: str, reading: str) -> bool:
    """Whether a swap of two one-byte code pages may be read that way in this place.

    Letters next to each other share a script, and a dash or quote between blanks or signs
    is taken for what it is.
    """
    for near, own in ((before, reading[0]), (after, reading[-1])):
        if _script(near) and _script(own) and _script(near) != _script(own):
            return False
    return not (len(run) == 1 and "\u2010" <= run <= "\u2027" and not before.isalpha() and not after.isalpha())


@lru_cache(maxsize=100_000)
def _shape(c: str) -> str:
    """Characters as the language model sees them."""
    if c < "\x80":
        return "0" if c.isdigit() else " " if c.isspace() else c.lower()
    return " " if c.isspace() else c


def _block(c: str) -> str:
    return chr(ord(c) // BLOCK * BLOCK)


def pair_of(a: str, b: str) -> tuple[str, str]:
    """The bigram of two shapes; two characters of scripts with thousands of them count by their blocks."""
    return (_block(a), _block(b)) if a >= WIDE_FROM and b >= WIDE_FROM else (a, b)


@lru_cache(maxsize=100_000)
def cuts(run: str) -> tuple[int, ...]:
    """Where a run is cut into windows: at most LONG_RUN characters each, never inside a sequence that may be UTF-8."""
    if len(run) <= LONG_RUN or "&" in run:
        return (0, len(run))
    best: set[int] = set()
    for codec in suited(run):
        starts, covered = {0}, 0
        pieces = _encode(run, codec)
        if len(pieces) != 1 or not pieces[0][0]:
            continue
        place, b = [0], 0
        for c in run:
            b += len(_encode(c, codec)[0][1])
            place.append(b)
        index = {b: k for k, b in enumerate(place)}
        for m in UTF8.finditer(pieces[0][1]):
            starts |= {index[x] for x in (m.start(), m.end()) if x in index}
            covered += m.end() - m.start()
        if covered >= 0.8 * b and len(starts) > len(best):
            best = starts
    out = [0]
    while len(run) - out[-1] > LONG_RUN:
        near = [k for k in best if out[-1] < k <= out[-1] + LONG_RUN]
        out.append(max(near) if near else out[-1] + LONG_RUN)
    return (*out, len(run))


def windows(before: str, run: str, after: str) -> Iterator[tuple[str, str, str]]:
    """(character before, window, character after) of a run."""
    at = cuts(run)
    for a, b in zip(at, at[1:]):
        yield _shape(run[a - 1] if a else before), run[a:b], _shape(run[b] if b < len(run) else after)


def _surrounded(text: str, m: re.Match) -> Iterator[tuple[str, str, str]]:
    return windows(text[m.start() - 1] if m.start() else " ", m.group(), text[m.end()] if m.end() < len(text) else " ")


def runs_of(text: str) -> Iterator[tuple[str, str, str]]:
    """(character before, run, character after); long runs in windows."""
    for m in RUN.finditer(text):
        yield from _surrounded(text, m)


def _bigrams(text: str) -> tuple[set[tuple[str, str]], dict[str, set[tuple[str, str]]]]:
    """Bigrams with a non-ASCII character; pairs of ASCII stay as they are under every swap.

    Those of runs that may be UTF-8 read wrongly come by run, as far as no other place holds them.
    """
    out: set[tuple[str, str]] = set()
    suspect: dict[str, set[tuple[str, str]]] = {}
    for m in re.finditer(r"[^\x00-\x7f]+", text):
        s = [_shape(c) for c in text[max(0, m.start() - 1) : m.end() + 1]]
        s = s if m.start() else [" ", *s]
        s = s if m.end() < len(text) else [*s, " "]
        run = m.group()
        at = cuts(run)
        for a, b in zip(at, at[1:]):
            piece = run[a:b]
            part = s[a : b + 2]
            (suspect.setdefault(piece, set()) if telling(piece) else out).update(map(pair_of, part, part[1:]))
    return out, {r: x for r, b in suspect.items() if (x := b - out)}


class Bigrams:
    """Log probability of a run in its context, from document counts of bigrams and characters."""

    def __init__(self, pairs: dict[tuple[str, str], int], docs: int):
        self.pairs, self.docs = pairs, max(docs, 1)
        left: Counter = Counter()
        for (a, _), n in pairs.items():
            left[a] += n
        # an ASCII character is followed by ASCII in most texts
        self.left = {a: (n if a >= "\x80" else max(n, self.docs)) for a, n in left.items()}

    def known(self, reading: str) -> bool:
        """Whether all its characters occur elsewhere."""
        return all(c < "\x80" or _shape(c) == " " or self.count(_shape(c)) for c in reading)

    def count(self, c: str) -> int:
        return max(self.left.get(c, 0), self.left.get(_block(c), 0) if c >= WIDE_FROM else 0)

    def seen_pair(self, a: str, b: str) -> int:
        return self.pairs.get(pair_of(a, b), 0)

    def seen(self, before: str, run: str, after: str) -> bool:
        """Whether both ends of ``run`` occur in such a place elsewhere."""
        return all(
            (a < "\x80" and b < "\x80") or self.seen_pair(a, b) > 1 for a, b in ((before, _shape(run[0])), (_shape(run[-1]), after))
        )

    def score(self, before: str, run: str, after: str) -> float:
        s = [before, *map(_shape, run), after]
        out = 0.0
        for a, b in zip(s, s[1:]):
            if a < "\x80" and b < "\x80":
                out -= 0.5  # letters that a swap made ASCII are common, not free
            else:
                p = pair_of(a, b)
                out += math.log((self.pairs.get(p, 0) + 0.02) / (self.left.get(p[0], 0 if a >= "\x80" else self.docs) + 4.0))
        return out


def _model(counts: DataFrame, docs: int) -> Bigrams:
    """The bigrams, the document that is judged left out: one that only a single document has counts for nothing.

    Pairs of two characters from U+2E80 on are counted by blocks of BLOCK, all others one by one,
    so that the table is bounded by the alphabets, however many documents there are.
    """
    pairs = counts.groupBy("b", "a").agg(F.sum("n").alias("n")).filter("n > 1").collect()
    return Bigrams({(r["b"], r["a"]): r["n"] for r in pairs}, docs)


def suspicious(run: str, n: int, model: Bigrams) -> bool:
    """Whether ``run``, in ``n`` places, has a reading as UTF-8 in characters that are not far rarer; it does not count as sound text then."""
    least = n * math.exp(-MIN_GAIN)
    return any(
        model.known(o) and all(c < "\x80" or _shape(c) == " " or model.count(_shape(c)) >= least for c in o) for o in telling(run)
    )


def learn(contexts: list[tuple[str, str, str, int]], model: Bigrams, rounds: int = 6) -> list[tuple[str, str, str, str, float, str]]:
    """EM of one source and run: (before, run, after, reading, gain, swap) where the run stands for something else.

    The weight of a reading is shared by all contexts of its run, the bigrams of a context
    say how well it fits there. A context may have one reading by common code pages and one by others.
    """
    by_run: dict[str, list[tuple[str, str, int]]] = {}
    for before, run, after, n in contexts:
        by_run.setdefault(run, []).append((before, after, n))
    out = []
    for run, ctx in by_run.items():
        # one letter says too little against thousands of swaps; a word that the texts do not spell like that does
        strange = len(run) >= WORD_RUN and min(model.seen_pair(_shape(a), _shape(b)) for a, b in zip(run, run[1:])) <= max(20, RARE * model.docs)
        every = swaps_of(run, strange)
        # what no text holds is no reading
        options = [run, *(o for o in every if model.known(o))]
        if len(options) == 1:
            continue
        if other := lookalike(run):
            options.append(other)
        usual = np.array([common(every.get(o, "utf_8")) for o in options])
        swapped = [len(o) == len(run) for o in options]
        decoded = utf8_swaps(run)
        fit = np.array(
            [
                [
                    model.score(b, o, a) if o in (run, other) or not s or (sensible(b, run, a, o) and model.seen(b, o, a)) else -1e9
                    for o, s in zip(options, swapped)
                ]
                for b, a, _ in ctx
            ]
        )
        # a text in capitals, or in small letters only, is sound
        fit[:, 0] = [max(model.score(b, o, a) for o in {run, run.lower(), run.upper()}) for b, a, _ in ctx]
        n = np.array([c for _, _, c in ctx], dtype=np.float64)
        for own in ([usual] if usual.all() else [usual, ~usual]):
            own = own.copy()
            own[0] = True
            if own.sum() == 1:
                continue
            names, f = [o for o, k in zip(options, own) if k], fit[:, own]
            weight = np.full(len(names), (1 - CURRENT) / (len(names) - 1))
            weight[0] = CURRENT
            for _ in range(rounds):
                post = f + np.log(weight)
                post = np.exp(post - post.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                weight = n @ post + 0.05
                weight[0] += 0.5
                weight /= weight.sum()
            for (b, a, _), x, o in zip(ctx, f, post.argmax(axis=1)):
                gain = float(x[o] - x[0])
                # the model has not seen a run that may be UTF-8, so the source's weight of the reading counts as well
                odds = gain + math.log(weight[o] / weight[0]) if names[o] in decoded else gain
                if o and odds > MIN_GAIN and names[o] != other:
                    out.append((b, run, a, names[o], gain, every[names[o]]))
    return out


def damage(df: DataFrame, doc_id: Column, text: Column, source: Column) -> tuple[DataFrame, DataFrame]:
    """(runs, swaps): the runs of every text, and what the damaged ones stand for.

    runs: ``doc_id``, ``source``, ``b``, ``run``, ``a``, ``lost`` (an unrecoverable place, then without a run).
    swaps: ``source``, ``b``, ``run``, ``a``, ``reading``, ``gain``. Both are written to the shared folder.

    Counts cover all texts. The bigram table has one row per pair of distinct characters
    (pairs seen in one document only are left to smoothing), bounded by the alphabets, not by the number of documents, and is
    the only thing sent to all tasks. Contexts are counted before they are grouped by
    source, so that a source with a third of the texts costs one task its distinct contexts
    only; they are spread by (source, run), the unit that EM works on.
    """
    spark = df.sparkSession
    docs = df.select(doc_id.alias("doc_id"), F.coalesce(source.cast("string"), F.lit("")).alias("source"), text.alias("text")).filter(
        "doc_id IS NOT NULL AND text IS NOT NULL"
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            pairs: Counter = Counter()
            for i, s, t in zip(b["doc_id"], b["source"], b["text"]):
                rows += [(i, s, x, r, y, False, 1) for x, r, y in set(runs_of(t))]
                if LOST.search(t):
                    rows.append((i, s, None, None, None, True, 1))
                sure, suspect = _bigrams(t)
                pairs.update((None, *p) for p in sure)
                pairs.update((r, *p) for r, own in suspect.items() for p in own)
            # bigrams are counted per batch; their rows carry no document
            rows += [(None, None, x, r, y, False, n) for (r, x, y), n in pairs.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "b", "run", "a", "lost", "n"])

    kind = df.select(doc_id.alias("x")).schema["x"].dataType.simpleString()
    found = written(docs.mapInPandas(scan, f"doc_id {kind}, source string, b string, run string, a string, lost boolean, n long"), "runs")
    total = docs.count()
    counted = found.filter("source IS NULL").groupBy("b", "run", "a").agg(F.sum("n").alias("n"))
    alphabet = spark.sparkContext.broadcast(_model(counted, total))

    def sound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[not suspicious(r, n, alphabet.value) for r, n in zip(b["run"], b["most"])], ["b", "a", "n"]]

    suspects = counted.filter("run IS NOT NULL").withColumn("most", F.max("n").over(Window.partitionBy("run")))
    counts = counted.filter("run IS NULL").select("b", "a", "n").unionByName(suspects.mapInPandas(sound, "b string, a string, n long"))
    shared = spark.sparkContext.broadcast(_model(counts, total))
    runs = found.filter("source IS NOT NULL").drop("n")
    contexts = runs.filter("run IS NOT NULL").groupBy("source", "run", "b", "a").agg(F.count("*").alias("n"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, open_key, ctx = [], None, []

        def close() -> None:
            rows.extend((open_key[0], *x) for x in learn(ctx, shared.value))

        for b in batches:
            for s, r, x, y, n in zip(b["source"], b["run"], b["b"], b["a"], b["n"]):
                if (s, r) != open_key:
                    if ctx:
                        close()
                    open_key, ctx = (s, r), []
                ctx.append((x, r, y, n))
            yield pd.DataFrame(rows, columns=["source", "b", "run", "a", "reading", "gain", "swap"])
            rows = []
        if ctx:
            close()
        yield pd.DataFrame(rows, columns=["source", "b", "run", "a", "reading", "gain", "swap"])

    readings_ = written(
        contexts.repartition(shuffle_partitions(spark), "source", "run")
        .sortWithinPartitions("source", "run")
        .mapInPandas(decide, "source string, b string, run string, a string, reading string, gain double, swap string"),
        "readings",
    )
    # a source's weight of a swap is the number of runs it explains there; sources x swaps rows
    weight = readings_.groupBy("source", "swap").agg(F.count_distinct("run").alias("w"))
    usual = [f"{r}>{w}" for r in sorted(USUAL) for w in sorted(USUAL)]
    swaps = (
        readings_.join(weight, ["source", "swap"])
        .filter((F.col("w") >= UNCOMMON) | F.col("swap").isin(usual))
        .groupBy("source", "b", "run", "a")
        .agg(F.max_by(F.struct("reading", "gain"), F.struct((F.col("gain") + F.log("w") - F.when(F.col("swap").isin(usual), 0.0).otherwise(MIN_GAIN)).alias("s"), "reading")).alias("x"))
        .select("source", "b", "run", "a", "x.reading", "x.gain")
    )
    return runs, written(swaps, "swaps")


def garbled(df: DataFrame, doc_id: Column, text: Column, source: Column) -> DataFrame:
    """``doc_id`` of every text with a damaged run, a lost character or a stray control code.

    Null and empty texts hold none. Rows repeated under an id count once, each copy of a
    text under its own id. A null source is a source of its own. Correct rare characters stay
    where the language model finds them likelier than any reading of them.
    """
    runs, swaps = damage(df, doc_id, text, source)
    hit = runs.filter("run IS NOT NULL").join(swaps.select("source", "run", "b", "a"), ["source", "run", "b", "a"], "left_semi")
    return hit.select("doc_id").unionByName(runs.filter("lost").select("doc_id")).distinct()


def restored(df: DataFrame, doc_id: Column, text: Column, source: Column) -> DataFrame:
    """``doc_id``, ``text`` as restored, ``complete``: no damaged place is left.

    One row per damaged document; of texts repeated under one id the smallest. The readings of a document's runs form its translation table:
    single characters go through ``str.translate``, longer runs are looked up whole.
    """
    runs, swaps = damage(df, doc_id, text, source)
    tables = (
        runs.filter("run IS NOT NULL")
        .join(swaps, ["source", "run", "b", "a"])
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("gain", "b", "run", "a", "reading")).alias("swaps"))
    )
    lost = runs.filter("lost").select("doc_id").distinct().withColumn("lost", F.lit(True))
    hit = tables.join(lost, "doc_id", "full")
    docs = df.select(doc_id.alias("doc_id"), text.alias("text")).filter("text IS NOT NULL")

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [mended(t, [] if s is None else list(s)) for t, s in zip(b["text"], b["swaps"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": out, "complete": [not LOST.search(x) for x in out]})

    kind = df.select(doc_id.alias("x")).schema["x"].dataType.simpleString()
    # written, so that its size is known when Spark chooses the join with the texts
    one = docs.join(written(hit, "hit"), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "swaps"), "text").alias("x"))
    return one.select("doc_id", "x.text", "x.swaps").mapInPandas(mend, f"doc_id {kind}, text string, complete boolean")


def mended(text: str, swaps: list) -> str:
    exact = {(s["b"], s["run"], s["a"]): s["reading"] for s in swaps}
    single = {ord(s["run"]): s["reading"] for s in swaps if len(s["run"]) == 1}

    def put(m: re.Match) -> str:
        return "".join(exact.get((b, r, a), r) for b, r, a in _surrounded(text, m))

    # one translation table serves single characters where every place of the text agrees
    places = Counter(r for _, r, _ in runs_of(text) if len(r) == 1)
    agreed = {c: v for c, v in single.items() if sum(1 for b, r, a in runs_of(text) if r == chr(c) and exact.get((b, r, a)) == v) == places[chr(c)]}
    if agreed and all(chr(c) not in m.group() or len(m.group()) == 1 for c in agreed for m in RUN.finditer(text)):
        longer = {k: v for k, v in exact.items() if len(k[1]) > 1}
        if not longer:
            return text.translate(agreed)
    return RUN.sub(put, text)
