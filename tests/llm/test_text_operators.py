"""Packing, leak search and encoding repair, with blank, very long, repeated and missing texts."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import leakage, mojibake, packing

CLEAN = ["Größere Änderungen wurden bei {n} °C sichtbar.", "La señal cayó {n} % según el ensayo número {n}.", "L’activité décroît dès {n} µM, c’est très tôt.", "Участок рядом открывается медленно и теряет {n} %.",
         "Spacing {n} Å—7.5 Å, in Å² 4.70; the Ångström header is kept.", "The pose of {n} looks broad.", "重复 {n} 次，平均值 3.94 ± 1.71。", "São réplicas idênticas, {n} % de diferença não mudou após a diluição."]


def corpus(n=600, seed=1):
    r = random.Random(seed)
    return [(k, " ".join(r.choice(CLEAN).format(n=r.randint(1, 99)) for _ in range(r.randint(1, 4))), f"s{k % 3}") for k in range(n)]


def damaged(text):
    for wrong, right in (("cp1252", "utf-8"), ("latin_1", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8")):
        try:
            yield text.encode(right).decode(wrong)
        except UnicodeDecodeError:
            pass


def test_damage_is_found_and_mended(spark):
    docs = corpus()
    bad = {}
    for j, t in enumerate(["Größere Änderungen wurden bei 7 °C sichtbar.", "La señal cayó 8 % según el ensayo número 8.", "L’activité décroît dès 9 µM, c’est très tôt.", "São réplicas idênticas, 5 % de diferença não mudou após a diluição."]):
        for v in damaged(t):
            bad[1000 + len(bad)] = (v, t)
        twice = t.encode("utf-8").decode("latin_1").encode("utf-8").decode("latin_1")
        bad[1000 + len(bad)] = (twice, t)
    rows = docs + [(i, v, "s1") for i, (v, _) in bad.items()] + [(5000, None, "s1"), (5001, "", None), (5002, " ", "s1"), (5003, "Bia�ko", "s9"), (5004, "x" * 200_000 + " Größe", "s0")]
    df = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, source string")
    cols = (F.col("doc_id"), F.col("text"), F.col("source"))
    found = {r[0] for r in mojibake.garbled(df, *cols).collect()}
    assert found == set(bad) | {5003}
    fixed = {r["doc_id"]: (r["text"], r["complete"]) for r in mojibake.restored(df, *cols).collect()}
    good = sum(fixed[i][0] == t for i, (_, t) in bad.items())
    assert good >= 0.7 * len(bad) and fixed[5003][1] is False
    assert mojibake.garbled(df.limit(0), *cols).count() == 0


@pytest.mark.parametrize("codec", ["latin_1", "cp437"])
def test_a_source_damaged_throughout_is_found(spark, codec):
    plain = [(k, f"Probe {k} bei {k % 90} °C gelagert." if k % 2 else f"Spacing {k} Å—7.5 Å, in Å² 4.70.", f"s{k % 3}") for k in range(600)]
    bad = {i for i, _, s in plain if s == "s1"}
    df = spark.createDataFrame([(i, t.encode("utf-8").decode(codec) if i in bad else t, s) for i, t, s in plain], "doc_id long, text string, source string")
    cols = (F.col("doc_id"), F.col("text"), F.col("source"))
    assert {r[0] for r in mojibake.garbled(df, *cols).collect()} == bad
    fixed = {r["doc_id"]: r["text"] for r in mojibake.restored(df, *cols).collect()}
    assert all(fixed[i] == t for i, t, _ in plain if i in bad and i % 2)


UNCOMMON = ["cp852", "cp1256", "koi8_u", "mac_cyrillic", "iso8859_7", "cp1258", "cp855", "cp857", "cp775", "iso8859_13", "iso8859_15", "iso8859_16", "mac_greek", "cp1257"]


def test_any_code_page_is_mended(spark):
    r = random.Random(4)
    docs = corpus(900, 3)
    bad = {}
    for k, page in enumerate(UNCOMMON):
        for n in range(12):
            plain = " ".join(r.choice(CLEAN[:4] + CLEAN[7:]).format(n=r.randint(1, 99)) for _ in range(3))
            wrong = "".join(mojibake._letters(page)[b] if b > 127 else chr(b) for b in plain.encode("utf-8"))
            bad[10_000 + 20 * k + n] = (wrong, plain, f"s{k % 3}")
    df = spark.createDataFrame(docs + [(i, w, s) for i, (w, _, s) in bad.items()], "doc_id long, text string, source string")
    cols = (F.col("doc_id"), F.col("text"), F.col("source"))
    fixed = {x["doc_id"]: x["text"] for x in mojibake.restored(df, *cols).collect()}
    assert set(fixed) == set(bad)
    good = sum(fixed[i] == p for i, (_, p, _) in bad.items())
    assert good >= 0.9 * len(bad), good / len(bad)


def test_words_of_an_uncommon_one_byte_page(spark):
    words = "Участок рядом открывается медленно и теряет часть активности после разбавления раствора".split()
    r = random.Random(6)
    docs = [(k, " ".join(r.sample(words, 6)), f"s{k % 3}") for k in range(300)]
    bad = {1000 + k: " ".join(r.sample(words, 6)) for k in range(6)}
    rows = docs + [(i, t.encode("cp1251").decode("cp775"), "s1") for i, t in bad.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {x[0] for x in mojibake.garbled(df, F.col("doc_id"), F.col("text"), F.col("source")).collect()} == set(bad)


def test_long_runs_are_cut_between_sequences():
    for page in ("cp1252", "latin_1", "cp437"):
        text = "уважаемыйчитательэтогодлинногослова" * 3
        run = "".join(mojibake._letters(page)[b] for b in text.encode("utf-8"))
        at = mojibake.cuts(run)
        assert all(b - a <= mojibake.LONG_RUN and a % 2 == 0 for a, b in zip(at, at[1:]))
    assert mojibake.cuts("я" * 60) == (0, 24, 48, 60)


def test_no_reading_is_cut_off():
    for text, codecs in (("β", ("koi8_r", "mac_roman", "cp1250")), ("–", ("cp1253", "mac_roman", "cp1250")), ("äö", ("cp1251", "cp1254", "iso8859_2"))):
        run = text
        for c in codecs:
            run = run.encode("utf-8").decode(c)
        assert text in mojibake.readings(run)


def test_unusual_but_sound_characters():
    assert mojibake.lookalike("ес") == "ec" and mojibake.lookalike("éс") is None
    assert list(mojibake.runs_of("a é b")) == [(" ", "é", " ")]
    long = "я" * 100
    assert "".join(r for _, r, _ in mojibake.runs_of(long)) == long


ITEMS = [(1, "Explain why the curious reductase from Northern Vexlam tolerates Gln at position forty yet doubles quiet turnover in stopped flow experiments of late spring."),
         (2, "Name the brittle channel which Marzipan Obelik soaked with tender foxglove acid until every gradient beside the hinge became asymmetric and pale."), (3, None), (4, "...")]
FILL = "Rows of ordinary notes about buffers and plates fill this text with nothing of interest. "


def test_leaks(spark):
    one, two = ITEMS[0][1], ITEMS[1][1]
    w = one.split()
    docs = [
        (1, FILL * 3 + one + FILL), (2, FILL + one.upper()), (3, FILL + " ".join(w[:6] + ["changed"] + w[7:14] + ["words"] + w[15:]) + FILL), (4, FILL + " ".join(two.split()[11:] + ["and"] + two.split()[:11])),
        (5, FILL + " ".join(w[4:11])), (6, FILL), (7, None), (8, ""), (9, FILL * 3000 + two), (10, FILL * 3 + one + FILL), (11, one.replace("o", "о").replace("a", "а")), (12, one.replace(" ", " \n")), (13, one.replace("reductase", "redcutase").replace("Northern", "Nothern")),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs] + [(1, docs[0][1], 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 2), (9, 2), (10, 1), (11, 1), (12, 1), (13, 1)}
    for a, b in ((df.limit(0), items), (df, items.limit(0))):
        assert leakage.leaks(a, F.col("doc_id"), F.col("text"), b, F.col("item_id"), F.col("text")).count() == 0


def test_leaks_of_common_words(spark):
    words = "which of the following sites binds the given ligand most tightly when both chains of this protein are open and".split()
    orders = [random.Random(k).sample(words, len(words)) for k in range(8)]
    items = spark.createDataFrame([(k, " ".join([*o, f"own{k}a", f"own{k}b"])) for k, o in enumerate(orders)], "item_id long, text string")
    one = orders[0]
    docs = [(1, FILL + " ".join(one[2:16]) + " " + FILL), (2, FILL + " ".join(one[2:9]) + " " + FILL), (3, " ".join(one[2:10]) + " " + FILL + " ".join(one[10:13])), (4, FILL * 2 + " ".join(one[:14]).upper()), (5, FILL + " ".join(f"own{k}a own{k}b" for k in range(8)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text")).collect()}
    assert got == {(1, 0), (4, 0)}
    assert leakage.stretches(one[2:16], one, set(words))[1:3] == (14, 14)


def test_passed_over_words_count_once():
    words = "which of the following sites binds the given ligand most tightly when both chains of this protein are open and".split()
    common = set(words)
    for n in (10, 13, 14):
        score, matched, row, _ = leakage.stretches(words[:n], words, common)
        assert (matched, row) == (n, n) and score == pytest.approx(leakage.COMMON * n)
        assert bool(leakage.found_in(words[:n], [(1, words, None)], common)) == (n >= 14)


def test_the_filter_lets_all_searched_terms_pass(spark):
    terms = [f"word{k}" for k in range(3000)]
    h = spark.createDataFrame([(leakage._signed(leakage.word_hash(t)),) for t in terms], "h long")
    bits = leakage.term_filter(h)
    assert len(bits) == leakage.FILTER_BITS // 8 and all(leakage.passes(bits, leakage.word_hash(t)) for t in terms)
    assert sum(leakage.passes(bits, leakage.word_hash(f"other{k}")) for k in range(3000)) < 10
    assert spark.createDataFrame([("größe",)], "t string").select(F.xxhash64("t")).first()[0] == leakage._signed(leakage.word_hash("größe"))


def test_hot_terms_are_salted(spark):
    one = ITEMS[0][1]
    docs = [(k, FILL + one) if k % 2 else (k, f"reductase Vexlam note {k}") for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = leakage.leaks(df, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, 1) for k in range(1, 3000, 2)} and len(got) == 1500


def test_postings_are_complete(spark):
    df = spark.createDataFrame([(1, "A b a"), (2, None)], "doc_id long, text string")
    assert {r["term"]: list(r["positions"]) for r in leakage.postings(df, F.col("doc_id"), F.col("text")).collect()} == {"a": [0, 2], "b": [1]}


def counts(spark, seed, n=2000):
    r = random.Random(seed)
    # a third of the texts has one length, some exceed the capacity
    return [(k, 100 if k % 3 == 0 else min(3000, int(r.paretovariate(0.9) * 20))) for k in range(n)]


@pytest.mark.parametrize("capacity", [300, 512])
def test_packing_is_whole_and_tight(spark, capacity):
    rows = counts(spark, capacity)
    got = packing.place(spark.createDataFrame(rows, "doc_id long, n_tokens long"), capacity, group=8).collect()
    used, pieces = {}, {}
    for r in got:
        used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["token_start"], r["n_tokens"]))
    for i, n in rows:
        p = sorted(pieces[i])
        assert sum(x for _, x in p) == n and len(p) == -(-n // capacity) and all(a == k * capacity for k, (a, _) in enumerate(p))
    assert max(used.values()) <= capacity and all(capacity - used[r["container"]] == r["unused"] for r in got)
    total = sum(n for _, n in rows)
    assert len(used) <= total / capacity * 1.02 + 2
    groups = {}
    for r in got:
        groups[r["step_group"]] = groups.get(r["step_group"], 0) + r["n_tokens"]
    full = sorted(groups.values())
    assert full[-1] - full[0] <= 2 * capacity
    windows = {}
    for r in got:
        windows.setdefault((r["tier"], r["window"]), []).append(r["n_tokens"])
    assert all(sum(v) <= capacity >> t for (t, _), v in windows.items())


def test_tiers_change_the_plan():
    r = random.Random(3)
    lengths = Counter(min(2048, int(r.paretovariate(0.9) * 20)) for _ in range(30_000))
    total = sum(n * c for n, c in lengths.items())
    for tiers in (1, 2, 4, 8):
        p = packing.plan(lengths, 2048, tiers)
        assert p.containers <= total / 2048 * 1.005 + 1 and sum(f > 0 for f in p.full) >= min(tiers, 5)
        length = np.concatenate([np.full(c, n) for n, c in lengths.items()])
        at = p.place(length, np.concatenate([np.arange(c) for c in lengths.values()]))
        used = np.bincount(at[:, 0], length, p.containers)
        assert used.max() <= 2048 and (2048 - used[at[:, 0]] == at[:, 1]).all()
        sums = np.bincount(p.group(np.arange(p.containers), 10), used, 10)
        assert sums.max() - sums.min() <= 2 * 2048


def test_packing_edges(spark):
    e = packing.place(spark.createDataFrame([], "doc_id long, n_tokens long"), 64)
    assert e.count() == 0
    copies = packing.place(spark.createDataFrame([(1, 64), (1, 64), (2, 1)], "doc_id long, n_tokens long"), 64).collect()
    assert sorted(r["container"] for r in copies) == [0, 1, 2]


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer file")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", 1), (2, "", 2), (3, " \n", 3), (4, None, 4), (5, "word " * 5000, 5), (6, "<|endoftext|>", 6)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df, F.col("doc_id"), F.col("text")).collect()}
    assert set(got) == {1, 5, 6} and got[1] == 2 and got[5] >= 5000 and got[6] > 1
    p = packing.pack(df, F.col("doc_id"), F.col("text"), 2048)
    assert p.filter("doc_id = 5").count() == -(-got[5] // 2048)
