"""The filter audit against plain loops over documents and orders."""

import random
from itertools import permutations

import numpy as np
import pytest

from utterscope.llm import filter_audit as fa


def plain_failures(rows):
    """Per row of (doc_id, text, part): the set of failed filters."""
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ")
                 .split(" ") if w]
        f = set()
        if len(words) < 100:
            f.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            f.add("C")
        if any(c in "#$%&*|" for c in t):
            f.add("D")
        if i is not None and smallest[t] < i:
            f.add("E")
        out.append(f)
    return out


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = plain_failures(rows)
    out, removals = {}, {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                fails = sum(letter in f for _, f in mine)
                removals[part, letter] = removals.get((part, letter), 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), fails - len(gone), sum(f == {letter} for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    return {k: tuple(v) + (removals[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def some_rows(n=150, seed=3):
    rng = random.Random(seed)
    bodies = [None, "", " \t\n", "ALL CAPS " * 60, "a b " * 80, " ".join(f"w{k}" for k in range(120)) + " ü x", "one | two",
              "É" * 9 + "A", "\x1cx\x1d " + " ".join(f"v{k}" for k in range(100))]
    rows = []
    for i in range(n):
        body = rng.choice(bodies) if rng.random() < 0.6 else " ".join(
            rng.choice("ab CD % e f g h i j k l".split()) + str(rng.randrange(400)) for _ in range(rng.randrange(150)))
        rows.append((rng.choice([i, i, None, 7]), body, rng.choice(["en", "en", "de", None, ""])))
    labels = [(rng.randrange(n), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)] + [(None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("share", [fa.HOT_SHARE, 1])  # all repeated texts joined by digest, or some of them handed out
def test_equals_plain_audit(spark, monkeypatch, share):
    monkeypatch.setattr(fa, "HOT_SHARE", share * 12 if share == 1 else share)
    rows, labels = some_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, failed int, part string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fa.audit_filters(docs.repartition(5), told).collect()
    want = plain_audit(rows, labels)
    assert len(got) == len(want) == 3 * 600
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


def test_positional_popcount_counts_every_bit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 9, 31, 1000, 4097):
        words = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert fa.positional_popcount(words).tolist() == [int(((words >> np.uint32(b)) & 1).sum()) for b in range(32)]


def test_survival_word_has_the_subsets_without_a_failure():
    for mask in range(32):
        word = int(fa.survival_words(np.array([mask]))[0])
        assert [s for s in range(32) if word >> s & 1] == [s for s in range(32) if not s & mask]


def test_very_long_text_and_hot_copies(spark):
    rows = [(1, "Wort " * 300_000, "de")] + [(k, "same words", "en") for k in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in fa.audit_filters(docs, labels).collect()}
    assert got["en", "EABCD", 1].removed == 397 and got["en", "EABCD", 1].kept == 1
    assert got["de", "BACDE", 1].removed == 1 and got["de", "BACDE", 1].good_lost == 0
    assert got["en", "ABCDE", 5].redundant == 397 and got["en", "ABCDE", 1].unique_fails == 1


def test_empty_table(spark, no_docs):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    out = fa.audit_filters(no_docs, labels)
    assert out.collect() == []
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
