"""Quality rules: counts against plain loops, accuracies against planted ones."""

import math
import random
import re

import numpy as np

from utterscope.llm import quality_rules as qr
from utterscope.llm import queries

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) for j in range(3) if windows.count(w) > 1} if len(windows) < 3000 else None
    if covered is None:
        from collections import Counter
        often = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) for j in range(3) if often[w] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def plain_posteriors(votes, rounds=500):
    """The same estimate, text by text, without patterns or matrices, from
    the start that turns out likeliest here."""
    k, s = len(votes[0]), 10.0
    g, b, prior = [0.99] * k, [0.1] * k, 0.8

    def posterior(v):
        x = math.log(prior / (1 - prior))
        for j, vote in enumerate(v):
            if vote == 1:
                x += math.log(g[j]) - math.log(1 - b[j])
            if vote == -1:
                x += math.log(1 - g[j]) - math.log(b[j])
        return 1 / (1 + math.exp(-x))

    for _ in range(rounds):
        p = [posterior(v) for v in votes]
        for j in range(k):
            def mass(vote, weights, j=j):
                return sum(w for w, v in zip(weights, votes) if v[j] == vote)
            q = [1 - x for x in p]
            ng = (mass(1, p) + s * 0.95) / (mass(1, p) + mass(-1, p) + s)
            nb = (mass(-1, q) + s * 0.3) / (mass(-1, q) + mass(1, q) + s)
            g[j] = min(max(ng, 0.001), 0.999)
            b[j] = max(min(max(nb, 0.001), 0.999), 1 - g[j])
        prior = (sum(p) + 1) / (len(p) + 2)
    return [posterior(v) for v in votes]


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    counts = {d.doc_id: plain_counts(d.text) for d in docs}
    votes = []
    for d in docs:
        m = qr.measures(d.text or "")
        votes.append([1 if r.good[0] <= m[r.measure] <= r.good[1] else
                      -1 if m[r.measure] < r.fair[0] or m[r.measure] > r.fair[1] else 0 for r in qr.RULES])
    posterior = dict(zip([d.doc_id for d in docs], plain_posteriors(votes, 120)))
    got = {r.doc_id: r for r in queries.op13(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, (n, chars, symbols, dup, rep) in counts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert abs(r.posterior - posterior[i]) < 1e-4
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op13(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [got[i] for i, q in labels.items() if q == 1 and i in got and not got[i].base_failed]
    bad = [got[i] for i, q in labels.items() if q == 0 and i in got]
    assert sum(r.kept for r in good) > 0.99 * len(good)
    assert sum(not r.kept for r in bad) > 0.9 * len(bad)


def test_accuracies_are_recovered():
    rng = random.Random(4)
    on_good, on_bad, cover = [0.95, 0.9, 0.8, 0.85, 0.7], [0.9, 0.7, 0.85, 0.6, 0.8], [0.9, 0.7, 0.8, 1, 0.5]
    truth = [rng.random() < 0.7 for _ in range(40_000)]
    votes = np.array([[0 if rng.random() > c else (1 if (rng.random() < (g if t else b)) == t else -1)
                       for g, b, c in zip(on_good, on_bad, cover)] for t in truth])
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    fit = qr.fit_accuracies(rows, counts)
    assert abs(fit.prior - 0.7) < 0.03
    assert np.abs(fit.on_good - on_good).max() < 0.03 and np.abs(fit.on_bad - on_bad).max() < 0.05


def test_repeated_words_of_odd_lists():
    for words in ("", "a", "a b c", "a a a", "a a a a", "a b c a b c", "a b a b a b", "x a b c y a b c z", "a b c d e f a b"):
        own = words.encode().split()
        assert qr.repeated_words(own) == plain_counts(words)[4]


def test_odd_rows(odd_docs, no_docs):
    got = qr.score_quality(odd_docs).collect()
    assert len(got) == 9 and all(0 <= r.posterior <= 1 for r in got)
    blank = [r for r in got if r.doc_id in (1, 2, 3)]
    assert all((r.n_words, r.word_chars, r.n_repeat_words, r.base_failed, r.kept) == (0, 0, 0, True, False) for r in blank)
    same = [tuple(r) for r in got if r.doc_id == 5]
    assert len(same) == 2 and same[0] == same[1]
    long = next(r for r in got if r.doc_id == 6)
    assert long.n_repeat_words == long.n_words == 20_000 and long.base_failed
    assert qr.score_quality(no_docs).collect() == []
