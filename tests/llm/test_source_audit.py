"""The source audit against plain loops, with whole and with narrow digests."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterscope.llm import source_audit as sa

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows, least=3, top=200):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    groups = sorted({(r[1], r[2]) for r in rows})
    out = {}
    for lang in {g[0] for g in groups}:
        docs = [(r[2], TERM.findall(r[0].translate(LOWER))) for r in rows if r[1] == lang]
        df = {}
        for _, terms in docs:
            for t in set(terms):
                df[t] = df.get(t, 0) + 1
        kept = sorted(t for t, n in df.items() if n >= least)
        sources = [s for g, s in groups if g == lang]
        count = {(s, t): 0 for s in [*sources, None] for t in kept}
        for s, terms in docs:
            for t in terms:
                if (s, t) in count:
                    count[s, t] += 1
                    count[None, t] += 1
        p = {}
        for s in [*sources, None]:
            n = sum(count[s, t] for t in kept)
            for t in kept:
                p[s, t] = 1 + 10**9 * (count[s, t] + 1) // (n + len(kept))
        for s in sources:
            pairs = [(sum((p[s, t] - p[o, t]) ** 2 // p[o, t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s, t] - p[None, t]) ** 2 // p[None, t], t) for t in kept if count[s, t] and p[s, t] > p[None, t]]
            for part, listed in (("pair", pairs), ("term", terms)):
                listed.sort(key=lambda x: (-x[0], x[1].encode()))
                for k, (value, item) in enumerate(listed, 1):
                    if part == "pair" or k <= top:
                        out[lang, s, part, item] = (value, k)
    return out


def some_rows(n=120, seed=2):
    rng = random.Random(seed)
    words = ["Der", "die", "DAS", "été", "Été", "日本", "naïve", "x", " ", "don't", "a1b", "🙂", "over-all", "tail"] + [
        f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(40)))
        rows.append((rng.choice([text, text, text, None, "", "1 2 3"]), rng.choice(["en", "en", "de", None, ""]),
                     rng.choice(["s1", "s1", "s1", "s2", "s3", None, "sé"])))
    rows += [("seldom seldom", "fr", "s1"), ("seldom", "fr", "s2"), (None, "it", "only")]
    return rows


def got_of(df):
    return {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("bits", [64, 5, 0])
def test_equals_plain_audit(spark, bits):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")
    out = sa.audit_sources(docs.repartition(5), digest_bits=bits)
    assert out.count() == len(plain_audit(rows))
    assert got_of(out) == plain_audit(rows)


def test_top_ranks_with_ties(spark):
    rows = [(" ".join(chr(97 + k) * 3 for k in range(20)), "en", "a")] * 3 + [("other words", "en", "b")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got_of(sa.audit_sources(docs, top=4)) == plain_audit(rows, top=4)
    assert got_of(sa.audit_sources(docs, least_documents=4)) == {("en", "a", "pair", "b"): (0, 1), ("en", "b", "pair", "a"): (0, 1)}


def test_groups_joined_by_shuffle_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(sa, "MAX_GROUPS_BROADCAST", 0)
    monkeypatch.setattr(sa, "MAX_DIGESTS_BROADCAST", 0)
    monkeypatch.setattr(sa, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(sa, "HELD_ROWS", 50)
    rows = some_rows(60, 9)
    assert got_of(sa.audit_sources(spark.createDataFrame(rows, "text string, lang string, source string"))) == plain_audit(rows)


def test_large_counts_stay_exact(spark):
    n, total = 9_300_000_000_000, 31_000_000_000_007
    row = spark.range(1).select(sa.share(F.lit(n), F.lit(total)).alias("big"), sa.share(F.lit(5), F.lit(7)).alias("small"),
                                sa.share(F.lit(0).cast("long"), F.lit(0).cast("long")).alias("none")).first()
    assert tuple(row) == (1 + 10**9 * (n + 1) // total, 1 + 10**9 * 6 // 7, None)


def test_terms_of_odd_texts():
    texts = ["", "Ab\x00cD é1É", "\n", "z" * 700, "[\\]^_`{|}~\x7f@A"]
    t = sa.Terms(texts)
    want = [(k, w) for k, x in enumerate(texts) for w in TERM.findall(x.translate(LOWER))]
    assert [(int(k), t.data[a:b].decode()) for k, a, b in zip(t.text, t.starts, t.ends)] == want
    digests, _, at = t.distinct()
    terms = t.spelled(at)
    assert sorted(terms) == sorted({w for _, w in want}) and len(np.unique(digests)) == len(terms)


def test_long_text_and_empty_table(spark, no_docs):
    rows = [("Wort " * 300_000, "de", "a"), ("wort " * 3, "de", "b"), ("WORT", "de", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got_of(sa.audit_sources(docs)) == plain_audit(rows)
    out = sa.audit_sources(no_docs.withColumn("source", F.lit("x")))
    assert out.collect() == [] and out.columns == ["lang", "source", "part", "item", "value", "rank"]
