"""Removal of repeated 100-byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from utterscope.llm import byte_windows, queries, suffix_dups


def plain(rows):
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), suffix_dups.NO_ID if i is None else i
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w not in first or (i, p) < first[w]:
                first[w] = (i, p)
    out = []
    for i, t in rows:
        b, key = (t or "").encode(), suffix_dups.NO_ID if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p:p + 100]] != (key, p):
                gone[p:p + 100] = b"\1" * 100
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def digest(removed):
    return sorted([tuple(r) for r in removed.selectExpr(
        "doc_id", "n_bytes", "n_bytes - octet_length(kept)", "cast(size(starts) as long)", "sha2(kept, 256)").collect()], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)

    def some(n):
        return "".join(rng.choice("abcdefgé ") for _ in range(n))

    line, parts = some(90), [some(rng.randint(60, 400)) for _ in range(6)]
    out = [(i, "".join(rng.choice([some(rng.randint(1, 150)), rng.choice(parts), line, "a" * rng.randint(1, 260), "xy" * 70])
                       for _ in range(rng.randint(0, 8)))) for i in range(30)]
    return out + [(41, out[3][1]), (41, out[3][1]), (None, parts[0] + parts[1]), (None, parts[0] + parts[1]), (42, None),
                  (43, ""), (44, "é" * 300)]


@pytest.mark.parametrize("bounds", [{}, {"max_shared": 2}, {"bucket_bytes": 500}])
def test_equals_brute_force(spark, rows, bounds):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digest(suffix_dups.remove_repeats(docs, **bounds)) == plain(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op7(spark, sf).collect()), key=str) == plain([tuple(d) for d in docs])


def test_buckets_hold_equal_windows_only():
    rng = np.random.default_rng(1)
    codes = np.concatenate([rng.integers(97, 99, 400), np.full(300, 97), np.tile([98, 99, 97], 120)]).astype(np.uint8)
    codes = np.concatenate([codes, codes[50:500]])
    at = np.arange(len(codes) - byte_windows.LENGTH + 1)
    number = suffix_dups.equal_windows(codes, at)
    seen = {}
    for i in at:
        assert seen.setdefault(codes[i:i + 100].tobytes(), number[i]) == number[i]
    assert len(set(seen.values())) == len(seen)


def test_blocks_hold_every_window_once_across_pieces(monkeypatch):
    rng = random.Random(3)
    data = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = byte_windows.blocks(data)
    monkeypatch.setattr(byte_windows, "PIECE", 700)
    for first, count, gram in (whole, byte_windows.blocks(data)):
        assert [w for a, n in zip(first, count) for w in range(a, a + n)] == list(range(len(data) - 99))
    by_window = [{w: g for a, n, g in zip(*b) for w in range(a, a + n)} for b in (whole, byte_windows.blocks(data))]
    assert by_window[0] == by_window[1]  # the minimizer is a matter of the window alone


def test_odd_rows(odd_docs, no_docs):
    assert digest(suffix_dups.remove_repeats(odd_docs)) == plain([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert suffix_dups.remove_repeats(no_docs).count() == 0
