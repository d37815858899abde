"""SimHash near-duplicates against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import xxhash

from utterscope.llm import queries, simhash

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    parts = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, bits=4):
    prints = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
    label = np.arange(len(prints))
    while True:
        new = np.array([label[row].min() for row in near])
        new = new[new]
        if (new == label).all():
            break
        label = new
    small = {}
    for i, lab in zip(ids, label):
        small[lab] = i if small.get(lab) is None else small[lab] if i is None else min(i, small[lab])
    return [small[lab] for lab in label]


def test_any_four_positions_hold_a_triple():
    triples = [set(t) for t in simhash.covering_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain_fingerprint(d.text) for d in docs]
    want = {d.doc_id: (f"{p:016x}", c) for d, p, c in zip(docs, prints, plain_components([d.doc_id for d in docs], prints))}
    assert want == {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9(spark, SF).collect()}


def test_dense_groups_by_pairs_and_by_midpoints(spark):
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = []
    for i in range(150):
        p = centres[i % 3]
        for _ in range(rng.randint(0, 9)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    prints = list(dict.fromkeys(prints + [rng.getrandbits(64) for _ in range(50)]))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = plain_components(signed, prints)
    for bound in (1024, 2):
        found = {r["id"]: r["component"] for r in
                 simhash.connected_components(simhash.links(frame, max_list=bound)).collect()}
        assert [found.get(s, s) for s in signed] == want, bound


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], plain_components([r.doc_id for r in rows], prints)), key=str)
    got = simhash.near_duplicates(odd_docs)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [-8, 1, 5, 6, 7, None]


def test_majority_bits_of_long_and_empty_runs():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 255, 256, 1000, 0, 2])
    hashes = rng.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    got = simhash.majority_bits(hashes, sizes)
    at = 0
    for n, g in zip(sizes, got):
        part = [int(h) for h in hashes[at:at + n]]
        at += n
        assert int(g) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in part) > n)


def test_an_id_of_several_texts_keeps_each_that_is_first(spark):
    rows = [(1, "one two three four five", "a"), (1, "six seven eight nine ten", "b"), (2, "red green blue black white", "c"),
            (3, "six seven eight nine ten", "d"), (1, "one two three four five", "e"), (None, "one two three four five", "f"),
            (4, None, "g"), (5, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.keep_first(docs.repartition(3))
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == [(0, rows[0][1]), (1, rows[0][1]), (1, rows[1][1]), (2, rows[2][1]), (4, None)]
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, simhash.keep_first(docs).collect()))
