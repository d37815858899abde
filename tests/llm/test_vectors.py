"""Vector search and vector near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterscope.llm import approx_neighbors, queries, vector_dups

SF = "/root/testdata/sf0.01"
BAD = [(9001, None), (9002, [0.0] * 8), (9003, [1.0, None] * 4), (9004, [float("nan")] * 8), (9005, [float("inf")] * 8),
       (None, [1.0] * 8), (9006, [1.0, 2.0]), (9007, [])]


@pytest.fixture
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8) * rng.choice([0.02, 0.3])]) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(30)] + [(7, rows[7][1])]
    return rows, spark.createDataFrame(rows + BAD, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))


def plain_links(rows, threshold=0.9):
    x = np.array([v for _, v in rows])
    norm = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
    np.fill_diagonal(near, False)
    return near


def components(ids, near):
    label = np.array(ids)
    while True:
        new = np.array([min(label[row].min(initial=lab), lab) for row, lab in zip(near, label)])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_brute_force(clustered, monkeypatch, block):
    monkeypatch.setattr(vector_dups, "BLOCK", block)
    rows, frame = clustered
    near = plain_links(rows)
    want = {i: (int(n.sum()), int(c)) for (i, _), n, c in zip(rows, near, components([i for i, _ in rows], near))}
    got = vector_dups.near_duplicates(frame).collect()
    assert len(got) == len(rows) + len(BAD)
    for r in got:
        if r.vec_id in want:
            assert (r.n_links, r.component_id, r.kept) == (*want[r.vec_id], r.vec_id == want[r.vec_id][1])
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert vector_dups.near_duplicates(frame.limit(0)).count() == 0


def test_passes_follow_the_size():
    needed = [vector_dups.passes_needed(n, 0.9, 32, 0.99) for n in (0, 10, 10**4, 10**6, 10**8)]
    assert needed == sorted(needed) and needed[0] == 4 and needed[-1] < 200


def plain_nearest(rows, k=10):
    out = {}
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    for i, v in rows:
        if i % 100 == 0:
            apart = np.sqrt(np.square(x - np.array(v)).sum(1))
            order = [j for j in np.lexsort((ids, apart)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), apart[j]) for j in order]
    return out


def test_nearest_of_few_rows_are_exact(clustered):
    rows, frame = clustered
    want = plain_nearest(dict(rows).items() and list(dict(rows).items()))
    got = {}
    for r in approx_neighbors.nearest(frame, F.pmod("vec_id", F.lit(100)) == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=0, rtol=1e-14) for q in want)
    assert approx_neighbors.nearest(frame.limit(0), F.lit(True)).count() == 0


def test_forest_ascends_to_enough_candidates():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(2000, 16))
    forest = approx_neighbors.HashForest(rows, 40, 3)
    found = forest.candidates(rows[:20], 1500)
    assert all(i in set(c) and len(c) >= 20 for i, c in zip(range(20), found))
    recall = []
    for q, c in zip(rows[:20], found):
        best = np.argsort(np.square(rows - q).sum(1))[:10]
        recall.append(len(set(best) & set(c)) / 10)
    assert np.mean(recall) >= 0.85
    assert all(len(c) == 2000 for c in forest.candidates(rows[:3], 10**9))


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    frame = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = plain_nearest([(r.vec_id, r.embedding) for r in frame])
    got = {}
    for r in queries.op8(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in v}) / 10 for q, v in want.items()]) >= 0.9


def test_shards_and_blocks_are_merged(clustered, monkeypatch):
    rows, frame = clustered
    whole = approx_neighbors.nearest(frame, F.pmod("vec_id", F.lit(100)) == 0).collect()
    monkeypatch.setattr(approx_neighbors, "SHARD_ROWS", 60)
    monkeypatch.setattr(approx_neighbors, "QUERY_ROWS", 5)
    assert sorted(approx_neighbors.nearest(frame, F.pmod("vec_id", F.lit(100)) == 0).collect()) == sorted(whole)


def test_query_links_equal_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    near = plain_links([tuple(r) for r in frame])
    want = {r.vec_id: int(n.sum()) for r, n in zip(frame, near)}
    assert want == {r.vec_id: r.n_links for r in queries.op10(spark, "/root/testdata/sf0.1").collect()}


def test_recall_in_a_hot_cone(spark, monkeypatch):
    monkeypatch.setattr(vector_dups, "LEAF", 256)
    rng = np.random.default_rng(21)
    axis = np.eye(64)[0]

    def aside(n, *to):
        u = rng.normal(size=(n, 64))
        u[:, 0] = 0
        for t in to:
            u -= (u * t).sum(1)[:, None] * t
        return u / np.sqrt((u * u).sum(1))[:, None]

    u = aside(3000)  # a cone of mutual cosine 0.8
    w = 0.525 * u[:300] + np.sqrt(1 - 0.525 ** 2) * aside(300, u[:300])  # partners at cosine 0.905
    cone = np.sqrt(0.8) * axis + np.sqrt(0.2) * np.concatenate([u, w])
    x = np.concatenate([cone, rng.normal(size=(3000, 64))])
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = plain_links([(i, v) for i, v in enumerate(x)])
    got = {r.vec_id: r.n_links for r in vector_dups.near_duplicates(frame).collect()}
    assert near[np.arange(300), np.arange(3000, 3300)].all()
    assert sum(got.values()) >= 0.97 * near.sum()
