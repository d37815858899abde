"""kNN against brute force; planted density clusters; silhouette basics."""
import numpy as np
from pyspark.sql import functions as F

from utterscope.operators import clustering as cl
from utterscope.operators import geometry as ge
from utterscope.operators import neighbors as nb


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(6, 16)) * 4
    x = np.vstack([c + rng.normal(size=(40, 16)) for c in centers])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = nb.knn_join(df, "id", "v", k=5, block_rows=32).select("id", "nb_id", "rank").collect()
    xn = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = xn @ xn.T
    for r in got:
        order = sorted(range(len(x)), key=lambda j: (-cos[r["id"], j], j))
        assert order[r["rank"] - 1] == r["nb_id"]
    assert len(got) == len(x) * 5


def test_planted_density_clusters(spark):
    """Blobs of 60, 40, 30 (clusters), 10 (below min size) on the unit
    sphere plus 12 scattered points (noise)."""
    rng = np.random.default_rng(1)
    pts = []
    for n, axis in [(60, 0), (40, 1), (30, 2), (10, 3)]:
        c = np.eye(8)[axis]
        b = c + rng.normal(scale=0.03, size=(n, 8))
        pts += list(b / np.linalg.norm(b, axis=1, keepdims=True))
    far = rng.normal(size=(12, 8))
    far[:, :4] = 0.0
    pts += list(far / np.linalg.norm(far, axis=1, keepdims=True))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>")
    out = {r["id"]: r["topic_id"] for r in cl.density_cluster(df, "id", "v", 30, 3).collect()}
    sizes = {}
    for t in out.values():
        sizes[t] = sizes.get(t, 0) + 1
    assert sorted(v for k, v in sizes.items() if k != -1) == [30, 40, 60]
    assert all(out[i] == -1 for i in range(130, 152))  # small blob and scattered points
    assert out[0] == 0 and out[60] == 1 and out[100] == 2  # ids by size desc


def test_silhouette_single_cluster_is_zero(spark):
    df = spark.createDataFrame([(i, 0, [float(i), 0.0]) for i in range(5)], "id long, t int, v array<double>")
    assert ge.silhouette(df, "id", "t", "v").first()[0] == 0.0


def test_sorted_passes_find_most_neighbours_and_rank_as_the_exact_join(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(150, 16))
    rows = [(i, [float(x) for x in centres[i % 150] + 0.1 * rng.normal(size=16)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = {}
    for r in nb.knn_join_sorted(df, "id", "v", k=10, block_rows=256, overlap=64).collect():
        found.setdefault(r["id"], {})[r["rank"]] = (r["nb_id"], r["cos"])
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = u @ u.T
    hit = [len({n for n, _ in f.values()} & set(np.argsort(-cos[i])[:10])) / 10 for i, f in found.items()]
    assert len(found) == 3000 and np.mean(hit) >= 0.9
    assert all(f[1][0] == i and len(f) == 10 for i, f in found.items())
    small = df.where("id < 200")
    assert sorted(map(tuple, nb.knn_join_sorted(small, "id", "v", k=5).select("id", "nb_id", "rank").collect())) == \
        sorted(map(tuple, nb.knn_join(small, "id", "v", k=5).select("id", "nb_id", "rank").collect()))


def test_knn_join_over_blocks_and_cells_with_repeated_and_null_keys(spark):
    from utterscope.operators import blocks
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(6, 8))[rng.integers(0, 6, 400)] + 0.3 * rng.normal(size=(400, 8)), 2)
    v[50:90] = v[50]  # copies
    rows = [(int(i), [float(x) for x in v[i]], int(i % 3)) for i in range(400)]
    df = spark.createDataFrame([*rows, (7, rows[9][1], 5), (None, rows[11][1], 6), (401, None, 1)], "id long, v array<double>, label int")
    got = nb.knn_join(df, "id", "v", k=5, block_rows=16, extra=["label"]).collect()
    ids = np.array([*range(400), 7])
    w = np.vstack([v, v[9]])
    u = w / np.linalg.norm(w, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 12)
    listed = {}
    for r in got:
        listed.setdefault(r["id"], []).append((r["rank"], r["nb_id"], round(r["cos"], 9)))
    assert set(listed) == {*range(400), None}
    for q in range(400):
        found = []
        for a in np.flatnonzero(ids == q):
            found += [(b != q, -c, b) for b, c in zip(ids.tolist(), cos[a].tolist())] + [
                (True, -cos[a, 11], 1 << 62)]  # the row without a key comes last among equals
        want = [(n, None if b == 1 << 62 else b, round(-c, 9)) for n, (_, c, b) in enumerate(sorted(found)[:5], 1)]
        assert sorted(listed[q]) == want, q
    assert {(r["label"], r["id"] % 3) for r in got if r["id"] not in (None, 7)} == {(0, 0), (1, 1), (2, 2)}
    # what is sent grows with the rows, not with their square
    many = spark.range(200_000).select(F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert blocks.n_blocks(many, "v", 256) == blocks.n_blocks(many.limit(20_000), "v", 256) == blocks.BLOCKS


def test_sorted_passes_completed_are_exact(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=32)]) for i in range(1500)], "id long, v array<double>")
    columns = ["id", "nb_id", "rank", F.round("cos", 6).alias("cos")]
    exact = nb.knn_join(df, "id", "v", k=10, block_rows=128).select(*columns)
    got = nb.knn_join_sorted(df, "id", "v", k=10, passes=2, block_rows=64, overlap=8, exact=True).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.collect()))


def test_silhouette_over_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v, t = rng.normal(size=(300, 4)) + np.repeat(np.arange(3), 100)[:, None], np.repeat([0, 1, 2], 100)
    t[::50] = -1
    df = spark.createDataFrame([(i, int(t[i]), [float(x) for x in v[i]]) for i in range(300)], "id long, topic int, v array<double>")
    keep = t != -1
    d = np.linalg.norm(v[keep][:, None] - v[keep][None], axis=2)
    own, s = t[keep], []
    for i in range(len(own)):
        mean = {c: d[i, own == c].sum() / ((own == c).sum() - (own[i] == c)) for c in (0, 1, 2)}
        a, b = mean[own[i]], min(m for c, m in mean.items() if c != own[i])
        s.append((b - a) / max(a, b))
    assert abs(ge.silhouette(df, "id", "topic", "v", block_rows=16).first()[0] - np.mean(s)) < 1e-9
