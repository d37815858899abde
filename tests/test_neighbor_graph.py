"""The approximate neighbour graph against brute force."""

import numpy as np
import pytest

from utterscope.operators import neighbors as nb


def clustered(n, dim, clusters, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return centres[np.arange(n) % clusters] + 0.3 * rng.normal(size=(n, dim))


def even(n, dim, seed):
    return np.random.default_rng(seed).normal(size=(n, dim))


def frame(spark, points, parts=8):
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(parts)


def recall(found, points, k):
    u = points / np.linalg.norm(points, axis=1, keepdims=True)
    hits = total = 0
    for lo in range(0, len(u), 2000):
        best = np.argpartition(-(u[lo:lo + 2000] @ u.T), k, axis=1)[:, :k]
        for i, row in enumerate(best, lo):
            hits += len(set(row.tolist()) & found[i])
            total += k
    return hits / total


def lists(rows):
    out = {}
    for r in rows:
        out.setdefault(r["id"], set()).add(r["nb_id"])
    return out


@pytest.mark.parametrize("kind", ["clustered", "even"])
def test_recall_on_twenty_thousand_rows(spark, kind):
    points = clustered(20_000, 16, 40, 1) if kind == "clustered" else even(20_000, 8, 2)
    found = lists(nb.neighbor_graph(frame(spark, points), "id", "v", k=15).select("id", "nb_id").collect())
    assert len(found) == 20_000 and all(len(f) == 15 and i in f for i, f in found.items())
    assert recall(found, points, 15) >= 0.95


def test_same_result_at_any_partitioning(spark):
    points = clustered(900, 12, 20, 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = []
    try:
        for parts in (8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            df = frame(spark, points, parts)
            got.append([sorted(map(tuple, f(df, "id", "v", k=8, block_rows=150, **more).collect()))
                        for f, more in ((nb.neighbor_graph, {}), (nb.knn_join_sorted, {"overlap": 40, "passes": 8}))])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[0] == got[1]
    for rows in got[0]:
        assert recall({i: {r[1] for r in rows if r[0] == i} for i in range(900)}, points, 8) >= 0.95


def test_lists_are_ranked_as_the_exact_join_ranks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(0, 3, 4).astype(float).tolist(), f"l{i % 3}") for i in range(60)]  # ties and zero vectors
    rows += [(100, None, "x"), (None, [1.0, 0.0, 0.0, 0.0], "y")]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    got = nb.neighbor_graph(df, "id", "v", k=6, extra=["label"])
    want = nb.knn_join(df.filter("id IS NOT NULL AND v IS NOT NULL"), "id", "v", k=6, extra=["label"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    got = sorted(map(tuple, nb.neighbor_graph(df, "id", "v", k=5).collect()))
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 0.0), (2, 1, 2, 0.0), (2, 2, 1, 0.0)]
    assert nb.neighbor_graph(df.limit(0), "id", "v").collect() == []
    assert nb.neighbor_graph(df, "id", "v", k=1).count() == 2


def test_a_hub_meets_a_bounded_number(spark):
    from utterscope.operators.neighbor_graph import _meetings
    graph = spark.createDataFrame([(i, 0, 0.5, i % 2 == 0) for i in range(1, 400)], "id long, nb long, cos double, fresh boolean")
    met = _meetings(graph, 10, 1).groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in met}[0] == 20


def test_triplets_from_listed_neighbours(spark):
    from pyspark.sql import functions as F

    from utterscope.operators import pairs as pr
    df = frame(spark, clustered(120, 6, 5, 8)).withColumn("label", F.pmod("id", F.lit(4)).cast("int"))
    lists = nb.neighbor_graph(df, "id", "v", k=20, extra=["label"])
    got = pr.hard_negative_triplets(df, "label", "id", "v", neighbours=lists)
    want = pr.hard_negative_triplets(df, "label", "id", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
