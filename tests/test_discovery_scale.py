"""Steps of discovery whose work grew faster than the rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from utterscope.operators import geometry as ge
from utterscope.operators import neighbor_graph as ng


def _own_by_membership(df):
    """{(id, topic, row number): p} from the probabilities of all topics."""
    m = ge.membership(df, "id", "t", "v").collect()
    return sorted((r.id, r.t, r.nr, 0.0 if r.t == -1 else r.probs[r.topic_ids.index(r.t)]) for r in m)


@pytest.mark.parametrize("tile_of_copies", [False, True])
def test_own_probability_is_that_of_all_topics(spark, tile_of_copies):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(90, 12))
    rows = [(i // 2, i % 91 - 1, i, [float(x) for x in centres[(i % 91 - 1) % 90] + (0 if tile_of_copies else 0.3) * rng.normal(size=12)])
            for i in range(900)]
    df = spark.createDataFrame(rows, "id long, t int, nr int, v array<double>")
    want = sorted(p for *_, p in _own_by_membership(df))
    got = sorted(r.p for r in ge.own_probability(df, "id", "t", "v").collect())
    assert got == pytest.approx(want, rel=1e-11, abs=1e-13)
    keys = df.select(F.col("nr").cast("long").alias("nr"), "t", "v")
    by_key = {r.nr: r.p for r in ge.own_probability(keys, "nr", "t", "v").collect()}
    assert [by_key[nr] for _, _, nr, _ in sorted(_own_by_membership(df))] == pytest.approx(
        [p for *_, p in sorted(_own_by_membership(df))], rel=1e-11, abs=1e-13)


def test_own_probability_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 1, [None, 1.0]), (4, 0, [1.0]), (5, 1, None),
                                (6, -1, None), (None, 0, [1.0, 0.0])], "id long, t int, v array<double>")
    got = {r.id: r.p for r in ge.own_probability(df, "id", "t", "v").collect()}
    near = 1 / (1 + np.exp(-np.sqrt(2)))
    assert got[1] == got[None] == pytest.approx(near) and got[2] == pytest.approx(near)
    assert got[3] is None and got[4] is None and got[5] is None and got[6] == 0


def test_own_probability_holds_no_list_of_all_topics_per_row(spark):
    df = spark.createDataFrame([(i, i % 5, [float(i), 1.0]) for i in range(50)], "id long, t int, v array<double>")
    plan = ge.own_probability(df, "id", "t", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan and "scalar-subquery" not in plan


def test_only_vertices_with_a_new_neighbour_gather_vectors(spark):
    """Where all neighbours are old nobody meets; others meet as before."""
    graph = spark.createDataFrame([(1, 2, 0.9, False), (2, 1, 0.9, False), (3, 4, 0.8, True), (4, 3, 0.8, False), (4, 5, 0.7, False),
                                   (5, 4, 0.7, False)], "id long, nb long, cos double, fresh boolean")
    met = {(r.v, r.u, r.fresh, r.ahead) for r in ng._meetings(graph, 10, 1).collect()}
    assert met == {(3, 4, True, True), (3, 4, False, False), (4, 3, True, False), (4, 3, False, True), (4, 5, False, True),
                   (4, 5, False, False)}


def test_pairs_that_meet_come_in_large_batches():
    import pyarrow as pa
    n, rng = 400, np.random.default_rng(0)
    v = np.repeat(np.arange(n), 6)
    x = rng.normal(size=(6 * n, 4))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(v), pa.array(np.arange(6 * n)), pa.array(np.ones(6 * n, dtype=bool)), pa.array(x.tolist()),
         pa.array(np.full(6 * n, -np.inf))], names=["v", "u", "fresh", "x", "worst"])
    out = list(ng._introduced(iter([batch.slice(0, 1000), batch.slice(1000)])))
    assert len(out) == 1 and out[0].num_rows == n * 6 * 5
