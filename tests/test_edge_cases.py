"""Inputs that gave wrong numbers or stopped a job once: ties, zero vectors,
long chains, wide value ranges, null groups, empty tables, repeated calls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterscope.operators import calibration as ca
from utterscope.operators import geometry as ge
from utterscope.operators import metrics as mt
from utterscope.operators import pairs as pa
from utterscope.operators import scoring as sc
from utterscope.operators import splits as sp
from utterscope.operators import topics as tp
from utterscope.operators.clustering import vertex_components
from utterscope.operators.components import connected_components
from utterscope.operators.neighbors import knn_join
from utterscope.session import clear_scratch, scratch_table_path, written_table


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(900, 901), (5, 5), (None, 3)], "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert {got[i] for i in range(401)} == {0} and got[901] == 900 and len(got) == 403
    vertices = spark.createDataFrame([(1,), (777,)], "v long")
    assert {tuple(r) for r in vertex_components(vertices, edges, "v").collect()} == {(1, 0), (777, 777)}
    assert connected_components(edges.limit(0)).count() == 0


def test_components_match_union_find_on_random_graphs(spark):
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 300, (220, 2))
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")
    assert all(find(r["id"]) == r["component"] for r in connected_components(edges).collect())


@pytest.mark.parametrize("values", [
    [2.0 ** -k for k in range(1001)],
    [0.0, -1e300, 1e300, 5e-324, -5e-324],
    [3.0], [1.0, 1.0, 2.0, 2.0], [5e-324, 1e-323, 1.5e-323],
])
def test_exact_median_of_any_range(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert mt.exact_median(df, "x").first()["median"] == float(np.median(values))


def test_blocked_classes_keep_class_order(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 12, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    classes = sc.class_table(sc.group_centroids(df, "label", "v"), "label")
    got = [{r["id"]: (r["class_names"], [round(x, 12) for x in r["logits"]]) for r in
            sc.centroid_logits(df, classes, "v", "id", max_inline_classes=bound).collect()} for bound in (20000, 3)]
    assert got[0] == got[1]
    nll = [ca.nll_at_temperature(sc.centroid_logits(df, classes, "v", "id", max_inline_classes=bound), [1.0])
           .first()["nll"] for bound in (20000, 3)]
    assert nll[0] == pytest.approx(nll[1])


def test_null_groups_are_groups(spark):
    rows = [(i, ["a", "b", None][i % 3]) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, label string")
    assert sp.stratified_split(df, "label", "id", 0.25).count() == 12
    assert pa.contrastive_pairs(df, "label", "id").select("anchor_id").distinct().count() == 12


def test_equal_vectors_rank_by_id_after_the_row_itself(spark):
    vectors = [[1.0, 0.2, 0.1], [0.3, 1.0, 0.7]]
    df = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, vectors[0])))
                                  .otherwise(F.array(*map(F.lit, vectors[1]))).alias("v"))
    got = knn_join(df, "id", "v", k=5).where("id IN (0, 1000, 1001)").orderBy("id", "rank").collect()
    assert [r["nb_id"] for r in got] == [0, 2, 4, 6, 8, 1000, 0, 2, 4, 6, 1001, 1, 3, 5, 7]


def test_zero_vectors_and_coinciding_points(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, [1.0, 0.0]), (4, 1, [0.0, 0.0])],
                               "id long, topic long, v array<double>")
    assert {r["cos"] for r in knn_join(df, "id", "v", k=2).where("id = 1").collect()} == {0.0}
    assert ge.davies_bouldin(df, "topic", "v").first()[0] == 0.0
    same = df.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    assert ge.silhouette(same, "id", "topic", "v").first()[0] == 0.0
    classes = sc.class_table(sc.group_centroids(df, "topic", "v"), "topic")
    assert sc.centroid_logits(df, classes, "v", "id").where("id = 1").first()["logits"] == [0.0, 0.0]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "topic int")
    row = tp.discovery_overview(empty, "topic").first()
    assert (row["total"], row["outlier_pct"], row["coverage_pct"]) == (0, 0.0, 0.0)


def test_scratch_tables_are_never_shared(spark):
    assert scratch_table_path(spark, "x") != scratch_table_path(spark, "x")


def test_settings_from_yaml(tmp_path):
    from utterscope.config import InferenceSettings, SettingsError
    path = tmp_path / "inference.yaml"
    path.write_text("temperature: 1.7\nconfidence_threshold: 0.4\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(SettingsError):
            InferenceSettings.from_yaml(str(path))
    else:
        got = InferenceSettings.from_yaml(str(path))
        assert (got.temperature, got.confidence_threshold) == (1.7, 0.4)


def test_topic_info_with_representatives(spark):
    rows = [(1, 0, "stampante rotta", 0.9), (2, 0, "stampante lenta", 0.8), (3, 1, "rete lenta", 0.7), (4, -1, "altro", 0.0)]
    df = spark.createDataFrame(rows, "id long, topic int, text string, p double")
    reps = tp.representative_rows(df, "topic", "id", "p", "text", 2)
    got = {r["topic"]: r["representatives"] for r in tp.topic_info(df, "text", "topic", reps=reps).collect()}
    assert got[0] == ["stampante rotta", "stampante lenta"] and got[1] == ["rete lenta"]


def test_scratch_tables_can_be_cleared(spark):
    kept = written_table(spark.range(5), "numbers")
    assert kept.count() == 5
    path = kept.inputFiles()[0]
    clear_scratch(spark)
    from utterscope.sources.readers import path_exists
    assert not path_exists(spark, path)
    clear_scratch(spark)  # nothing left is no error
