"""Fallback paths beyond size bounds, and settings validation."""
import pytest
from pyspark.sql import functions as F

from utterscope.config import DiscoverySettings, InferenceSettings, SettingsError
from utterscope.operators import scoring as sc
from utterscope.plans import tables as tb
from utterscope.session import sized_broadcast

SF = "/root/testdata/sf0.001"


def test_blocked_class_scoring_equals_inline(spark):
    emb = tb.vectors(spark, SF)
    classes = sc.class_table(sc.group_centroids(emb, "label", "v"), "label", tb.intent_name("label"))
    inline = sc.classify(sc.centroid_logits(emb, classes, "v", "vec_id"), 1.2, 0.65)
    blocked = sc.classify(sc.centroid_logits(emb, classes, "v", "vec_id", max_inline_classes=3), 1.2, 0.65)
    a = inline.select("vec_id", "tool_label", F.round("confidence", 9).alias("c"))
    b = blocked.select("vec_id", "tool_label", F.round("confidence", 9).alias("c"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sized_broadcast_bound(spark):
    small = spark.range(5)
    big = spark.range(50)
    assert "broadcast" in str(sized_broadcast(small, 10)._jdf.queryExecution().logical()).lower()
    assert "broadcast" not in str(sized_broadcast(big, 10)._jdf.queryExecution().logical()).lower()


def test_settings_validation():
    assert InferenceSettings.from_dict({"TEMPERATURE": 1.2, "unknown": 1}).temperature == 1.2
    d = DiscoverySettings.from_dict({"N_GRAM_RANGE": [1, 2]})
    assert d.n_gram_range == (1, 2)
    with pytest.raises(SettingsError) as e:
        InferenceSettings.from_dict({"TEMPERATURE": 0, "CONFIDENCE_THRESHOLD": 2})
    assert "temperature" in str(e.value) and "confidence_threshold" in str(e.value)


def test_settings_are_written_and_overridden(tmp_path):
    from utterscope.config import TrainingSettings
    settings = TrainingSettings(seed=7, reg_params=(0.5, 0.1))
    path = str(tmp_path / "new" / "settings.json")
    settings.to_json(path)
    assert TrainingSettings.from_json(path) == settings
    assert settings.override(k_folds=3) == TrainingSettings(seed=7, reg_params=(0.5, 0.1), k_folds=3)
    for wrong in ({"k_folds": 1}, {"no_such": 1}):
        with pytest.raises(SettingsError):
            settings.override(**wrong)


PLAN_CHECKED = ["summary_distribution", "predict_report", "classification_report", "confusion_matrix",
                "topic_coherence", "davies_bouldin", "knn_join", "contrastive_pairs", "stratified_split",
                "topic_keywords", "evaluation_sweep", "confidence_histogram"]


def test_no_cross_joins_in_headline_plans(spark):
    import __spark_entry__ as entry
    qs = entry.queries()
    for name in PLAN_CHECKED:
        plan = qs[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_flagship_scan_is_pruned(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["predict_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in plan or \
        "struct<vec_id:bigint,embedding:array<float>,label:int>" in plan


def test_topics_of_documents_without_a_broadcast(spark, tmp_path):
    """Tables too large to broadcast are shuffled by the document's vector."""
    rows = [(i, float(i % 7), i % 10) for i in range(20)]
    spark.createDataFrame([(i, [x, 1.0], lab) for i, x, lab in rows], "vec_id long, embedding array<float>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i, f"testo numero {i} gratta") for i in range(50)] + [(None, "senza id")], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {r["doc_id"]: (r["topic_id"], list(r["v"])) for r in tb.topic_rows(spark, str(tmp_path)).collect()}
        plan = tb.topic_of_documents(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: (-1 if i % 20 % 10 == 9 else i % 20 % 10, [float(i % 20 % 7), 1.0]) for i in range(50)}
    shuffles = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert shuffles and not any("pmod" in line for line in shuffles), plan  # no shuffle by a subquery's value
