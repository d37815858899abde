"""Utterance streams give what the same operators give on tables."""

from pyspark.sql import functions as F

from utterscope.operators import geometry as ge
from utterscope.operators import scoring as sc
from utterscope.plans import tables as tb
from utterscope.streaming import scoring as ss
from utterscope.streaming import utterances as us

SF = "/root/testdata/sf0.001"


def run(spark, df, tmp_path, name):
    ss.run_available_now(df, str(tmp_path / name), str(tmp_path / f"{name}-state"))
    return spark.read.parquet(str(tmp_path / name))


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_cleaned_and_described_utterances(spark, tmp_path):
    rows = [(i, t, "A" if i % 2 else "C", f"2024-01-01 00:0{i}:00") for i, t in enumerate(
        ["Buongiorno, il pos non va", None, "ciao", "la tv è rotta di nuovo", "", "10 e lotto non funziona"])]
    batch = spark.createDataFrame(rows, "id long, Phrase string, topic string, at string").withColumn("at", F.to_timestamp("at"))
    intents = spark.createDataFrame([("A", "guasti"), ("B", "altro")], "intent string, description string")
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = us.cleaned_utterances(batch, "Phrase", intents, "topic")
    got = run(spark, us.cleaned_utterances(stream, "Phrase", intents, "topic"), tmp_path, "out")
    assert same(got.select(*want.columns), want)
    by = {r["id"]: r for r in got.collect()}
    assert by[5]["cleaned"] == "diecielotto non funziona" and by[5]["description"] == "guasti" and by[0]["description"] is None


def test_repeated_interactions_are_dropped(spark, tmp_path):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:10:00"), ("b", 3, "2024-01-01 00:20:00"),
            ("a", 4, "2024-01-01 00:30:00"), ("b", 5, "2024-01-01 00:40:00"), ("c", 6, "2024-01-01 00:50:00")]
    for k, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, "id string, n long, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, us.once_per_interaction(stream, "id", "at"), tmp_path, "out")
    assert sorted(r["id"] for r in got.collect()) == ["a", "b", "c"]
    assert sorted(r["id"] for r in us.once_per_interaction(table, "id", "at").collect()) == ["a", "b", "c"]


def test_topics_and_ensembles_on_a_stream(spark, tmp_path):
    fit = tb.topic_vectors(spark, SF)
    stream = ss.read_embeddings_stream(spark, SF).select("vec_id", F.col("embedding").alias("v"))
    got = run(spark, us.assign_topics_stream(stream, us.freeze_topics(fit, "topic_id", "v"), "v").select(
        "vec_id", "assigned_topic", F.round("distance", 9).alias("d")), tmp_path, "topics")
    want = ge.assign_topics(fit, fit.select("vec_id", "v"), "vec_id", "topic_id", "v").select(
        "vec_id", "assigned_topic", F.round("distance", 9).alias("d"))
    assert same(got, want)

    emb = tb.vectors(spark, SF)
    tables = [sc.class_table(sc.group_centroids(emb.filter(F.pmod("vec_id", F.lit(2)) == k), "label", "v"), "label",
                             tb.intent_name("label")) for k in (0, 1)]
    frozen = [ss.freeze_classes(t) for t in tables]
    decided = ["vec_id", "tool_label", "status", F.round("confidence", 9).alias("c")]
    stream = ss.read_embeddings_stream(spark, SF)
    got = run(spark, us.score_ensemble(stream, frozen, "embedding", 1.2, 0.65).select(*decided), tmp_path, "ensemble")
    assert same(got, us.score_ensemble(emb, frozen, "v", 1.2, 0.65).select(*decided)) and got.count() == emb.count()
