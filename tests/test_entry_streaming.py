"""Driver contract and the streaming path."""
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from utterscope.operators import scoring as sc
from utterscope.plans import tables as tb
from utterscope.streaming import scoring as ss

SF = "/root/testdata/sf0.001"


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"summary", "n", "pct"}
    assert df.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    qs, sq = entry.queries(), entry.oracle_sql()
    assert set(sq) <= set(qs) and len(qs) >= 100


def test_stream_equals_batch(spark):
    emb = tb.vectors(spark, SF)
    classes = sc.class_table(sc.group_centroids(emb, "label", "v"), "label", tb.intent_name("label"))
    st = ss.read_embeddings_stream(spark, SF)
    out = ss.score_stream(st, ss.freeze_classes(classes), "embedding", 1.2, 0.65) \
        .select("vec_id", "tool_label", "status", F.round("confidence", 6).alias("c"))
    d = tempfile.mkdtemp(prefix="utterscope-stream-")
    ss.run_available_now(out, d + "/out", d + "/ck")
    got = spark.read.parquet(d + "/out")
    exp = tb.classified(spark, SF).select("vec_id", "tool_label", "status", F.round("confidence", 6).alias("c"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
