"""Decision grid, confidence edges, softmax properties."""
import itertools
import math

from pyspark.sql import functions as F

from utterscope.functions import vectors as vx
from utterscope.operators import metrics as mt
from utterscope.operators import scoring as sc


def py_decide(label, conf, thr):
    if label == "NOMATCH":
        return "NOMATCH", "NO_MATCH"
    if conf < thr:
        return "UNLISTED", "UNLISTED"
    return label, "VALID"


def py_summary(status, bot, tool):
    bot = (bot or "").strip()
    if status != "VALID":
        return status
    if not bot:
        return "MATCH"
    return "MATCH_BOT" if bot == tool else "MISMATCH"


def test_decision_grid(spark):
    grid = list(itertools.product(["A", "NOMATCH"], [0.64, 0.65, 0.66, 1.0], [None, "", " A ", "A", "B"]))
    df = spark.createDataFrame(grid, "label string, conf double, bot string")
    d = df.withColumn("_d", sc.decide_status(F.col("label"), F.col("conf"), 0.65)) \
          .select("label", "conf", "bot", "_d.tool_label", "_d.status")
    d = d.withColumn("summary", sc.summary_status("status", "bot", "tool_label"))
    for r in d.collect():
        tool, status = py_decide(r["label"], r["conf"], 0.65)
        assert (r["tool_label"], r["status"]) == (tool, status)
        assert r["summary"] == py_summary(status, r["bot"], tool)


def test_confidence_edges(spark):
    edges = [0.4999, 0.50, 0.70, 0.80, 0.90, 0.9001, 0.9999]
    df = spark.createDataFrame([(e,) for e in edges], "confidence double")
    bands = {r["band"]: r["n"] for r in mt.confidence_bands(df).collect()}
    assert bands == {"Very High (>0.90)": 2, "High (0.80-0.90)": 2, "Medium (0.70-0.80)": 1,
                     "Low (0.50-0.70)": 1, "Very Low (<0.50)": 1}
    tiers = [r[0] for r in df.select(sc.certainty_tier("confidence")).collect()]
    assert tiers == ["Low (Check Manually)"] * 2 + ["Medium", "Medium", "High", "High", "High"]


def test_softmax_properties(spark):
    logits = [[1.0, 2.0, 3.0, 0.5], [2.0, 2.0, 1.0, 0.0], [10.0, -5.0, 0.0, 0.0]]
    df = spark.createDataFrame([(l,) for l in logits], "logits array<double>")
    for t in (0.5, 1.0, 2.0):
        rows = df.select(vx.softmax("logits", t).alias("p"), vx.argmax(vx.softmax("logits", t)).alias("a"),
                         vx.argmax("logits").alias("a0")).collect()
        for r in rows:
            assert math.isclose(sum(r["p"]), 1.0, rel_tol=1e-12)
            assert r["a"] == r["a0"]
    # ties: first index, like NumPy
    assert df.select(vx.argmax("logits")).collect()[1][0] == 0
    top = df.select(sc.top_k_labels(vx.softmax("logits", 1.0), F.array(*[F.lit(c) for c in "abcd"]), 2)).collect()
    assert [e["label"] for e in top[1][0]] == ["a", "b"]
