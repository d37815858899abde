"""Split exactness, fold partition, pairs and the hard-negative fallback."""
import math
import random

from pyspark.sql import functions as F

from utterscope.operators import pairs as pr
from utterscope.operators import prep as pp
from utterscope.operators import splits as sp


def test_split_exact_and_disjoint(spark):
    rows = [(i, "a" if i % 10 < 7 else ("b" if i % 10 < 9 else "c")) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, l string")
    s = sp.stratified_split(df, "l", "id", 0.15, 42)
    assert s.where("is_test").count() == math.ceil(0.15 * 200)
    assert s.count() == 200 and s.select("id").distinct().count() == 200
    f = sp.stratified_folds(df, "l", "id", 5).groupBy("l", "fold").count().collect()
    by = {}
    for r in f:
        by.setdefault(r["l"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by.values())


def test_group_rank_dense(spark):
    rows = [(i, "hot" if i % 3 else "cold", random.Random(i).random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, x double").repartition(7)
    r = pp.group_rank(df, ["g"], ["x", "id"], "rk")
    for g, n in r.groupBy("g").agg(F.count("*"), F.min("rk"), F.max("rk"), F.countDistinct("rk")).collect() \
            and [(x[0], x) for x in r.groupBy("g").agg(F.count("*").alias("n"), F.min("rk").alias("lo"),
                                                        F.max("rk").alias("hi"),
                                                        F.countDistinct("rk").alias("d")).collect()]:
        assert n["lo"] == 1 and n["hi"] == n["n"] == n["d"]


def test_contrastive_pairs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "c")], "id long, l string")
    p = {(r["anchor_id"], r["positive_id"], r["offset"]) for r in pr.contrastive_pairs(df, "l", "id").collect()}
    assert p == {(1, 2, 1), (2, 3, 1), (3, 1, 1), (1, 3, 2), (2, 1, 2), (3, 2, 2), (4, 5, 1), (5, 4, 1)}


def test_hard_negative_fallback(spark):
    rnd = random.Random(3)
    base = [1.0] + [0.0] * 7
    rows = [(i, "same", [x + rnd.uniform(-1e-3, 1e-3) for x in base]) for i in range(25)]
    rows += [(100 + i, "other", [0.0] * 7 + [1.0 + i]) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, l string, v array<double>")
    t = pr.hard_negative_triplets(df, "l", "id", "v", k=20).collect()
    same = [r for r in t if r["l"] == "same"]
    assert len(same) == 25 and not any(r["is_hard"] for r in same)
    assert all(r["negative_id"] >= 100 for r in same)
    assert all(r["positive_id"] != r["anchor_id"] for r in t)
