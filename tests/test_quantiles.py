import random

import numpy as np
from pyspark.sql import functions as F

from lodeframe.functions.quantiles import quantiles
from lodeframe.operators import evaluate

PROBABILITIES = [0.0, 0.25, 0.5, 0.95, 1.0]


def test_against_sorting(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.5, 1.5, rng.gauss(0, 1e6), float(rng.randrange(9))]), rng.randrange(5)) for _ in range(900)] + [("one", 3.0, 1), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    got = {(r.g, r.name, r.p): (r.n, r.quantile) for r in quantiles(df.repartition(7), {"x": F.col("x"), "y": F.col("y")}, PROBABILITIES, ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for i, name in ((1, "x"), (2, "y")):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None]
            want |= {(g, name, p): (len(values), float(np.quantile(values, p))) for p in PROBABILITIES if values}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1], rtol=1e-12, atol=1e-9) for k in want)


def test_no_rows_and_no_group(spark):
    df = spark.createDataFrame([], "x double")
    assert quantiles(df, {"x": F.col("x")}, [0.5]).collect() == []
    out = quantiles(spark.range(1001).withColumn("x", F.col("id") % 10), {"x": F.col("x")}, [0.5])
    assert [tuple(r) for r in out.collect()] == [("x", 1001, 0.5, 4.0)]
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_summary_of_all(spark):
    df = spark.createDataFrame([("passed", 1.0, 5), ("failed", 3.0, None)], "status string, latency double, tokens int")
    assert [tuple(r) for r in evaluate.summary(df).collect()] == [(2, 1, 1, 0, 2.0, 2.9, 5, 1, 1)]


def test_review_of_equal_times_is_one_review(spark):
    reviews = spark.createDataFrame([(1, "good", "h1", 5), (1, "bad", "h2", 5)], "case int, label string, answer_sha256 string, at int")
    answers = spark.createDataFrame([(1, "text")], "case int, answer string")
    assert [r.verdict for r in evaluate.reviewed(answers, reviews, "case").collect()] == ["stale"]
