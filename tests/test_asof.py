import random

from lodeframe.operators.asof import asof_join


def test_against_all_pairs(spark):
    rng = random.Random(3)
    left = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(40)])) for i in range(200)]
    right = list({(k, t): (k, t, f"{k}{t}") for k, t in ((rng.choice(["a", "b", None]), rng.randrange(-5, 50)) for _ in range(60))}.values())
    want = {}
    for i, k, t in left:
        near = [r for r in right if k is not None and t is not None and r[0] == k and r[1] <= t]
        want[i] = max(near, key=lambda r: r[1])[2] if near else None
    a, b = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v string")
    for pieces in (1, 7, 1024):
        got = asof_join(a, b, ["k"], "t", ["v"], pieces)
        assert got.columns == ["id", "k", "t", "v"] and {r.id: r.v for r in got.collect()} == want
    assert asof_join(a, b.limit(0), ["k"], "t", ["v"]).where("v IS NOT NULL").isEmpty()
    assert asof_join(a.limit(0), b, ["k"], "t", ["v"]).isEmpty()


def test_keys_beyond_doubles_and_one_row_a_key(spark):
    big = 2**53
    a = spark.createDataFrame([(1, "x", big + 1), (2, "x", big + 2), (3, "y", big)], "id int, k string, t long")
    b = spark.createDataFrame([("x", big, "zero"), ("x", big + 2, "two"), ("y", big + 1, "late")], "k string, t long, v string")
    assert {r.id: r.v for r in asof_join(a, b, ["k"], "t", ["v"]).collect()} == {1: "zero", 2: "two", 3: None}
    n = 2000
    left = spark.range(n).selectExpr("id", "id AS k", "id * 10 + 5 AS t")
    right = spark.range(n).selectExpr("id AS k", "id * 10 AS t", "id AS v")
    out = asof_join(left, right, ["k"], "t", ["v"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and out.where("v = k").count() == n
