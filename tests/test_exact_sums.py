from decimal import Decimal
from fractions import Fraction
from random import Random

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import exact


def test_sums_of_limbs_are_exact_and_combined_before_the_shuffle(spark):
    r = Random(5)
    texts = ["0", "-0.0", "+7", ".5", "5.", " 1e60 ", "-1E-60", "0." + "0" * 59 + "1"]
    for _ in range(600):
        whole, part = "".join(r.choices("0123456789", k=r.randint(1, 60))), "".join(r.choices("0123456789", k=r.randint(0, 59)))
        texts.append(r.choice(["", "-", "+"]) + whole + ("." + part if part else ""))
    rows = [(i % 7, t) for i, t in enumerate(texts)] + [(20, "9" * 120), (20, "-" + "9" * 120), (21, "-" + "9" * 119)] + [(8, None), (9, None), (9, "1.25")]
    df = spark.createDataFrame(rows, "g long, v string").repartition(5).withColumn("l", exact.limbs(F.col("v"))).groupBy("g").agg(exact.summed(F.col("l")).alias("s"))
    want = {}
    for g, t in rows:
        want.setdefault(g, []).append(t)
    for g, s in df.collect():
        given = [Fraction(Decimal(t.strip())) for t in want[g] if t is not None]
        assert (None if s is None else Fraction(Decimal(s))) == (sum(given, Fraction(0)) if given else None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "AggregateInPandas" not in plan


@pytest.mark.parametrize(("text", "code"), [("x", "invalid_number"), ("", "invalid_number"), ("1e121", "numeric_precision_limit"), ("1" * 121, "numeric_precision_limit")])
def test_what_is_no_number_fails(spark, text, code):
    df = spark.createDataFrame([(text,)], "v string").select(exact.limbs(F.col("v")).alias("l")).agg(exact.summed(F.col("l")).alias("s"))
    with pytest.raises(Exception, match=code):
        df.collect()
