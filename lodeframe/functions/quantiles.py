"""Exact quantiles of any number of rows: no task and no buffer holds the values of a group.

Equal values are counted first. The distinct ones are dealt by sorted ranges, and how
many rows each range of a group has, a row a range, says at which place it begins; a value then knows the
places it takes, and only those that a quantile asks for are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.scratch import scratch


def quantiles(df: DataFrame, values: dict[str, Column], probabilities: list[float], groups: list[str] | None = None) -> DataFrame:
    """(groups, name, n, p, quantile): interpolated linearly between the two nearest values, for each named column.

    Nulls aren't counted and NaN is the largest value; a group whose values are all null, and no rows, have no quantile.
    Null groups are a group of their own.
    """
    by = [*(groups or []), "name"]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in values.items())))
    counted = df.select(*(groups or []), each.alias("v")).select(*(groups or []), "v.name", "v.value").where("value IS NOT NULL").groupBy(*by, "value").agg(F.count("*").alias("c"))
    path = scratch(df.sparkSession, "quantiles")
    counted.repartitionByRange(*by, "value").withColumn("range", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    before = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy(*by, "range").agg(F.sum("c").alias("c"))
    whole = F.sum("c").over(Window.partitionBy(*by)).alias("n")
    begins = ranges.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("range").alias("__range"), before(Window.partitionBy(*by).orderBy("range")).alias("begin"), whole)
    own = dealt.withColumn("inner", before(Window.partitionBy(*by, "range").orderBy("value")))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("range") == F.col("__range")]
    place = own.join(begins, same).select(*by, "value", "n", (F.col("begin") + F.col("inner")).alias("from"), (F.col("begin") + F.col("inner") + F.col("c")).alias("until"))
    asked = place.withColumn("p", F.explode(F.array(*map(F.lit, probabilities)))).withColumn("at", F.col("p") * (F.col("n") - 1))
    low, high = F.floor("at"), F.ceil("at")
    holds = lambda x: (x >= F.col("from")) & (x < F.col("until"))
    found = asked.where(holds(low) | holds(high)).groupBy(*by, "n", "p").agg(F.max(F.when(holds(low), F.col("value"))).alias("a"), F.max(F.when(holds(high), F.col("value"))).alias("b"), F.max("at").alias("at"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    return found.select(*by, "n", "p", between.alias("quantile"))
