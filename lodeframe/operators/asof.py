"""As-of joins: each row with the latest earlier row of another table, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Time is cut into so many pieces; a key's rows are spread over them.
PIECES = 1024


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], pieces: int = PIECES) -> DataFrame:
    """left's rows with ``values`` of the right row of the same keys that has the largest ``on`` not after theirs, or nulls.

    A (keys, on) should be once on the right; of several, the largest values count. Null keys
    and times meet nothing. Times are compared in their own type; a double of them only says which piece of time
    a row is in. A key's rows are sorted piece by piece, so that a hot key is spread; what a piece inherits is carried over
    a table of the pieces that hold a row of either side, which is never longer than both sides together.
    """
    at, kind = F.col(f"`{on}`"), dict(left.dtypes)[on]
    scale = at.cast("double") if kind not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(at.cast("timestamp")).cast("double")
    none = F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)
    side = lambda df, row, got, n: df.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), at.alias("__at"), scale.alias("__scale"), F.lit(n).alias("__side"), row.alias("__row"), got.alias("__got"))
    no_row = F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType)
    # The right side comes first among equal times, so a row also meets one of its own time.
    both = side(left, F.struct(*left.columns), none, 1).unionByName(side(right, no_row, F.struct(*values), 0))
    lo, hi = left.agg(F.min(scale), F.max(scale)).first()
    width = max((hi or 0) - (lo or 0), 1.0) / pieces
    k = [f"__k{i}" for i in range(len(keys))]
    both = both.withColumn("__piece", F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(float(pieces)), (F.col("__scale") - F.lit(float(lo or 0))) / width))).cast("int"))
    within = Window.partitionBy(*k, "__piece").orderBy("__at", "__side", "__got")
    found = both.withColumn("__own", F.last("__got", True).over(within)).where("__side = 1")
    ends = both.groupBy(*k, "__piece").agg(F.max_by("__got", F.when(F.col("__side") == 0, F.struct("__at", "__got"))).alias("__last"))
    earlier = Window.partitionBy(*k).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*k, "__piece", F.last("__last", True).over(earlier).alias("__before"))
    out = found.join(carried, [*k, "__piece"], "left").withColumn("__got", F.coalesce("__own", "__before"))
    usable = F.lit(True)
    for c in [*k, "__at"]:
        usable &= F.col(c).isNotNull()
    return out.select("__row.*", *(F.when(usable, F.col("__got")[v]).alias(v) for v in values))
