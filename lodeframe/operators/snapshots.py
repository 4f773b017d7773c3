"""Inputs of analyses: which datasets and earlier results they may read, in which units, and what those lack.

Requests, datasets, artifacts and their evidence are tables; all requests are judged in one plan, and what an artifact
lacks is carried along the lineage to everything made from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodeframe.errors import require
from lodeframe.frame import ORDER, Frame
from lodeframe.plans.analyze import Analysis, analyze
from lodeframe.scratch import scratch

#: Kinds of sources whose tables are read through a bounded query first.
DATABASES = ("mysql", "postgresql")
LIMITATION = "An input is, or was made from, a truncated snapshot: rows that it left out are missing here too."
UNITS = "map<string,string>"


def _written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rounds): the marked ids and all that is made from them, directly or over others, by edges (child, parent).

    A round joins only what the round before it newly reached, and is written, so there are as many rounds as the longest way
    from a mark, cycles end by themselves, and a lost executor costs a round. Null ids reach nothing.
    """
    spark, path = marked.sparkSession, scratch(marked.sparkSession, "lineage")
    new = _written(spark, marked.select("id").where("id IS NOT NULL").distinct().withColumn("rounds", F.lit(0)), f"{path}/round=0")
    reached, n = new, 0
    while not new.isEmpty():
        n += 1
        next_ = edges.join(new.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).where("id IS NOT NULL").distinct()
        new = _written(spark, next_.join(reached.select("id"), "id", "left_anti").withColumn("rounds", F.lit(n)), f"{path}/round={n}")
        reached = reached.unionByName(new)
    return reached


def _conflict(given: Column, known: Column) -> Column:
    """Whether a unit is given for a column that is known in another."""
    return F.exists(F.map_keys(given), lambda c: F.coalesce(F.nullif(known[c], F.lit("")) != given[c], F.lit(False)))


def resolved(requests: DataFrame, datasets: DataFrame, artifacts: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, input, code, units, truncated, inherited, row_limit), a row for each input of requests.

    requests: request_id, input, dataset_id or artifact_id, units (a map that the request gives). datasets: id, kind, selected, units.
    artifacts: id, media_type, accessible. evidence: id of the artifact that it is of, units, truncated, row_limit. edges: child, parent.
    ``code`` is null, or dataset_not_selected, snapshot_required, artifact_not_accessible, unit_conflict or input_ambiguous (none, or
    both, of the two ids). ``inherited``: it is whole itself, but an artifact
    above it was truncated. An id that a table lacks is not selected or accessible;
    ids are unique in datasets, artifacts and evidence.
    """
    d = datasets.select(F.col("id").alias("dataset_id"), F.col("kind").alias("__kind"), F.col("selected").alias("__selected"), F.col("units").cast(UNITS).alias("__d_units"))
    a = artifacts.select(F.col("id").alias("artifact_id"), F.col("media_type").alias("__media"), F.col("accessible").alias("__open"))
    e = evidence.select(F.col("id").alias("artifact_id"), F.col("units").cast(UNITS).alias("__a_units"), F.coalesce("truncated", F.lit(False)).alias("__cut"), "row_limit")
    reached = carried(evidence.where("truncated"), edges).select(F.col("id").alias("artifact_id"), (F.col("rounds") > 0).alias("__later"))
    rows = requests.join(d, "dataset_id", "left").join(a.join(e, "artifact_id", "left").join(reached, "artifact_id", "left"), "artifact_id", "left")
    of_set, none = F.col("dataset_id").isNotNull(), F.create_map().cast(UNITS)
    known = F.coalesce(F.when(of_set, F.col("__d_units")).otherwise(F.col("__a_units")), none)
    given = F.coalesce(F.col("units").cast(UNITS), none)
    code = (
        F.when(of_set == F.col("artifact_id").isNotNull(), "input_ambiguous")
        .when(of_set & ~F.coalesce("__selected", F.lit(False)), "dataset_not_selected")
        .when(of_set & F.col("__kind").isin(*DATABASES), "snapshot_required")
        .when(~of_set & ~F.coalesce(F.col("__open") & (F.col("__media") == "text/csv"), F.lit(False)), "artifact_not_accessible")
        .when(_conflict(given, known), "unit_conflict")
    )
    units = F.map_from_entries(F.array_distinct(F.concat(F.map_entries(given), F.map_entries(F.map_filter(known, lambda c, _: ~F.array_contains(F.map_keys(given), c))))))
    cut = ~of_set & F.coalesce("__cut", F.lit(False))
    return rows.select("request_id", "input", code.alias("code"), F.when(code.isNull(), units).alias("units"), cut.alias("truncated"), (~of_set & F.coalesce("__later", F.lit(False))).alias("inherited"), F.when(~of_set, F.col("row_limit")).alias("row_limit"))


def judged(inputs: DataFrame) -> DataFrame:
    """(request_id, status, code, inputs, truncated): rejected with the code of the first bad input, partial if an input lacks rows, else ok."""
    first = F.min(F.when(F.col("code").isNotNull(), F.struct("input", "code")))["code"]
    lacks = F.coalesce(F.bool_or(F.col("truncated") | F.col("inherited")), F.lit(False))
    one = inputs.groupBy("request_id").agg(first.alias("code"), F.count("*").alias("inputs"), lacks.alias("truncated"))
    return one.select("request_id", F.when(F.col("code").isNotNull(), "rejected").when(F.col("truncated"), "partial").otherwise("ok").alias("status"), "code", "inputs", "truncated")


def watched(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Callable[[], dict]]:
    """df, and what its rows are once an action has read it: their number and an order-free fingerprint, two sums of hashes under two seeds.

    It costs no pass of its own. Equal tables have equal fingerprints however they are parted, repeated rows included.
    """
    seen = Observation()
    cells = [F.col(f"`{c}`") for c in columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    out = df.observe(seen, F.count(F.lit(1)).alias("n"), *sums)
    return out, lambda: {"rows": seen.get["n"], "fingerprint": "-".join(str(seen.get[f"s{seed}"] or 0) for seed in (1, 2))}


def snapshot_analysis(request: DataFrame, tables: dict[str, DataFrame], operations: list[dict], result: str, path: str) -> tuple[Analysis, dict]:
    """Runs operations over a request's inputs and writes the result frame's rows to path as Parquet: (analysis, metadata).

    request: its rows of ``resolved``; ``input`` names the tables. The first bad input's code rejects. metadata has, per input, its
    rows and fingerprint as they were read, and units; output_rows; input_truncated, limitations and status. Inputs are
    written first, in the pass that counts them, so that all operations read one state of them.
    """
    spark = request.sparkSession
    inputs = {r.input: r for r in request.orderBy("input").collect()}
    require(set(inputs) == set(tables), "input_ambiguous")
    for r in inputs.values():
        require(r.code is None, r.code or "")
    frames, refs, base = {}, {}, scratch(spark, "snapshots")
    for i, (name, df) in enumerate(tables.items()):
        f = Frame.of(df)
        seen, said = watched(f.df, df.columns)
        copy = _written(spark, seen, f"{base}/{i}")
        frames[name] = Frame.of(copy.drop(ORDER), {c: u for c, u in (inputs[name].units or {}).items() if c in df.columns}).became(copy, operation="snapshot")
        refs[name] = said() | {"units": frames[name].units, "truncated": inputs[name].truncated or inputs[name].inherited, "row_limit": inputs[name].row_limit}
    run = analyze(frames, operations)
    out, said = watched(run.frames[result].result(), list(run.frames[result].columns))
    out.write.mode("errorifexists").parquet(path)
    cut = any(r["truncated"] for r in refs.values())
    return run, {"inputs": refs, "output_rows": said()["rows"], "fingerprint": said()["fingerprint"], "input_truncated": cut, "limitations": [LIMITATION] if cut else [], "status": "partial" if cut else "ok"}
