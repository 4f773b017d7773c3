"""Evidence and lineage: references that must hold, aliases, fingerprints and the catalog of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.text.expressions import numeric_claims, redact


def parse_reference(ref: Column) -> Column:
    """struct<kind, id, version, hash> of source:ID@VERSION#HASH and the like; nulls where it is none."""
    g = lambda i: F.nullif(F.regexp_extract(ref, r"^(source|dataset|artifact):([^@#]+)(?:@(\d+))?(?:#([0-9a-f]+))?$", i), F.lit(""))
    return F.struct(g(1).alias("kind"), g(2).alias("id"), g(3).cast("long").alias("version"), g(4).alias("hash"))


def unresolved(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """References whose id, version or hash isn't in the catalog (kind, id, version, hash); version and hash only where given."""
    r = references.withColumn("__p", parse_reference(F.col("ref")))
    c = catalog.select(*(F.col(x).alias(f"c_{x}") for x in ("kind", "id", "version", "hash")))
    on = (F.col("__p.kind") == F.col("c_kind")) & (F.col("__p.id") == F.col("c_id")) & F.coalesce(F.col("__p.version") == F.col("c_version"), F.lit(True)) & F.coalesce(F.col("__p.hash") == F.col("c_hash"), F.lit(True))
    return r.join(c, on, "left_anti").drop("__p")


def accessible(artifacts: DataFrame, selected: list[str], sources_col: str = "sources") -> DataFrame:
    """Artifacts all of whose sources are selected."""
    return artifacts.where(F.size(F.array_except(F.col(sources_col), F.array(*map(F.lit, selected)))) == 0)


def unsupported_numbers(answer: Column, known: Column) -> Column:
    """Numbers that the text claims and the rows (an array of text) don't have."""
    return F.array_except(numeric_claims(answer), known)


def aliases(rows: DataFrame, kind_col: str, id_col: str, order_col: str) -> DataFrame:
    """Adds alias: kind_1, kind_2 and so on, by first appearance."""
    first = rows.groupBy(kind_col, id_col).agg(F.min(order_col).alias("__f"))
    n = F.row_number().over(Window.partitionBy(kind_col).orderBy("__f", id_col))
    return first.select(kind_col, id_col, F.concat_ws("_", kind_col, n.cast("string")).alias("alias"))


def remap(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The column's ids by their new ones (old, new); others stay."""
    m = ids.select(F.col("old").alias(column), F.col("new").alias("__new"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(*rows.columns)


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256)


def register(catalog: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """catalog with the rows of new whose key it lacks: adding twice adds once."""
    return catalog.unionByName(new.dropDuplicates([key]).join(catalog, key, "left_anti"))


def remove_plan(items: DataFrame, references: DataFrame, id_col: str) -> DataFrame:
    """What becomes of each item: archived where something refers to it, else deleted."""
    used = references.select(id_col).distinct().withColumn("__u", F.lit(1))
    return items.join(used, id_col, "left").select(*items.columns, F.when(F.col("__u") == 1, "archive").otherwise("delete").alias("action"))


def references(records: DataFrame, value_col: str, ids: DataFrame) -> DataFrame:
    """Records whose JSON text names one of ids (a column id) in any key or text: bare, or as source:ID@VERSION and the like."""
    texts = F.regexp_extract_all(F.col(f"`{value_col}`"), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    identity = lambda s: F.regexp_extract(s, r"^(?:source|dataset|artifact|document|run):([^@]*)", 1)
    named = F.array_distinct(F.concat(texts, F.transform(texts, identity)))
    rows = records.withColumn("__hash", F.xxhash64(F.col(f"`{value_col}`")))
    hit = rows.select(F.col("__hash"), F.col(f"`{value_col}`").alias("__value"), F.explode(named).alias("id")).join(ids.select(F.col("id").cast("string")), "id", "left_semi").select("__hash", "__value").distinct()
    return rows.join(hit, (rows["__hash"] == hit["__hash"]) & (F.col(f"`{value_col}`") == F.col("__value")), "left_semi").drop("__hash")


def current(catalog: DataFrame, key: str, version: str) -> DataFrame:
    """Each key's entry of the highest version; of entries of one version, the largest row."""
    last = catalog.groupBy(key).agg(F.max(F.struct(F.col(version), F.struct(*catalog.columns).alias("row"))).alias("__m"))
    return last.select("__m.row.*")


def export(parts: dict[str, DataFrame], most: int, secrets: list[str]) -> DataFrame:
    """(kind, id, details): a bounded bundle of audit records, so many a kind by id, with secrets masked."""
    out = None
    for kind, rows in parts.items():
        one = rows.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), redact(F.col("details"), secrets).alias("details"), F.col("id").alias("__o")).orderBy("__o").limit(most).drop("__o")
        out = one if out is None else out.unionByName(one)
    return out
