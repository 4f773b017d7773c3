"""Tables found in documents: candidates from row blocks, typed columns, warnings and acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.errors import FileError, require
from lodeframe.text import expressions as x


def candidates(blocks: DataFrame, id_col: str) -> DataFrame:
    """(id, table, rows array<array<string>>): the row blocks of each table in order."""
    rows = blocks.where((F.col("kind") == "table_row") & F.col("cells").isNotNull())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"])
    return rows.groupBy(F.col(f"`{id_col}`"), "table").agg(ordered.alias("rows"))


def column_names(header: list[str]) -> list[str]:
    """Header cells, Column N where one is empty, repeats with (2), (3), at most 255 characters."""
    out: list[str] = []
    for i, cell in enumerate(header, 1):
        base = " ".join((cell or "").split())[:255] or f"Column {i}"
        name, n = base, 2
        while name in out:
            name, n = f"{base[:250]} ({n})", n + 1
        out.append(name)
    return out


def cells(tables: DataFrame, id_col: str) -> DataFrame:
    """A row a body cell: (id, table, row, col, name, raw, kind, value, unit, bad_group)."""
    each = tables.select(F.col(f"`{id_col}`"), "table", F.get("rows", F.lit(0)).alias("header"), F.posexplode(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).alias("row", "body"))
    flat = each.select(F.col(f"`{id_col}`"), "table", "row", "header", F.posexplode("body").alias("col", "raw"))
    name = F.coalesce(F.nullif(F.trim(F.get("header", F.col("col"))), F.lit("")), F.concat(F.lit("Column "), F.col("col") + 1))
    named = flat.withColumn("name", name)
    identifier = F.lower("name").rlike(r"(^|[^a-z])(id|code|number|no|ref|reference)s?($|[^a-z])")
    value = F.when(identifier, x.table_value(F.col("raw"), True)).otherwise(x.table_value(F.col("raw")))
    return named.withColumn("v", value).select(F.col(f"`{id_col}`"), "table", "row", "col", "name", "raw", "v.kind", "v.value", x.currency(F.col("raw")).alias("unit"), x.invalid_grouping(F.col("raw")).alias("bad_group"))


def schema(values: DataFrame, id_col: str) -> DataFrame:
    """(id, table, col, name, type, nullable, unit, warnings): one kind of values, or text; a unit if there is just one."""
    kinds = F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))
    grouped = values.groupBy(F.col(f"`{id_col}`"), "table", "col", "name").agg(kinds.alias("kinds"), F.max(F.col("kind") == "null").alias("nullable"), F.collect_set("unit").alias("units"), F.max("bad_group").alias("bad"))
    both = F.size(F.array_except("kinds", F.array(F.lit("integer"), F.lit("number")))) == 0
    kind = F.when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).when((F.size("kinds") == 2) & both, "number").otherwise("text")
    warnings = F.array_compact(F.array(F.when((F.size("kinds") > 1) & ~both, "mixed_types"), F.when(F.size("units") > 1, "multiple_currencies"), F.when(F.col("bad"), "invalid_grouping")))
    return grouped.select(F.col(f"`{id_col}`"), "table", "col", "name", kind.alias("type"), "nullable", F.when(F.size("units") == 1, F.get("units", F.lit(0))).alias("unit"), warnings.alias("warnings"))


def accept(values: DataFrame, id_col: str, document, table: int) -> DataFrame:
    """One table as a DataFrame of text columns with exact values, a row a table row."""
    own = values.where((F.col(f"`{id_col}`") == document) & (F.col("table") == table))
    heads = own.select("col", "name").distinct().orderBy("col").collect()
    require(bool(heads), "table_not_found", FileError)
    wide = own.groupBy("row").pivot("col", [h["col"] for h in heads]).agg(F.first("value")).orderBy("row").drop("row")
    return wide.toDF(*column_names([h["name"] for h in heads]))


def provenance(values: DataFrame) -> DataFrame:
    """Adds provenance to rows of cells(): where a value is from, and what stood there, cut to 2,000 characters."""
    return values.withColumn("provenance", F.struct(F.col("row"), F.col("col").alias("column"), F.substring("raw", 1, 2000).alias("raw_value")))


def preview(values: DataFrame, id_col: str, rows: int = 10, size: int = 64 << 10) -> DataFrame:
    """(id, table, row, cells): the first rows of each table for as long as their bytes as JSON last, in table order in a document."""
    few = provenance(values.where(F.col("row") < rows))
    cells_ = F.transform(F.array_sort(F.collect_list(F.struct("col", "value", F.col("kind").alias("type"), "provenance"))), lambda c: F.struct(c["value"], c["type"], c["provenance"]))
    lines = few.groupBy(F.col(f"`{id_col}`"), "table", "row").agg(cells_.alias("cells"))
    used = F.sum(F.octet_length(F.to_json(F.struct(F.col("row").alias("row_index"), "cells")))).over(Window.partitionBy(F.col(f"`{id_col}`")).orderBy("table", "row"))
    return lines.withColumn("__used", used).where(F.col("__used") <= size).drop("__used")
