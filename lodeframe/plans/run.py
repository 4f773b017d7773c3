"""Runs an admitted query over selected tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodeframe.functions import dialect
from lodeframe.plans.policy import prepare


@dataclass(frozen=True)
class QueryResult:
    """``df`` has one row more than ``max_rows`` if the result is longer: ``rows`` cuts it and says so."""

    df: DataFrame
    sql: str
    tables: tuple[str, ...]
    max_rows: int | None = None
    units: dict[str, str] = field(default_factory=dict)

    def rows(self) -> tuple[list, bool]:
        """(rows, truncated)."""
        found = self.df.collect()
        return (found, False) if self.max_rows is None else (found[: self.max_rows], len(found) > self.max_rows)


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: int | None = None, units: dict[str, str] | None = None) -> QueryResult:
    """Admits the query for these tables and plans it over them.

    A limit bounds the rows that come back, never what is aggregated.
    """
    text, own = prepare(spark, sql, tables)
    dialect.register(spark)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    df = spark.sql(own)
    return QueryResult(df if max_rows is None else df.limit(max_rows + 1), text, tuple(tables), max_rows, dict(units or {}))


def named(tables: dict[str, DataFrame]) -> dict[str, str]:
    """dataset_1, dataset_2 and so on for the selected tables, in order."""
    return {f"dataset_{i}": name for i, name in enumerate(tables, 1)}


def file_query(spark: SparkSession, paths: dict[str, str], sql: str, max_rows: int) -> tuple[QueryResult, dict]:
    """Runs a query over selected Parquet files, by their names or as dataset_N, and says what the result rests on.

    The evidence names the tables that were selected, the query's fingerprint, the columns and the row bound.
    """
    frames = {name: spark.read.parquet(path) for name, path in paths.items()}
    short = named(frames)
    result = run_sql(spark, sql, frames | {alias: frames[name] for alias, name in short.items()}, max_rows)
    evidence = {"kind": "sql", "sha256": hashlib.sha256(result.sql.encode()).hexdigest(), "tables": list(paths), "aliases": short, "columns": result.df.columns, "row_limit": max_rows}
    return result, evidence
