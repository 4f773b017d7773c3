"""Registered queries of the declarative operators, the profile and the sinks, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.errors import AnalysisError
from lodeframe.frame import Frame
from lodeframe.operators import pipeline as p
from lodeframe.operators import profile as prof
from lodeframe.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(run):
        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> Frame:
    """orders as text columns, every tenth status blank."""
    df = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.col("o_orderstatus")).alias("status"))
    return Frame.of(df, {"price": "USD"}, F.col("o_orderkey"))


_T = "(SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS price, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderstatus END AS status FROM orders)"


@query("op_convert_text", f"SELECT o_orderkey, nullif(status, '') AS status FROM {_T}")
def convert_text(spark, d):
    return p.convert(_orders(spark, d), ["status"], "text").result().select("o_orderkey", "status")


@query("op_convert_number", f"SELECT o_orderkey, CAST(price AS DECIMAL(28,2)) AS price FROM {_T}")
def convert_number(spark, d):
    return p.convert(_orders(spark, d), ["price"], "number").result().select("o_orderkey", F.col("price").cast("decimal(28,2)"))


@query("op_convert_integer", f"SELECT o_orderkey, CAST(floor(price) AS BIGINT) AS whole FROM {_T}")
def convert_integer(spark, d):
    f = _orders(spark, d)
    f = Frame.of(f.result().withColumn("whole", F.concat(F.regexp_extract("price", r"^\d+", 0), F.lit(".0"))), order=F.col("o_orderkey"))
    return p.convert(f, ["whole"], "integer").result().select("o_orderkey", "whole")


@query("op_convert_date", f"SELECT o_orderkey, CAST(d AS DATE) AS day FROM {_T}")
def convert_date(spark, d):
    return p.convert(_orders(spark, d), ["day"], "date").result().select("o_orderkey", F.col("day").cast("date"))


@query("op_filter", f"SELECT o_orderkey FROM {_T} WHERE price >= 150000.5 AND status <> '' AND status = 'F'")
def filter_rows(spark, d):
    f = p.convert(_orders(spark, d), ["price"], "number")
    return p.filter_rows(p.filter_rows(f, "price", "ge", "150000.5"), "status", "eq", "F").result().select("o_orderkey")


@query("op_missing_drop", f"SELECT o_orderkey, status FROM {_T} WHERE status <> ''")
def missing_drop(spark, d):
    return p.missing_values(_orders(spark, d), ["status"], "drop").result().select("o_orderkey", "status")


@query("op_missing_fill", f"SELECT o_orderkey, CASE WHEN status = '' THEN 'unknown' ELSE status END AS status FROM {_T}")
def missing_fill(spark, d):
    return p.missing_values(_orders(spark, d), ["status"], "fill", "unknown").result().select("o_orderkey", "status")


@query("op_missing_reject", "SELECT 'missing_values_require_policy' AS code")
def missing_reject(spark, d):
    return _code(spark, lambda: p.missing_values(_orders(spark, d), ["status"], "reject"))


@query("op_duplicates_drop", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def duplicates_drop(spark, d):
    return p.duplicates(_orders(spark, d), ["o_custkey"], "drop").result().select("o_custkey", "o_orderkey")


@query("op_duplicates_reject", "SELECT 'duplicate_identifiers' AS code")
def duplicates_reject(spark, d):
    return _code(spark, lambda: p.duplicates(_orders(spark, d), ["o_custkey"], "reject"))


def _code(spark, call) -> DataFrame:
    try:
        call()
        code = None
    except AnalysisError as e:
        code = e.code
    return spark.createDataFrame([(code,)], "code string")


def _customers(spark, d) -> Frame:
    return Frame.of(_read(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_custkey").alias("o_orderkey")), order=F.col("c_custkey"))


@query("op_join_inner", "SELECT o_orderkey, c_mktsegment, c_custkey AS o_orderkey_right FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return p.join(_orders(spark, d), _customers(spark, d), ["o_custkey"], ["c_custkey"]).result().select("o_orderkey", "c_mktsegment", "o_orderkey_right")


@query("op_join_left", "SELECT c_custkey, o.o_orderkey FROM customer LEFT JOIN orders o ON o_custkey = c_custkey")
def join_left(spark, d):
    f = p.join(_customers(spark, d), _orders(spark, d), ["c_custkey"], ["o_custkey"], "left", "one_to_many")
    return f.result().select("c_custkey", F.col("o_orderkey_right").alias("o_orderkey"))


@query("op_join_estimate", "SELECT CAST((SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS BIGINT) AS unmatched_left, CAST(0 AS BIGINT) AS unmatched_right")
def join_notes(spark, d):
    note = p.join(_customers(spark, d), _orders(spark, d), ["c_custkey"], ["o_custkey"], "left", "one_to_many", limit=10**9).notes[-1]
    return spark.createDataFrame([(note["unmatched_left"], note["unmatched_right"])], "unmatched_left long, unmatched_right long")


@query("op_join_cardinality", "SELECT 'join_right_keys_not_unique' AS code")
def join_cardinality(spark, d):
    return _code(spark, lambda: p.join(_customers(spark, d), _orders(spark, d), ["c_custkey"], ["o_custkey"]))


@query("op_aggregate_sum", f"SELECT status, CAST(sum(price) AS DECIMAL(28,2)) AS total, count(*) AS n, CAST(min(price) AS DECIMAL(12,2)) AS least, CAST(max(price) AS DECIMAL(12,2)) AS most FROM {_T} GROUP BY status")
def aggregate_sum(spark, d):
    f = p.convert(_orders(spark, d), ["price"], "number")
    out = p.aggregate(f, ["status"], [p.Metric("sum", "price", "total"), p.Metric("count", "status", "n"), p.Metric("min", "price", "least"), p.Metric("max", "price", "most")])
    return out.result().select("status", F.col("total").cast("decimal(28,2)"), "n", F.col("least").cast("decimal(12,2)"), F.col("most").cast("decimal(12,2)"))


@query("op_aggregate_mean", f"SELECT o_orderkey // 2 AS pair, CAST(avg(o_orderkey) AS DECIMAL(28,4)) AS mean FROM {_T} GROUP BY 1")
def aggregate_mean(spark, d):
    df = _read(spark, d, "orders").selectExpr("o_orderkey DIV 2 AS pair", "cast(o_orderkey as string) AS v")
    return p.aggregate(p.convert(Frame.of(df), ["v"], "number"), ["pair"], [p.Metric("mean", "v", "mean")]).result().select("pair", F.col("mean").cast("decimal(28,4)"))


@query("op_aggregate_guard", "SELECT 'aggregate_missing_values_require_policy' AS code")
def aggregate_guard(spark, d):
    return _code(spark, lambda: p.aggregate(_orders(spark, d), [], [p.Metric("sum", "status", "x")]))


for _name, _sql in (("add", "price + o_custkey"), ("subtract", "price - o_custkey"), ("multiply", "price * o_custkey")):
    def _derive(spark, d, name=_name):
        f = p.convert(_orders(spark, d), ["price"], "number")
        return p.derive(Frame(f.df, f.columns), name, ["price", "o_custkey"], "v").result().select("o_orderkey", F.col("v").cast("decimal(28,2)"))

    query(f"op_derive_{_name}", f"SELECT o_orderkey, CAST({_sql} AS DECIMAL(28,2)) AS v FROM {_T}")(_derive)


@query("op_derive_divide", f"SELECT o_orderkey, CAST(price * 0.125 AS DECIMAL(28,5)) AS v FROM {_T}")
def derive_divide(spark, d):
    f = p.convert(Frame.of(_orders(spark, d).result().withColumn("eight", F.lit("8"))), ["price", "eight"], "number")
    return p.derive(f, "divide", ["price", "eight"], "v").result().select("o_orderkey", F.col("v").cast("decimal(28,5)"))


for _name, _sql in (("year", "year(d)"), ("month", "month(d)"), ("fiscal_year", "year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END")):
    def _derive_date(spark, d, name=_name):
        return p.derive(p.convert(_orders(spark, d), ["day"], "date"), name, ["day"], "v").result().select("o_orderkey", F.col("v").cast("long"))

    query(f"op_derive_{_name}", f"SELECT o_orderkey, CAST({_sql} AS BIGINT) AS v FROM {_T}")(_derive_date)


@query("op_melt", "SELECT p_partkey, unnest(['p_brand', 'p_type']) AS variable, unnest([p_brand, p_type]) AS value FROM part")
def melt(spark, d):
    return p.melt(Frame.of(_read(spark, d, "part").select("p_partkey", "p_brand", "p_type")), ["p_partkey"], ["p_brand", "p_type"]).result()


@query("op_pivot", "SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS \"F\", max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS \"O\", max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_custkey")
def pivot(spark, d):
    df = _read(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_orderkey").alias("k"))
    return p.pivot(Frame.of(df), ["o_custkey"], "o_orderstatus", "k").result()


def _lines(spark, d) -> Frame:
    return Frame.of(_read(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"))


@query("op_stats_describe", "SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, round(stddev_samp(l_quantity), 6) AS std, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem")
def stats_describe(spark, d):
    s = p.statistics(_lines(spark, d), ["l_quantity"])["l_quantity"]
    return spark.createDataFrame([(s["count"], round(s["mean"], 6), s["min"], s["max"], round(s["std_sample"], 6), *s["quartiles"])], "n long, mean double, least double, most double, std double, q1 double, q2 double, q3 double")


@query("op_stats_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 9) AS r FROM lineitem")
def stats_correlation(spark, d):
    return spark.createDataFrame([(round(p.statistics(_lines(spark, d), ["l_quantity", "l_extendedprice"], "correlation")["correlation"][0][1], 9),)], "r double")


@query("op_stats_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def stats_regression(spark, d):
    s = p.statistics(_lines(spark, d), ["l_extendedprice", "l_quantity"], "regression")
    return spark.createDataFrame([(round(s["coefficients"][0], 4), round(s["intercept"], 4), round(s["r_squared"], 8))], "slope double, intercept double, r2 double")


@query("op_stats_outliers", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT count(*) FILTER (WHERE l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)) AS n FROM lineitem, q")
def stats_outliers(spark, d):
    return spark.createDataFrame([(p.statistics(_lines(spark, d), ["l_extendedprice"], "outliers")["count"],)], "n long")


# --- profiles
@query("profile_column", "SELECT 'c_name' AS name, count(*) AS rows, count(*) FILTER (WHERE c_name IS NULL) AS missing FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (WHERE c_mktsegment IS NULL) FROM customer")
def profile_column(spark, d):
    return prof.column_stats(_read(spark, d, "customer").select("c_name", "c_mktsegment")).select("name", "rows", "missing")




_FORMS = "CASE o_orderkey % 7 WHEN 0 THEN '' || o_orderkey WHEN 1 THEN '0' || o_orderkey WHEN 2 THEN '-' || o_orderkey || '.50' WHEN 3 THEN 'TRUE' WHEN 4 THEN substr(CAST(o_orderdate AS {text}), 1, 10) WHEN 5 THEN o_orderstatus ELSE '2026-13-01' END"


@query("infer_type", f"SELECT o_orderkey, {_FORMS.format(text='VARCHAR')} AS v, CASE o_orderkey % 7 WHEN 0 THEN 'integer' WHEN 2 THEN 'decimal' WHEN 3 THEN 'boolean' WHEN 4 THEN 'date' ELSE 'string' END AS kind FROM orders")
def infer_type(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", F.expr(_FORMS.format(text="STRING")).alias("v")).withColumn("kind", prof.infer_type(F.col("v")))


@query("parse_date", f"SELECT o_orderkey, d FROM {_T}")
def parse_date(spark, d):
    df = _read(spark, d, "orders")
    forms = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return df.select("o_orderkey", prof.parse_date(forms).alias("d"))


# --- sinks
@query("sink_safe_csv", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '''=' || c_name WHEN c_custkey % 3 = 1 THEN '-' || c_custkey ELSE c_name END AS v FROM customer")
def safe_csv(spark, d):
    v = F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat('=', c_name) WHEN c_custkey % 3 = 1 THEN concat('-', c_custkey) ELSE c_name END")
    return _read(spark, d, "customer").select("c_custkey", sinks.formula_safe(v).alias("v"))


@query("cell_serialize", "SELECT o_orderkey, CAST(o_orderkey + 9007199254740000 AS VARCHAR) AS big, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE '1.5' END AS x FROM orders")
def cell_serialize(spark, d):
    df = _read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") + 9007199254740000).alias("big"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderkey") % 2 == 0, float("nan")).otherwise(1.5).alias("x"))
    return df.select("o_orderkey", *(sinks.cell(df, c).alias(c) for c in ("big", "price", "at", "x")))

