"""Registered queries of admission, guards, file scans, document tables and greedy selections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.errors import EngineError
from lodeframe.frame import Frame
from lodeframe.operators import pipeline as p
from lodeframe.operators import profile, tables
from lodeframe.plans.analyze import analyze
from lodeframe.plans.policy import admit
from lodeframe.plans.run import run_sql
from lodeframe.scratch import scratch
from lodeframe.sources import files, sinks
from lodeframe.text import blocks, retrieval, summarize
from lodeframe.text import expressions as x

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(run):
        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return put


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def code_of(call) -> str:
    try:
        call()
    except EngineError as e:
        return e.code
    return "admitted"


#: Rules of statements and columns alone, by name and case: (call, code). They read no table, so they aren't queries.
RULES: dict[str, dict[str, tuple[Callable, str]]] = dict.fromkeys(("sql_policy", "sql_single_stmt", "sql_readonly", "sql_functions", "sql_tables", "sql_bounds", "sql_exec_comment", "op_input_contract"), {})


def codes(name: str, cases: dict[str, tuple[Callable, str]]) -> None:
    """A query of (case, code): what each call is rejected with."""
    if name in RULES:
        RULES[name] = cases
        return
    rows = ", ".join(f"('{case}', '{code}')" for case, (_, code) in cases.items())
    query(name, f'SELECT * FROM (VALUES {rows}) t("case", code)')(lambda spark, d: spark.createDataFrame([(case, code_of(lambda c=call: c(spark, d))) for case, (call, _) in cases.items()], "case string, code string"))


def _admits(text: str) -> Callable:
    return lambda spark, d: admit(spark, text, ["orders", "customer"])


codes("sql_policy", {c: (_admits(s), want) for c, s, want in (
    ("select", "SELECT o_orderkey FROM orders", "admitted"), ("empty", " ; ", "empty_sql"), ("two", "SELECT 1; SELECT 2", "multiple_statements"), ("broken", "SELECT (", "sql_parse_error"), ("large", "SELECT " + "1 + " * 6000 + "1", "sql_too_large"),
)})
codes("sql_single_stmt", {c: (_admits(s), want) for c, s, want in (("two", "SELECT 1; SELECT 2", "multiple_statements"), ("quoted", "SELECT ';'", "admitted"), ("comment", "SELECT 1 -- a; b", "admitted"), ("closed", "SELECT 1;", "admitted"))})
codes("sql_readonly", {c: (_admits(s), want) for c, s, want in (("insert", "INSERT INTO orders SELECT 1", "forbidden_statement"), ("drop", "DROP TABLE orders", "forbidden_statement"), ("show", "SHOW TABLES", "not_readonly"), ("values", "SELECT * FROM VALUES (1)", "forbidden_statement"))})
codes("sql_functions", {c: (_admits(s), want) for c, s, want in (("random", "SELECT rand()", "function_not_allowed"), ("qualified", "SELECT a.count(1)", "qualified_function_forbidden"), ("repeat", "SELECT repeat('x', 200000)", "function_argument_limit"), ("known", "SELECT upper('x')", "admitted"), ("identifier", "SELECT IDENTIFIER('re' || 'flect')('java.lang.Math', 'abs', 1)", "function_not_allowed"), ("bare", "SELECT CURRENT_USER", "function_not_allowed"), ("any", "SELECT any_value(o_orderkey) FROM orders", "function_not_allowed"))})
codes("sql_tables", {c: (_admits(s), want) for c, s, want in (("other", "SELECT * FROM lineitem", "table_not_selected"), ("system", "SELECT * FROM information_schema.tables", "system_schema_forbidden"), ("cte", "WITH lineitem AS (SELECT 1 AS a) SELECT a FROM lineitem", "admitted"))})
codes("sql_bounds", {c: (_admits(s), want) for c, s, want in (("joins", "SELECT 1 FROM orders" + " JOIN customer ON 1 = 1" * 33, "too_many_joins"), ("literal", "SELECT '" + "x" * 5000 + "'", "literal_too_large"))})
codes("sql_exec_comment", {"mysql": (lambda spark, d: admit(spark, "SELECT /*! 1 */ 2", None, "mysql"), "executable_comment_forbidden")})


@query("sql_limit_merge", "SELECT 1500 * 0 + 7 AS rows, TRUE AS truncated")
def sql_limit_merge(spark, d):
    rows, cut = run_sql(spark, "SELECT o_orderkey FROM orders LIMIT 100", {"orders": _t(spark, d, "orders")}, max_rows=7).rows()
    return spark.createDataFrame([(len(rows), cut)], "rows int, truncated boolean")


def _f(spark, d) -> Frame:
    return Frame.of(_t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit("").alias("blank"), F.lit("x").alias("text")))


codes("op_stats_guard", {
    "missing": (lambda s, d: p.statistics(_f(s, d), ["blank"]), "statistics_missing_values_require_policy"),
    "empty": (lambda s, d: p.statistics(Frame.of(_f(s, d).result().limit(0)), ["o_orderkey"]), "statistics_empty_sample"),
    "unknown": (lambda s, d: p.statistics(_f(s, d), ["o_orderkey"], "median"), "unknown_statistic"),
})
codes("op_require_columns", {"unknown": (lambda s, d: p.filter_rows(_f(s, d), "nope", "eq", "1"), "unknown_column"), "empty": (lambda s, d: p.melt(Frame.of(_f(s, d).result().limit(0)), ["nope"], ["text"]), "unknown_column")})
codes("op_bounds", {"rows": (lambda s, d: p.bounds(_f(s, d), 10, 10**9), "analysis_expansion_limit"), "fine": (lambda s, d: p.bounds(_f(s, d), 10**9, 10**12), "admitted")})
codes("op_chart", {"nan": (lambda s, d: sinks.chart_spec(s.sql("SELECT 'a' AS x, CAST('NaN' AS DOUBLE) AS y"), "bar", "x", "y"), "chart_nonfinite_values"), "columns": (lambda s, d: sinks.chart_spec(_f(s, d).result(), "bar", "x", "y"), "unknown_column")})
codes("op_input_contract", {"headers": (lambda s, d: Frame.of(s.sql("SELECT 1 AS a, 2 AS A")), "input_headers_invalid")})


@query("q_eligible_by_region", "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(28,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(o_totalprice AS DECIMAL(12,2)) <= 200000 AND o_orderstatus = 'F' GROUP BY c_mktsegment")
def q_eligible_by_region(spark, d):
    orders = Frame.of(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("price")), {"price": "USD"})
    customers = Frame.of(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"))
    on = {"frame": "o"}
    run = analyze({"o": orders, "c": customers}, [on | {"kind": "convert", "columns": ["price"], "data_type": "number"}, on | {"kind": "missing", "columns": ["price"], "policy": "reject"}, on | {"kind": "filter", "column": "price", "comparison": "le", "value": "200000"}, on | {"kind": "filter", "column": "o_orderstatus", "comparison": "eq", "value": "F"}, on | {"kind": "join", "columns": ["o_custkey"], "right_frame": "c", "right_on": ["c_custkey"]}, on | {"kind": "aggregate", "columns": ["c_mktsegment"], "metrics": [{"function": "count", "column": "o_orderkey", "output": "n"}, {"function": "sum", "column": "price", "output": "total"}]}])
    return run.frames["o"].result().select("c_mktsegment", "n", F.col("total").cast("decimal(28,2)"))


# --- scans of what a query has written itself
@query("scan_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def scan_csv(spark, d):
    path = scratch(spark, "csv")
    _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").coalesce(1).write.csv(path, header=True, sep=";")
    part = next(f for f in spark.read.format("binaryFile").load(path).select("path").collect() if f["path"].endswith(".csv"))
    return files.scan_csv(spark, part["path"])


@query("scan_parquet_flat", "SELECT p_partkey, p_brand FROM part")
def scan_parquet_flat(spark, d):
    return files.scan_parquet(spark, f"{d}/part.parquet").select("p_partkey", "p_brand")


@query("scan_json_records", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def scan_json(spark, d):
    path = scratch(spark, "json")
    rows = F.to_json(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))))
    _t(spark, d, "region").agg(rows.alias("value")).coalesce(1).write.text(path)
    return files.scan_json(spark, path)


@query("sink_result_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def sink_result_csv(spark, d):
    path = scratch(spark, "sink")
    sinks.write_csv(_t(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.csv(path, header=True)


@query("scan_xlsx", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def scan_xlsx(spark, d):
    path = scratch(spark, "workbook") + ".xlsx"
    sinks.write_xlsx(_t(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return files.scan_xlsx(spark, path)["data"]


# --- tables of documents: the rows of nation as a table a region
def _row_blocks(spark, d) -> DataFrame:
    n = _t(spark, d, "nation").select("n_regionkey", F.lit("table_row").alias("kind"), F.lit(0).alias("table"), (F.col("n_nationkey") + 1).alias("row"), F.array(F.col("n_nationkey").cast("string"), "n_name", F.concat(F.lit("$1,0"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))).alias("cells"))
    head = _t(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lit("table_row").alias("kind"), F.lit(0).alias("table"), F.lit(0).alias("row"), F.array(F.lit("size"), F.lit("name"), F.lit("amount")).alias("cells"))
    return head.unionByName(n)


@query("table_candidates", "SELECT n_regionkey, count(*) + 1 AS n FROM nation GROUP BY n_regionkey")
def table_candidates(spark, d):
    return tables.candidates(_row_blocks(spark, d), "n_regionkey").select("n_regionkey", F.size("rows").cast("long").alias("n"))


@query("table_schema", "SELECT n_regionkey, unnest(['size', 'name', 'amount']) AS name, unnest(['integer', 'text', 'integer']) AS type, unnest([NULL, NULL, 'USD']) AS unit FROM (SELECT DISTINCT n_regionkey FROM nation)")
def table_schema(spark, d):
    return tables.schema(tables.cells(tables.candidates(_row_blocks(spark, d), "n_regionkey"), "n_regionkey"), "n_regionkey").select("n_regionkey", "name", "type", "unit")


@query("table_accept", "SELECT CAST(n_nationkey AS VARCHAR) AS size, n_name AS name, CAST(1000 + n_nationkey AS VARCHAR) AS amount FROM nation WHERE n_regionkey = 1")
def table_accept(spark, d):
    return tables.accept(tables.cells(tables.candidates(_row_blocks(spark, d), "n_regionkey"), "n_regionkey"), "n_regionkey", 1, 0)


# --- chunks: expansion, and what is greedy on a bounded number of them
def _page_chunks(spark, d) -> DataFrame:
    return blocks.chunks(blocks.group_blocks(blocks.html_blocks(_t(spark, d, "pages")), "page_id"), "page_id")


@query("retr_expand")
def retr_expand(spark, d):
    c = _page_chunks(spark, d)
    return retrieval.expand(c, c.where("ordinal = 1").select("chunk_id"))


@query("retr_dedupe_adjacent")
def retr_dedupe_adjacent(spark, d):
    found = _page_chunks(spark, d).orderBy("page_id", "ordinal").limit(retrieval.CANDIDATES)
    ranked = [r.asDict() | {"document_id": r["page_id"]} for r in found.select("chunk_id", "page_id", "ordinal", "text", "previous_id", "next_id").collect()]
    return spark.createDataFrame([(r["chunk_id"], r["rank"]) for r in retrieval.dedupe_adjacent(ranked)], "chunk_id string, rank int")


@query("sum_score")
def sum_score(spark, d):
    c = _page_chunks(spark, d)
    return summarize.sentence_scores(c, summarize.document_frequency(c))


@query("sum_select")
def sum_select(spark, d):
    return summarize.summaries(_page_chunks(spark, d), "page_id")


@query("sum_thematic")
def sum_thematic(spark, d):
    return summarize.themes(_page_chunks(spark, d))


@query("sum_sample", "SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 50 GROUP BY l_suppkey")
def sum_sample(spark, d):
    from pyspark.sql import Window

    rows = _t(spark, d, "lineitem").select("l_suppkey", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")).alias("ordinal"))
    return summarize.sample(rows, "l_suppkey", 50).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("page_rows_file", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_rows(spark, d):
    rows, _ = files.page(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 100, 50)
    return spark.createDataFrame([(int(r["o_orderkey"]),) for r in rows], "o_orderkey long")


@query("chart_summary", "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag")
def chart_summary(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


_FORMULAS = "CASE c_custkey % 5 WHEN 0 THEN '=' || c_name WHEN 1 THEN '-' || c_custkey WHEN 2 THEN '-' || c_name WHEN 3 THEN ' @' || c_name ELSE c_name END"


@query("formula_safe_text", f"SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 2, 3) THEN chr(39) || {_FORMULAS} ELSE {_FORMULAS} END AS safe FROM customer")
def formula_safe_text(spark, d):
    return _t(spark, d, "customer").select("c_custkey", sinks.formula_safe(F.expr(_FORMULAS)).alias("safe"))


@query("legacy_digits", "SELECT p_partkey, p_partkey || ' ' || p_name AS v FROM part")
def legacy_digits(spark, d):
    text = F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name")
    return _t(spark, d, "part").select("p_partkey", x.ascii_digits(F.translate(text, "0123456789", x.DEVANAGARI_DIGITS)).alias("v"))
