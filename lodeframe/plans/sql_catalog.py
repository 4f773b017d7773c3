"""Registered queries of the SQL surface: each runs through admission, and has its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.plans.run import run_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def sql(name: str, text: str, duck: str | None = None, oracle: bool = True) -> None:
    """Registers a query by its Spark text; the twin is the same text unless given."""
    used = [t for t in _TABLES if t in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, text, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}).df

    QUERIES[name] = run
    if oracle:
        ORACLE[name] = duck or text


def scalar(name: str, of: str, spark: str, duck: str | None = None, kind: str = "VARCHAR", oracle: bool = True) -> None:
    """One function over one table: (k, v)."""
    table, key = {"c": ("customer", "c_custkey"), "p": ("part", "p_partkey"), "o": ("orders", "o_orderkey"), "e": ("events", "event_id")}[of]
    as_spark = {"VARCHAR": "STRING"}.get(kind, kind)
    text = f"SELECT {key} AS k, CAST({spark} AS {as_spark}) AS v FROM {table}"
    sql(f"fn_{name.lower()}", text, f"SELECT {key} AS k, CAST({duck or spark} AS {kind}) AS v FROM {table}", oracle)


# --- relational operators
sql("sql_project", "SELECT c_custkey, c_name AS name, c_nationkey + 1 AS next_nation FROM customer")
sql("sql_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 1000 AND 250000 AND o_orderpriority LIKE '1%' AND o_custkey IS NOT NULL")
sql("sql_case_if", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE 'small' END AS band, IF(p_size > 25, 1, 0) AS big FROM part")
sql("sql_cast", "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12,2)) AS price, CAST(p_size AS BIGINT) AS size FROM part")
sql("sql_try_cast", "SELECT c_custkey, TRY_CAST(right(c_name, 3) AS INT) AS n, TRY_CAST(c_mktsegment AS INT) AS none FROM customer")
for how, word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    sql(f"sql_join_{how}", f"SELECT c_custkey, o_orderkey FROM customer {word} orders ON c_custkey = o_custkey")
sql("sql_join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("sql_join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
sql("sql_join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
sql("sql_join_range", "SELECT n_name, count(*) AS c FROM nation JOIN supplier ON s_acctbal BETWEEN n_nationkey * 300 AND n_nationkey * 300 + 900 GROUP BY n_name")
sql("sql_subquery_scalar", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
sql("sql_subquery_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("sql_subquery_derived", "SELECT max(c) AS most FROM (SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey) t")
sql("sql_subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql("sql_cte", "WITH x AS (SELECT n_regionkey AS r FROM nation), y AS (SELECT r, count(*) AS c FROM x GROUP BY r), x2 AS (WITH y AS (SELECT 1 AS one) SELECT one FROM y) SELECT r, c, one FROM y CROSS JOIN x2")
sql("sql_cte_recursive", "WITH RECURSIVE t(k, root, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, root, depth + 1 FROM t JOIN customer ON c_custkey = 2 * k) SELECT k, root, depth FROM t")
sql("sql_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS c, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(28,2)) AS s, CAST(max(l_quantity) AS DOUBLE) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("sql_having", "SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql("sql_count_distinct", "SELECT count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM lineitem")
sql("sql_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
for kind, by in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    sql(f"sql_{kind}", f"SELECT l_returnflag, l_linestatus, count(*) AS c FROM lineitem GROUP BY {by}")
sql("sql_filter_agg", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS a FROM orders")
sql("sql_window", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3 FROM orders", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rn, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3 FROM orders")
sql("sql_qualify", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
sql("sql_order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 25 OFFSET 5")
for op in ("UNION", "UNION ALL", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL"):
    sql(f"sql_{op.lower().replace(' ', '_')}", f"SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 45 {op} SELECT l_suppkey AS k FROM lineitem WHERE l_discount > 0.08")
sql("sql_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_orderkey FROM lineitem) PIVOT (count(l_orderkey) FOR l_linestatus IN ('O' AS open, 'F' AS filled))", "SELECT l_returnflag, count(l_orderkey) FILTER (WHERE l_linestatus = 'O') AS open, count(l_orderkey) FILTER (WHERE l_linestatus = 'F') AS filled FROM lineitem GROUP BY l_returnflag")

# --- aggregates
for f in ("AVG", "STDDEV", "STDDEV_POP", "STDDEV_SAMP", "VARIANCE", "VAR_POP", "VAR_SAMP"):
    sql(f"fn_{f.lower()}", f"SELECT l_returnflag AS k, round(CAST({f}(l_quantity) AS DOUBLE), 6) AS v FROM lineitem GROUP BY l_returnflag")
sql("fn_sum", "SELECT l_returnflag AS k, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY l_returnflag")
for f in ("COUNT", "MAX", "MIN"):
    sql(f"fn_{f.lower()}", f"SELECT l_returnflag AS k, CAST({f}(l_partkey) AS BIGINT) AS v FROM lineitem GROUP BY l_returnflag")

# --- windows
_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"
for f in ("DENSE_RANK()", "RANK()", "ROW_NUMBER()", "NTILE(3)", "FIRST_VALUE(o_orderkey)", "LAST_VALUE(o_orderkey)", "LAG(o_orderkey)", "LEAD(o_orderkey, 2, 0)", "NTH_VALUE(o_orderkey, 2)"):
    sql(f"fn_{f.split('(')[0].lower()}", f"SELECT o_orderkey AS k, CAST({f} {_OVER} AS BIGINT) AS v FROM orders")

# --- conditional and text
scalar("coalesce", "c", "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')")
scalar("greatest", "p", "greatest(p_size, 25, NULL)", kind="BIGINT")
scalar("least", "p", "least(p_size, 25, NULL)", kind="BIGINT")
scalar("ifnull", "c", "ifnull(nullif(c_mktsegment, 'BUILDING'), 'none')")
scalar("nullif", "c", "nullif(c_mktsegment, 'MACHINERY')")
for f in ("char_length(c_name)", "length(c_name)", "octet_length(c_name)"):
    scalar(f.split("(")[0], "c", f, "octet_length(encode(c_name))" if f[0] == "o" else f, "BIGINT")
scalar("instr", "c", "instr(c_mktsegment, 'I')", kind="BIGINT")
scalar("locate", "c", "locate('U', c_mktsegment)", "instr(c_mktsegment, 'U')", "BIGINT")
scalar("chr", "p", "chr(64 + p_size % 26)")
scalar("concat", "c", "concat(c_name, '-', nullif(c_mktsegment, 'BUILDING'), concat('<', c_nationkey))")
scalar("concat_ws", "c", "concat_ws('/', c_name, NULL, c_mktsegment)")
for f in ("left(c_name, 4)", "right(c_name, 4)", "lower(c_name)", "upper(c_name)", "ltrim(concat('  ', c_name))", "rtrim(concat(c_name, '  '))", "trim(concat(' ', c_name, ' '))", "lpad(c_mktsegment, 12, '*')", "rpad(c_mktsegment, 12, '*')", "repeat(c_mktsegment, 2)", "replace(c_name, '0', 'o')", "reverse(c_name)", "substr(c_name, 3, 5)", "substring(c_name, 2, 6)"):
    scalar(f.split("(")[0], "c", f)
scalar("soundex", "c", "soundex(c_mktsegment)", oracle=False)

# --- mathematics
for f in ("acos(p_size / 100.0)", "asin(p_size / 100.0)", "atan(p_size)", "atan2(p_size, 3)", "cos(p_size)", "cot(p_size)", "ln(p_size)", "log10(p_size)", "sin(p_size)", "sqrt(p_size)", "tan(p_size)", "pow(p_size, 2)", "power(p_size, 0.5)"):
    scalar(f.split("(")[0], "p", f"round(CAST({f} AS DOUBLE), 6)", kind="DOUBLE")
scalar("log", "p", "round(log(p_size), 6)", kind="DOUBLE")
for f in ("abs(p_size - 25)", "ceil(p_retailprice)", "ceiling(p_retailprice)", "floor(p_retailprice)", "mod(p_partkey, 7)", "sign(p_size - 25)"):
    scalar(f.split("(")[0], "p", f, f.replace("mod(p_partkey, 7)", "p_partkey % 7"), "BIGINT")
scalar("round", "p", "round(CAST(p_retailprice AS DECIMAL(12,2)), 1)", kind="DECIMAL(12,1)")
scalar("trunc", "p", "trunc(p_retailprice - 1000)", kind="DOUBLE")
scalar("truncate", "p", "truncate(p_retailprice)", "trunc(p_retailprice)", "DOUBLE")

# --- dates
_D = "o_orderdate"
for f in ("day", "dayofmonth", "dayofyear", "hour", "minute", "month", "quarter", "year"):
    scalar(f, "o", f"{f}({_D})", kind="BIGINT")
scalar("dayofweek", "o", f"dayofweek({_D})", kind="BIGINT")
scalar("week", "o", f"week({_D})", kind="BIGINT")
scalar("date", "o", f"date({_D})", f"CAST({_D} AS DATE)", "DATE")
scalar("date_add", "o", f"date_add({_D}, 10)", f"CAST({_D} AS DATE) + 10", "DATE")
scalar("date_sub", "o", f"date_sub({_D}, 10)", f"CAST({_D} AS DATE) - 10", "DATE")
scalar("datediff", "o", f"datediff({_D}, DATE '1990-01-01')", f"datediff('day', DATE '1990-01-01', CAST({_D} AS DATE))", "BIGINT")
scalar("timestampdiff", "o", f"timestampdiff(DAY, TIMESTAMP_NTZ '1990-01-01 00:00:00', {_D})", f"datesub('day', TIMESTAMP '1990-01-01', {_D})", "BIGINT")
scalar("date_part", "o", f"date_part('YEAR', {_D})", f"date_part('year', {_D})", "BIGINT")
scalar("extract", "o", f"extract(MONTH FROM {_D})", kind="BIGINT")
scalar("last_day", "o", f"last_day({_D})", kind="DATE")
scalar("timestamp_trunc", "o", f"timestamp_trunc('MONTH', {_D})", f"date_trunc('month', {_D})", "DATE")

# --- JSON
scalar("json_extract", "e", "json_extract(props, '$.k')", "json_extract(props, '$.k')")
scalar("json_query", "e", "json_query(props, '$')", "replace(CAST(json_extract(props, '$') AS VARCHAR), ' ', '')")
scalar("json_value", "e", "json_value(props, '$.k')", "json_extract_string(props, '$.k')")
scalar("json_valid", "e", "json_valid(props)", kind="BOOLEAN")
scalar("json_type", "e", "json_type(props)")
scalar("json_array_length", "e", "json_array_length(concat('[', event_id, ', 1]'))", "json_array_length('[' || event_id || ', 1]')", "BIGINT")
scalar("json_array", "e", "json_array(event_id, json_array(event_type, event_id + 1), NULL)")
scalar("json_object", "e", "json_object('id', event_id, 'kind', upper(event_type), 'n', json_array(event_id % 3))")
scalar("json_contains", "e", "json_contains(concat('[\"', event_type, '\"]'), 'click')", "event_type = 'click'", "BOOLEAN")

# --- the golden questions' shapes, over lineitem, orders, customer and nation
_OK = "l_returnflag <> 'R' AND l_quantity > 0 AND l_extendedprice > 0"
_M = "CAST(l_extendedprice AS DECIMAL(12,2))"
_S = f"CAST(sum({_M}) AS DECIMAL(28,2))"
_ALL = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
sql("q_total_sales", f"SELECT {_S} AS sales, count(*) AS line_count, count(DISTINCT l_orderkey) AS invoices FROM lineitem WHERE {_OK}")
sql("q_distinct_dims", f"SELECT count(DISTINCT n_name) AS nations, count(DISTINCT c_custkey) AS customers FROM {_ALL} WHERE {_OK}")
sql("q_missing_share", f"SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS missing, round(CAST(100.0 * count(*) FILTER (WHERE o_orderkey IS NULL) / count(*) AS DOUBLE), 4) AS pct, CAST(sum(CASE WHEN o_orderkey IS NULL THEN {_M} ELSE 0 END) AS DECIMAL(28,2)) AS value FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'O') o ON l_orderkey = o_orderkey WHERE {_OK}")
sql("q_top1", f"SELECT n_name, {_S} AS sales FROM {_ALL} WHERE {_OK} GROUP BY n_name ORDER BY sales DESC NULLS LAST, n_name ASC NULLS LAST LIMIT 1")
sql("q_top5", f"SELECT l_partkey, {_S} AS sales FROM lineitem WHERE {_OK} GROUP BY l_partkey ORDER BY sales DESC NULLS LAST, l_partkey ASC NULLS LAST LIMIT 5")
sql("q_cancelled_counts", "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_quantity < 10) AS small FROM lineitem")
sql("q_weekend_weekday", f"SELECT CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS bucket, count(*) AS line_count, {_S} AS sales, count(DISTINCT o_orderkey) AS invoices, round(CAST(sum({_M}) AS DOUBLE) / count(DISTINCT o_orderkey), 4) AS average FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {_OK} GROUP BY 1")
sql("q_calendar_bands", f"SELECT CASE WHEN day(l_shipdate) BETWEEN 1 AND 10 THEN 'early' WHEN day(l_shipdate) BETWEEN 11 AND 20 THEN 'middle' ELSE 'late' END AS band, count(*) AS line_count, {_S} AS sales FROM lineitem WHERE {_OK} GROUP BY 1")
_DAYS = f"SELECT CAST(l_shipdate AS DATE) AS d, {_S} AS sales, count(*) AS line_count FROM lineitem WHERE {_OK} GROUP BY CAST(l_shipdate AS DATE)"
sql("q_date_endpoints", f"WITH days AS ({_DAYS}) SELECT d, sales, line_count FROM days WHERE d = (SELECT min(d) FROM days) OR d = (SELECT max(d) FROM days)")
sql("q_crosstab", "SELECT l_returnflag = 'R' AS returned, count(*) FILTER (WHERE l_quantity >= 25) AS many, count(*) FILTER (WHERE l_quantity < 25) AS few FROM lineitem GROUP BY 1")
sql("q_signed_vs_qualifying", f"SELECT CAST(sum(CASE WHEN l_returnflag = 'R' THEN -{_M} ELSE {_M} END) AS DECIMAL(28,2)) AS signed, CAST(sum(CASE WHEN {_OK} THEN {_M} ELSE 0 END) AS DECIMAL(28,2)) AS qualifying FROM lineitem")
_BY = f"SELECT l_orderkey, count(*) AS n, sum({_M}) AS s FROM lineitem WHERE {_OK} GROUP BY l_orderkey"
sql("q_invoice_buckets", f"SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' ELSE '4+' END AS bucket, count(*) AS invoices, CAST(sum(s) AS DECIMAL(28,2)) AS sales FROM ({_BY}) t GROUP BY 1")
sql("q_line_vs_invoice_avg", f"SELECT round(CAST(sum({_M}) AS DOUBLE) / count(*), 4) AS by_line, round(CAST(sum({_M}) AS DOUBLE) / count(DISTINCT l_orderkey), 4) AS by_invoice FROM lineitem WHERE {_OK}")
sql("q_top3_share", f"WITH n AS (SELECT n_name, sum({_M}) AS s FROM {_ALL} WHERE {_OK} GROUP BY n_name), r AS (SELECT n_name, s, row_number() OVER (ORDER BY s DESC, n_name) AS rk, sum(s) OVER () AS total FROM n) SELECT n_name, CAST(s AS DECIMAL(28,2)) AS sales, round(CAST(100 * s AS DOUBLE) / CAST(total AS DOUBLE), 4) AS pct FROM r WHERE rk <= 3")
sql("q_leading_item", f"SELECT l_suppkey, l_partkey, sales, line_count, q FROM (SELECT l_suppkey, l_partkey, {_S} AS sales, count(*) AS line_count, CAST(sum(l_quantity) AS DOUBLE) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_S} DESC, l_partkey) AS rn FROM lineitem WHERE {_OK} GROUP BY l_suppkey, l_partkey) t WHERE rn = 1")
for name, col, a, b in (("price", "l_extendedprice", 10000, 40000), ("quantity", "l_quantity", 10, 35)):
    sql(f"q_{name}_buckets", f"WITH t AS (SELECT CASE WHEN {col} < {a} THEN 'low' WHEN {col} < {b} THEN 'middle' ELSE 'high' END AS bucket, count(*) AS c, sum({_M}) AS s FROM lineitem WHERE {_OK} GROUP BY 1) SELECT bucket, c, CAST(s AS DECIMAL(28,2)) AS sales, round(CAST(100 * c AS DOUBLE) / CAST(sum(c) OVER () AS DOUBLE), 4) AS pct FROM t")
sql("q_conditional_missing", "SELECT o_orderpriority, count(*) AS c, round(CAST(100 * count(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) / count(*), 4) AS pct FROM orders GROUP BY o_orderpriority")
sql("q_eligibility", "SELECT count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(12,2))) AS DECIMAL(28,2)) AS total FROM supplier WHERE CAST(s_acctbal AS DECIMAL(12,2)) <= 5000.00")
