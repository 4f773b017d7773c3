import pytest

from lodeframe.errors import SqlPolicyError
from lodeframe.plans.policy import admit
from lodeframe.plans.run import run_sql

GOOD = [
    "SELECT a, sum(b) AS s FROM t WHERE c IN (1, 2) AND d LIKE 'x%' GROUP BY a HAVING sum(b) > 1 ORDER BY s DESC NULLS LAST LIMIT 5 OFFSET 1",
    "WITH x AS (SELECT a FROM t), y AS (SELECT a FROM x) SELECT * FROM y JOIN u ON y.a = u.a;",
    "SELECT CASE WHEN a BETWEEN 1 AND 2 THEN 'x' ELSE 'y' END, CAST(a AS DECIMAL(10,2)), try_cast(a AS int) FROM t",
    "SELECT a FROM t UNION ALL SELECT a FROM u EXCEPT SELECT a FROM t INTERSECT SELECT a FROM u",
    "SELECT row_number() OVER (PARTITION BY a ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t WHERE a > (SELECT avg(a) FROM u) AND b IN (SELECT b FROM u)",
    "SELECT extract(YEAR FROM d), trim(s), substring(s, 1, 2), first_value(a) OVER (ORDER BY b), timestampdiff(DAY, d, e), ceil(x), repeat(s, 3) FROM t",
    "SELECT ';' AS s FROM t -- a; comment",
    "SELECT count(*) FILTER (WHERE a > 1), count(DISTINCT b) FROM t GROUP BY ROLLUP (c, d)",
]
BAD = {
    "": "empty_sql", " ; ": "empty_sql", "SELECT " + "1," * 10001 + "1": "sql_too_large", "SELECT (a FROM t": "sql_parse_error", "SELECT 1; DROP TABLE t": "multiple_statements",
    "DROP TABLE t": "forbidden_statement", "INSERT INTO t SELECT 1": "forbidden_statement", "CREATE TABLE x AS SELECT 1": "forbidden_statement", "SET x = 1": "forbidden_statement",
    "SHOW TABLES": "not_readonly", "DESCRIBE t": "not_readonly", "SELECT * FROM VALUES (1)": "forbidden_statement", "SELECT explode(array(1))": "function_not_allowed",
    "SELECT /*+ BROADCAST(t) */ * FROM t": "forbidden_statement", "SELECT * FROM range(5)": "forbidden_statement", "SELECT * FROM t LATERAL VIEW explode(a) x AS y": "forbidden_statement",
    "SELECT public.count(a) FROM t": "qualified_function_forbidden", "SELECT rand() FROM t": "function_not_allowed", "SELECT reflect('java.lang.System', 'exit', 0)": "function_not_allowed",
    "SELECT a FROM t WHERE s RLIKE 'x'": "function_not_allowed", "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u)": "function_not_allowed", "SELECT current_date()": "function_not_allowed",
    "SELECT repeat(s, 100001) FROM t": "function_argument_limit", "SELECT repeat(s, n) FROM t": "function_argument_limit", "SELECT * FROM secret": "table_not_selected",
    "SELECT * FROM information_schema.tables": "system_schema_forbidden", "WITH t2 AS (SELECT * FROM hidden) SELECT * FROM t2": "table_not_selected",
    "SELECT * FROM (WITH z AS (SELECT a FROM t) SELECT * FROM z) q JOIN z ON 1 = 1": "table_not_selected", "SELECT '" + "x" * 4097 + "'": "literal_too_large",
    "SELECT IDENTIFIER('rand')() FROM t": "function_not_allowed", "SELECT IDENTIFIER('re' || 'flect')('java.lang.Math', 'abs', 1)": "function_not_allowed", "SELECT current_date FROM t": "function_not_allowed",
    "SELECT CURRENT_USER": "function_not_allowed", "SELECT any_value(a) FROM t": "function_not_allowed", "SELECT localtimestamp": "function_not_allowed", "SELECT * FROM IDENTIFIER('hidden')": "forbidden_statement",
    "SELECT * FROM t" + " JOIN u ON 1 = 1" * 33: "too_many_joins", "SELECT " + "(" * 60 + "1" + " + 1)" * 60 + " + -" * 0 + " FROM t WHERE " + "NOT " * 120 + "a": "query_too_complex",
}


@pytest.mark.parametrize("sql", GOOD)
def test_admits(spark, sql):
    assert admit(spark, sql, ["t", "u"])


@pytest.mark.parametrize("sql", BAD, ids=lambda s: s[:40])
def test_rejects(spark, sql):
    with pytest.raises(SqlPolicyError) as e:
        admit(spark, sql, ["t", "u"])
    assert e.value.code == BAD[sql] and "secret" not in str(e.value)


def test_executable_comment(spark):
    with pytest.raises(SqlPolicyError, match="executable_comment_forbidden"):
        admit(spark, "SELECT /*! 1 */ 2", dialect="mysql")


def test_limit_bounds_rows_not_input(spark):
    t = {"t": spark.range(100).selectExpr("id AS a")}
    assert run_sql(spark, "SELECT sum(a) AS s FROM t", t, max_rows=1).rows() == ([(4950,)], False)
    rows, cut = run_sql(spark, "SELECT a FROM t", t, max_rows=3).rows()
    assert len(rows) == 3 and cut


def test_shims(spark):
    t = {"t": spark.createDataFrame([('{"a": [1, 2]}', 2.7)], "j string, x double")}
    row = run_sql(spark, "SELECT json_extract(j, '$.a') AS a, json_valid(j) AS v, json_valid('{') AS w, json_type(j) AS k, truncate(-x) AS c FROM t", t).df.first()
    assert tuple(row) == ("[1,2]", True, False, "OBJECT", -2.0)


def test_calls_are_rewritten_where_they_stand(spark):
    t = {"t": spark.createDataFrame([("x", None, 100.0)], "a string, b string, n double")}
    row = run_sql(spark, "SELECT concat(a, b, concat(`a`, '(log(1)')) AS c, LOG (n) AS l, log(10, n) AS m, trunc(-n / 3) AS z, json_array(1, json_object('k', concat(a, 'y')), NULL) AS j, json_array() AS e FROM t -- log(n)", t).df.first()
    assert tuple(row) == ("xx(log(1)", 2.0, 2.0, -33.0, '[1,{"k":"xy"},null]', "[]")


def test_messages_say_nothing_of_the_query(spark):
    with pytest.raises(SqlPolicyError) as found:
        admit(spark, "SELECT (secret_column FROM hidden")
    assert str(found.value) == "sql_parse_error"
