from decimal import Decimal

import pytest

from lodeframe.errors import SqlPolicyError
from lodeframe.plans.run import run_sql

SUNDAY = "DATE '2026-03-01'"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("concat /* x */ ('a', 'b')", "ab"),
        ("concat -- x\n('a', NULL, concat/**/(1, 'b'))", "a1b"),
        ("trunc(1.789, 2)", Decimal("1.780")),
        ("trunc(-1.789)", Decimal("-1.000")),
        ("trunc(123456789012345678)", 123456789012345678),
        ("truncate((17), -1)", 10),
        ("trunc(trunc(2.75, 1) + trunc(1.5))", Decimal("3")),
        ("truncate(CAST(-0.5 AS DOUBLE))", 0.0),
        (f"dayofweek({SUNDAY})", 0),
        (f"extract(dow FROM {SUNDAY})", 0),
        (f"EXTRACT( DAYOFWEEK /* day */ FROM {SUNDAY}) + 1", 1),
        (f"date_part('dow', {SUNDAY})", 0),
        (f"date_part('year', {SUNDAY})", 2026),
        (f"extract(month FROM {SUNDAY})", 3),
        ("json_type('\"a\"')", "VARCHAR"),
        ("json_type('null')", "NULL"),
        ("json_type('-3')", "BIGINT"),
        ("json_type('3')", "UBIGINT"),
        ("json_type('1.5')", "DOUBLE"),
        ("json_type('[1]')", "ARRAY"),
        ("log(trunc(1000.5))", 3.0),
    ],
)
def test_calls_in_their_own_meaning(spark, text, want):
    assert run_sql(spark, f"SELECT {text} AS x", {}).df.collect()[0][0] == want


@pytest.mark.parametrize("text", ["concat(DISTINCT 'a')", "concat('a') OVER ()", "concat('a') FILTER (WHERE true)", "trunc(1.5, 1 + 1)", "trunc(1.5, 99)"])
def test_forms_that_have_no_meaning_are_rejected(spark, text):
    with pytest.raises(SqlPolicyError, match="function_argument_form"):
        run_sql(spark, f"SELECT {text} AS x", {})


def test_over_whole_tables(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    got = run_sql(spark, "SELECT extract(dow FROM l_shipdate) AS d, sum(trunc(l_quantity * 1.5)) AS q, count(*) AS n FROM lineitem GROUP BY extract(dow FROM l_shipdate)", {"lineitem": lines}).df.collect()
    rows = lines.select("l_shipdate", "l_quantity").collect()
    want = {}
    for at, q in rows:
        day = (at.weekday() + 1) % 7
        total, n = want.get(day, (0, 0))
        want[day] = (total + int(q * 1.5), n + 1)
    assert {r.d: (r.q, r.n) for r in got} == want
