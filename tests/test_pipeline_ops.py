from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.errors import AnalysisError
from lodeframe.frame import ORDER, Frame
from lodeframe.operators import pipeline as p
from lodeframe.plans.analyze import analyze


def frame(spark, rows, schema, units=None):
    return Frame.of(spark.createDataFrame(rows, schema).coalesce(1), units)


def rows(f):
    return [tuple(r) for r in f.df.orderBy(ORDER).select(*f.columns).collect()]


def code(call):
    with pytest.raises(AnalysisError) as e:
        call()
    return e.value.code


def test_sums_stay_exact(spark):
    f = p.convert(frame(spark, [("a", "9007199254740993.01"), ("b", "0.02")], "id string, amount string"), ["amount"], "number")
    out = p.aggregate(f, [], [p.Metric("sum", "amount", "total"), p.Metric("count", "id", "n")])
    assert rows(out) == [(Decimal("9007199254740993.03"), 2)]


def test_beyond_38_digits(spark):
    nines = "9" * 60
    f = p.convert(frame(spark, [(nines, nines)], "a string, b string"), ["a", "b"], "number")
    assert rows(p.derive(f, "multiply", ["a", "b"], "c"))[0][2] == str(int(nines) ** 2)
    assert rows(p.aggregate(f, [], [p.Metric("sum", "a", "s")])) == [(nines,)]
    assert code(lambda: p.convert(frame(spark, [("9" * 61,)], "a string"), ["a"], "number")) == "numeric_precision_limit"
    assert code(lambda: p.convert(frame(spark, [("nan",)], "a string"), ["a"], "number")) == "nonfinite_numeric_value"


def test_quotients_end_or_are_rejected(spark):
    f = p.convert(frame(spark, [("1", "8")], "a string, b string"), ["a", "b"], "number")
    assert rows(p.derive(f, "divide", ["a", "b"], "c"))[0][2] == Decimal("0.125")
    g = p.convert(frame(spark, [("1", "3")], "a string, b string"), ["a", "b"], "number")
    with pytest.raises(Exception, match="nonterminating_decimal_result"):
        p.derive(g, "divide", ["a", "b"], "c")
    with pytest.raises(Exception, match="division_by_zero"):
        p.derive(p.convert(frame(spark, [("1", "0")], "a string, b string"), ["a", "b"], "number"), "divide", ["a", "b"], "c")


def test_missing_and_duplicates(spark):
    f = frame(spark, [("a", "1"), ("a", ""), ("b", None)], "id string, amount string")
    assert code(lambda: p.missing_values(f, ["amount"], "reject")) == "missing_values_require_policy"
    assert rows(p.missing_values(f, ["amount"], "drop")) == [("a", "1")]
    assert [r[1] for r in rows(p.missing_values(f, ["amount"], "fill", "0"))] == ["1", "0", "0"]
    assert code(lambda: p.duplicates(f, ["id"], "reject")) == "duplicate_identifiers"
    kept = p.duplicates(f, ["id"], "drop")
    assert rows(kept) == [("a", "1"), ("b", None)] and kept.notes[-1]["duplicate_rows"] == 1


def test_integers_and_dates(spark):
    f = frame(spark, [("3.0", "2026-03-31"), ("4", "2026-04-01"), (None, "")], "n string, d string")
    assert [r[0] for r in rows(p.convert(f, ["n"], "integer"))] == [3, 4, None]
    assert code(lambda: p.convert(frame(spark, [("1.5",)], "n string"), ["n"], "integer")) == "fractional_integer"
    d = p.missing_values(p.convert(f, ["d"], "date"), ["d"], "drop")
    assert [r[-1] for r in rows(p.derive(d, "fiscal_year", ["d"], "fy"))] == [2025, 2026]
    assert code(lambda: p.derive(p.missing_values(f, ["n"], "drop"), "year", ["n"], "y")) == "date_conversion_required"


def test_filter_goes_by_type(spark):
    f = frame(spark, [("10",), ("9",), ("",), (None,)], "n string")
    assert rows(p.filter_rows(f, "n", "lt", "9")) == [("10",)]
    assert rows(p.filter_rows(p.convert(f, ["n"], "number"), "n", "ge", "9.5")) == [(Decimal(10),)]


def test_filter_rounds_neither_side(spark):
    """A cell within half a unit of the number's last digit is on its own side, whatever the digits of both."""
    f = p.convert(frame(spark, [("200000.00",), ("200000.30",), ("199999.99",)], "n string"), ["n"], "number")
    assert rows(p.filter_rows(f, "n", "le", "200000")) == [(Decimal("200000.00"),), (Decimal("199999.99"),)]
    compare = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "ge": "__ge__", "lt": "__lt__", "le": "__le__"}
    numbers = ["200000", "2e5", "199999.995", "-0.01", "-0.005", "1e-40", "1" + "0" * 45, "-1e45", "9" * 38, "1.5"]
    cells = {T.DecimalType(8, 2): ["200000.00", "200000.49", "199999.99", "-0.01"], T.DecimalType(38, 0): ["9" * 38, "-" + "9" * 38, "1"], T.LongType(): ["1", "2", str(-(2**63))]}
    asked = [(c, n) for c in compare for n in numbers]
    for kind, texts in cells.items():
        tests = [p._against(F.col("c"), kind, c, Fraction(n)).alias(str(i)) for i, (c, n) in enumerate(asked)]
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").cast(kind).alias("c")).select("t", *tests)
        for r in df.collect():
            assert list(r[1:]) == [getattr(Decimal(r.t), compare[c])(Decimal(n)) for c, n in asked], r.t


def test_join_contracts(spark):
    left = frame(spark, [("a", "1"), ("a", "2"), ("c", "3")], "id string, amount string", {"amount": "INR"})
    right = frame(spark, [("a", "x"), ("b", "y")], "id string, label string")
    out = p.join(left, right, ["id"], ["id"], "left")
    assert rows(out) == [("a", "1", "a", "x"), ("a", "2", "a", "x"), ("c", "3", None, None)]
    assert out.columns == ("id", "amount", "id_right", "label") and out.units == {"amount": "INR"}
    assert {k: out.notes[-1][k] for k in ("unmatched_left", "unmatched_right")} == {"unmatched_left": 1, "unmatched_right": 1}
    assert code(lambda: p.join(left, right, ["id"], ["id"], relationship="one_to_one")) == "join_left_keys_not_unique"
    assert code(lambda: p.join(right, left, ["id"], ["id"])) == "join_right_keys_not_unique"
    assert code(lambda: p.join(left, frame(spark, [(None, "x")], "id string, label string"), ["id"], ["id"])) == "join_null_keys_require_cleaning"
    assert code(lambda: p.join(left, frame(spark, [(1, "x")], "id long, label string"), ["id"], ["id"])) == "join_key_types_require_mapping"
    assert code(lambda: p.join(left, right, ["id"], ["id"], limit=1)) == "join_expansion_limit"
    assert code(lambda: p.join(left, right, ["nope"], ["id"])) == "unknown_column"


def test_reshape(spark):
    f = frame(spark, [("r1", "1", "2"), ("r2", "3", "4")], "id string, a string, b string")
    tall = p.melt(f, ["id"], ["a", "b"])
    assert rows(tall) == [("r1", "a", "1"), ("r1", "b", "2"), ("r2", "a", "3"), ("r2", "b", "4")]
    assert rows(p.pivot(tall, ["id"], "variable", "value")) == [("r1", "1", "2"), ("r2", "3", "4")]
    assert code(lambda: p.pivot(frame(spark, [("r", "a", "1"), ("r", "a", "2")], "id string, variable string, value string"), ["id"], "variable", "value")) == "pivot_duplicate_or_collision"
    assert code(lambda: p.melt(Frame.of(f.result(), {"a": "INR"}), ["id"], ["a", "b"])) == "reshape_unit_mismatch"


def test_units(spark):
    f = p.convert(frame(spark, [("2", "3")], "a string, b string", {"a": "INR", "b": "kg"}), ["a", "b"], "number")
    assert p.derive(f, "multiply", ["a", "b"], "c").units["c"] == "INR*kg"
    assert p.derive(f, "divide", ["a", "a"], "c").units["c"] == "1"
    assert code(lambda: p.derive(f, "add", ["a", "b"], "c")) == "derived_unit_mismatch"


def test_statistics(spark):
    f = frame(spark, [(1.0 + 2 * x, float(x)) for x in range(1, 6)], "y double, x double")
    fit = p.statistics(f, ["y", "x"], "regression")
    assert fit["intercept"] == pytest.approx(1) and fit["coefficients"] == pytest.approx([2]) and fit["r_squared"] == pytest.approx(1)
    assert p.statistics(frame(spark, [(float(v),) for v in (1, 2, 2, 3, 100)], "v double"), ["v"], "outliers")["count"] == 1
    assert p.statistics(f, ["x"])["x"]["quartiles"] == [2, 3, 4]
    assert code(lambda: p.statistics(f, ["x"], "regression")) == "regression_insufficient_sample"
    assert code(lambda: p.statistics(frame(spark, [(1.0, 2.0, 4.0), (2.0, 3.0, 6.0), (3.0, 1.0, 2.0), (1.0, 5.0, 10.0)], "y double, a double, b double"), ["y", "a", "b"], "regression")) == "regression_rank_deficient"
    assert code(lambda: p.statistics(frame(spark, [], "v double"), ["v"])) == "statistics_empty_sample"


def test_empty_frames_keep_their_schema(spark):
    f = frame(spark, [], "id string, amount string")
    out = p.aggregate(p.convert(f, ["amount"], "number"), [], [p.Metric("count", "id", "n"), p.Metric("sum", "amount", "s"), p.Metric("min", "amount", "least")])
    assert rows(out) == [(0, Decimal(0), None)]
    assert code(lambda: p.filter_rows(f, "nope", "eq", "1")) == "unknown_column"


def test_eligibility_golden(spark):
    data = [("APP-001", "S1", "active", "180000.00", "10000.00"), ("APP-002", "S1", "active", "200000.00", "15000.00"), ("APP-003", "S1", "active", "200000.01", "9000.01"), ("APP-004", "S1", "inactive", "120000.00", "8000.00"), ("APP-005", "S2", "active", "150000.00", "5000.50")]
    f = frame(spark, data, "application_id string, scheme_id string, scheme_status string, annual_income_inr string, grant_amount_inr string", {"grant_amount_inr": "INR"})
    regions = frame(spark, [(d[0], r) for d, r in zip(data, ["North", "North", "South", "South", "West"], strict=True)], "application_id string, region string")
    on = {"frame": "a"}
    run = analyze({"a": f, "r": regions}, [
        on | {"kind": "missing", "columns": ["application_id"], "policy": "reject"},
        on | {"kind": "duplicates", "columns": ["application_id"], "policy": "reject"},
        on | {"kind": "join", "columns": ["application_id"], "right_frame": "r", "right_on": ["application_id"], "relationship": "one_to_one"},
        on | {"kind": "convert", "columns": ["annual_income_inr", "grant_amount_inr"], "data_type": "number"},
        on | {"kind": "filter", "column": "annual_income_inr", "comparison": "le", "value": "200000.00"},
        on | {"kind": "filter", "column": "scheme_id", "comparison": "eq", "value": "S1"},
        on | {"kind": "filter", "column": "scheme_status", "comparison": "eq", "value": "active"},
        on | {"kind": "aggregate", "columns": ["region"], "metrics": [{"function": "count", "column": "application_id", "output": "n"}, {"function": "sum", "column": "grant_amount_inr", "output": "total"}]},
    ])
    assert rows(run.frames["a"]) == [("North", 2, Decimal("25000.00"))]
    assert run.frames["a"].units == {"total": "INR"}
