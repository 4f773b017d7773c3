"""The declarative operators. Each takes a Frame and gives a Frame, or rejects with a code.

What an operator must know before it may go on (missing values, duplicate keys,
cardinalities) is asked for in one small aggregation; the data itself stays lazy.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from math import floor

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.errors import require
from lodeframe.frame import ORDER, Frame, missing
from lodeframe.functions import exact
from lodeframe.functions.quantiles import quantiles

_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_PATTERN = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%f": "SSSSSS"}


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def is_number(f: Frame, name: str) -> bool:
    kind = f.df.schema[name]
    return isinstance(kind.dataType, T.NumericType) or bool(kind.metadata.get("exact"))


def _typed(df: DataFrame, name: str) -> DataFrame:
    """Decimal text as the narrowest decimal that holds all values, or as exact text where 38 digits don't."""
    text = F.regexp_replace(F.trim(_c(name)), r"^[+-]|[eE].*$", "")
    whole, part = F.regexp_extract(text, r"^0*([0-9]*)", 1), F.regexp_extract(text, r"\.([0-9]*)$", 1)
    wide = _c(name).rlike("[eE]")
    n, s, e = df.agg(F.max(F.length(whole)), F.max(F.length(part)), F.max(wide)).first()
    n, s = n or 1, s or 0
    if not e and n + s <= 38:
        return df.withColumn(name, _c(name).cast(T.DecimalType(max(1, n + s), s)))
    return df.withMetadata(name, {"exact": True})


def convert(f: Frame, columns: list[str], data_type: str, date_format: str = "%Y-%m-%d") -> Frame:
    """Text to text, number (exact), integer or date; missing values become null."""
    f.need(*columns)
    df = f.df
    bad = []
    for c in columns:
        text = F.nullif(_c(c).cast("string"), F.lit(""))
        if data_type in ("number", "integer"):
            digits = F.length(F.regexp_replace(F.regexp_replace(text, "[eE].*$", ""), "[^0-9]", ""))
            bad += [F.count_if(~text.rlike(_NUMBER) & ~F.lower(F.trim(text)).rlike("^[+-]?(nan|inf(inity)?)$")), F.count_if(F.lower(F.trim(text)).rlike("^[+-]?(nan|inf(inity)?)$")), F.count_if(digits > exact.INPUT_DIGITS)]
        df = df.withColumn(c, text)
    if bad:
        found = df.agg(*(b.alias(str(i)) for i, b in enumerate(bad))).first()
        for i, code in enumerate(("invalid_number", "nonfinite_numeric_value", "numeric_precision_limit")):
            require(not any(found[i::3]), code)
        for c in columns:
            df = _typed(df, c)
    if data_type == "integer":
        whole = [_c(c) for c in columns]
        if all(isinstance(df.schema[c].dataType, T.DecimalType) for c in columns):
            require(not any(df.agg(*(F.count_if(x != F.floor(x)) for x in whole)).first()), "fractional_integer")
            for c in columns:
                p = df.schema[c].dataType
                df = df.withColumn(c, _c(c).cast(T.DecimalType(max(1, p.precision - p.scale), 0)))
                if p.precision - p.scale <= 18:
                    df = df.withColumn(c, _c(c).cast("long"))
        else:
            require(not any(df.agg(*(F.count_if(x.rlike(r"\.[0-9]*[1-9]")) for x in whole)).first()), "fractional_integer")
    if data_type == "date":
        pattern = date_format
        for a, b in _PATTERN.items():
            pattern = pattern.replace(a, b)
        parsed = {c: F.try_to_timestamp(_c(c), F.lit(pattern)) for c in columns}
        require(not any(df.agg(*(F.count_if(_c(c).isNotNull() & p.isNull()) for c, p in parsed.items())).first()), "invalid_date")
        df = df.withColumns(parsed)
    return f.became(df, operation="convert", converted=columns, data_type=data_type)


def _against(cell: Column, kind: T.DataType, comparison: str, number: Fraction) -> Column:
    """Compares a decimal or whole cell with a number exactly.

    Spark takes two decimals to one type, of 38 digits at the most, and so may round either. The number is therefore brought
    to the cell's own type: between two of its values, only the lower one counts, and beyond all of them every cell is on one side.
    """
    digits, scale = (kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else (19, 0)
    cell, below = cell.cast(T.DecimalType(digits, scale)), floor(number * 10**scale)
    met = below == number * 10**scale
    if not met and comparison in ("eq", "ne"):
        return F.lit(comparison == "ne")
    if abs(below) >= 10**digits:
        return F.lit(comparison in (("ne", "lt", "le") if below > 0 else ("ne", "gt", "ge")))
    given = F.lit(format(Decimal((int(below < 0), tuple(map(int, str(abs(below)))), -scale)), "f")).cast(T.DecimalType(digits, scale))
    comparison = comparison if met else {"lt": "le", "ge": "gt"}.get(comparison, comparison)
    return {"eq": cell == given, "ne": cell != given, "gt": cell > given, "ge": cell >= given, "lt": cell < given, "le": cell <= given}[comparison]


def filter_rows(f: Frame, column: str, comparison: str, value) -> Frame:
    """Rows whose cell compares so with the value: as numbers where the column is converted, else as text. Missing cells never do."""
    f.need(column)
    cell, given = _c(column), F.lit(str(value))
    if is_number(f, column):
        number = exact.parse(str(value))
        if isinstance(f.df.schema[column].dataType, T.StringType):
            other = F.lit(str(value))
            sign = exact.combined("subtract", cell, other)
            cell, given = F.when(sign.startswith("-"), -1).when(sign.rlike("[1-9]"), 1).otherwise(0), F.lit(0)
        elif isinstance(f.df.schema[column].dataType, T.FractionalType) and not isinstance(f.df.schema[column].dataType, T.DecimalType):
            given = F.lit(str(value).strip()).cast("double")
        else:
            return f.became(f.df.where(~missing(column) & _against(cell, f.df.schema[column].dataType, comparison, Fraction(number))), operation="filter", column=column, comparison=comparison)
    elif isinstance(f.df.schema[column].dataType, T.TimestampType):
        given = F.lit(str(value)).cast("timestamp")
    test = {"eq": cell == given, "ne": cell != given, "gt": cell > given, "ge": cell >= given, "lt": cell < given, "le": cell <= given}[comparison]
    return f.became(f.df.where(~missing(column) & test), operation="filter", column=column, comparison=comparison)


def missing_values(f: Frame, columns: list[str], policy: str, value=None) -> Frame:
    """reject, drop the rows, or fill with an explicit value."""
    f.need(*columns)
    counts = dict(zip(columns, f.df.agg(*(F.count_if(missing(c)) for c in columns)).first(), strict=True))
    require(policy != "reject" or not any(counts.values()), "missing_values_require_policy")
    df = f.df
    if policy == "drop":
        for c in columns:
            df = df.where(~missing(c))
    if policy == "fill":
        df = df.withColumns({c: F.when(missing(c), F.lit(value).cast(df.schema[c].dataType)).otherwise(_c(c)) for c in columns})
    return f.became(df, operation="missing", policy=policy, missing_counts=counts)


def duplicates(f: Frame, columns: list[str], policy: str) -> Frame:
    """reject, or keep the first row, in row order, of each key."""
    f.need(*columns)
    n, keys = f.df.groupBy(*(_c(c) for c in columns)).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    require(policy != "reject" or n == keys, "duplicate_identifiers")
    df = f.df
    if policy == "drop":
        first = Window.partitionBy(*(_c(c) for c in columns)).orderBy(ORDER)
        df = df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return f.became(df, operation="duplicates", policy=policy, duplicate_rows=n - keys)


def join(f: Frame, right: Frame, left_on: list[str], right_on: list[str], how: str = "inner", relationship: str = "many_to_one", limit: int | None = None) -> Frame:
    """Equi-join with a declared relationship, which is checked. ``limit`` bounds the estimated rows."""
    f.need(*left_on)
    right.need(*right_on)
    blank = lambda g, on: g.df.agg(F.count_if(F.greatest(*(missing(c).cast("int") for c in on), F.lit(0)) > 0)).first()[0]
    require(not blank(f, left_on) and not blank(right, right_on), "join_null_keys_require_cleaning")
    count = lambda g, on, name: g.df.groupBy(*(_c(c).alias(f"k{i}") for i, c in enumerate(on))).agg(F.count("*").alias(name))
    keys = [f"k{i}" for i in range(len(left_on))]
    for a, b in zip(left_on, right_on, strict=True):
        require(f.units.get(a) == right.units.get(b), "join_key_unit_mismatch")
        same = is_number(f, a) and is_number(right, b) or f.df.schema[a].dataType == right.df.schema[b].dataType
        require(same or f.df.isEmpty() or right.df.isEmpty(), "join_key_types_require_mapping")
    both = count(f, left_on, "l").join(count(right, right_on, "r"), keys, "full")
    stats = both.agg(*(F.coalesce(x, F.lit(0)) for x in (F.max("l"), F.max("r"), F.sum(F.when(F.col("r").isNull(), F.col("l"))), F.sum(F.when(F.col("l").isNull(), F.col("r"))), F.count("l"), F.count("r"), F.sum(F.col("l") * F.greatest(F.coalesce("r", F.lit(0)), F.lit(int(how == "left")))), F.sum("r")))).first()
    require(relationship not in ("one_to_one", "one_to_many") or stats[0] <= 1, "join_left_keys_not_unique")
    require(relationship not in ("one_to_one", "many_to_one") or stats[1] <= 1, "join_right_keys_not_unique")
    named = {c: f"{c}_right" if c in f.columns else c for c in right.columns}
    require(len(set(named.values())) == len(named) and not set(named.values()) & set(f.columns), "join_column_collision")
    require(limit is None or stats[6] <= limit, "join_expansion_limit")
    other = right.df.select(*(_c(c).alias(named[c]) for c in right.columns), _c(ORDER).alias("__right"))
    on = [_c(a) == _c(named[b]) for a, b in zip(left_on, right_on, strict=True)]
    df = f.df.join(other, on, how)
    # Left order, then right order, as one place.
    df = df.withColumn(ORDER, F.struct(F.col(ORDER).alias("l"), F.col("__right").alias("r"))).drop("__right")
    note = {"operation": "join", "relationship": relationship, "unmatched_left": stats[2], "unmatched_right": stats[3], "left_unique_keys": stats[4], "right_unique_keys": stats[5], "right_rows": stats[7]}
    if stats[2] or stats[3]:
        note["warning"] = "unmatched keys"
    if relationship == "many_to_many":
        note["warning"] = "many to many: rows may multiply"
    return f.became(df, (*f.columns, *named.values()), f.units | {named[c]: u for c, u in right.units.items()}, **note)


@dataclass(frozen=True)
class Metric:
    function: str
    column: str
    output: str


def _as_text(c: Column) -> Column:
    return c.cast("string")


def aggregate(f: Frame, columns: list[str], metrics: list[Metric]) -> Frame:
    """Exact sum, mean, min and max, and count; groups in order of first appearance. Missing values reject, but for count."""
    f.need(*columns, *(m.column for m in metrics))
    asked = [m for m in metrics if m.function != "count"]
    if asked:
        require(not any(f.df.agg(*(F.count_if(missing(m.column)) for m in asked)).first()), "aggregate_missing_values_require_policy")
    df, wide = f.df, {m.column for m in asked if isinstance(f.df.schema[m.column].dataType, T.StringType)}
    for c in wide:  # as the values come: converted here, exactly, where they weren't before
        df = convert(Frame(df, f.columns), [c], "number").df
    text = {m.column for m in asked if m.function in ("sum", "mean") and isinstance(df.schema[m.column].dataType, T.StringType)}
    df = df.withColumns({f"__limbs_{c}": exact.limbs(_c(c)) for c in text})
    out = [F.min(ORDER).alias(ORDER)]
    for m in metrics:
        c = _c(m.column)
        total = exact.summed(_c(f"__limbs_{m.column}")) if m.column in text else _as_text(F.sum(c))
        value = {
            "count": lambda: F.count(F.lit(1)),
            "sum": lambda t=total: F.coalesce(t, F.lit("0")),
            "mean": lambda t=total: t,
            "min": lambda c=c: F.min(c),
            "max": lambda c=c: F.max(c),
        }[m.function]()
        out.append(value.alias(m.output))
        if m.function == "mean":
            out.append(F.count(F.lit(1)).cast("string").alias(f"__n_{m.output}"))
    grouped = df.groupBy(*(_c(c) for c in columns)).agg(*out)
    for m in metrics:
        if m.function == "mean":
            grouped = grouped.withColumn(m.output, exact.combined("divide", _c(m.output), _c(f"__n_{m.output}"))).drop(f"__n_{m.output}")
        if m.function in ("sum", "mean"):
            grouped = _typed(grouped, m.output)
    units = {c: f.units[c] for c in columns if c in f.units} | {m.output: f.units[m.column] for m in asked if m.column in f.units}
    return f.became(grouped, (*columns, *(m.output for m in metrics)), units, operation="aggregate")


def derived_unit(action: str, a: str | None, b: str | None) -> str | None:
    """The unit of a product or a quotient; equal ones cancel to 1."""
    if not (a or b):
        return None
    a, b = a or "1", b or "1"
    if action == "multiply":
        return "*".join(u for u in (a, b) if u != "1") or "1"
    return "1" if a == b else a if b == "1" else f"{a}/{b}"


def derive(f: Frame, function: str, columns: list[str], output: str, unit: str | None = None, fiscal_start_month: int = 4) -> Frame:
    """A new column: add, subtract, multiply or divide two, exactly; or the year, month or fiscal year of a date."""
    f.need(*columns)
    require(output not in f.columns, "derived_column_already_exists")
    known = {f.units[c] for c in columns if f.units.get(c)}
    require(function not in ("add", "subtract") or len(known) <= 1, "derived_unit_mismatch")
    inferred = next(iter(known), None) if function in ("add", "subtract") else derived_unit(function, *(f.units.get(c) for c in columns)) if function in ("multiply", "divide") else None
    require(not (unit and inferred) or unit == inferred, "derived_unit_mismatch")
    require(not any(f.df.agg(*(F.count_if(missing(c)) for c in columns)).first()), "derive_missing_values_require_policy")
    df, note = f.df, {"operation": "derive", "function": function, "output": output}
    if function in ("year", "month", "fiscal_year"):
        c = _c(columns[0])
        require(isinstance(df.schema[columns[0]].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)), "date_conversion_required")
        if function == "fiscal_year":
            note["fiscal_label"] = "start year"
        df = df.withColumn(output, {"year": F.year(c), "month": F.month(c), "fiscal_year": F.year(c) - (F.month(c) < fiscal_start_month).cast("int")}[function])
    else:
        for x in {c for c in columns if isinstance(df.schema[c].dataType, T.StringType)}:
            df = convert(Frame(df, f.columns), [x], "number").df
        a, b = (df.schema[c].dataType for c in columns)
        wide = lambda t: t.precision if isinstance(t, T.DecimalType) else 19
        scale = lambda t: t.scale if isinstance(t, T.DecimalType) else 0
        native = not any(isinstance(t, (T.StringType, T.FractionalType)) and not isinstance(t, T.DecimalType) for t in (a, b))
        needed = wide(a) + wide(b) + 1 if function == "multiply" else max(wide(a) - scale(a), wide(b) - scale(b)) + max(scale(a), scale(b)) + 1
        if function != "divide" and native and needed <= 38:
            x, y = (_c(c).cast(T.DecimalType(wide(t), scale(t))) for c, t in zip(columns, (a, b), strict=True))
            df = df.withColumn(output, {"add": x + y, "subtract": x - y, "multiply": x * y}[function])
        else:
            df = _typed(df.withColumn(output, exact.combined(function, *(_as_text(_c(c)) for c in columns))), output)
    made = unit or inferred
    return f.became(df, (*f.columns, output), f.units | ({output: made} if made else {}), **note)


def melt(f: Frame, columns: list[str], value_columns: list[str]) -> Frame:
    """Rows for each value column, row by row: (ids, variable, value). The units must agree."""
    f.need(*columns, *value_columns)
    require(len({f.units.get(c) for c in value_columns}) <= 1, "reshape_unit_mismatch")
    kinds = {f.df.schema[c].dataType for c in value_columns}
    values = [_c(c) if len(kinds) == 1 else _c(c).cast("string") for c in value_columns]
    each = F.posexplode(F.array(*(F.struct(F.lit(n).alias("variable"), v.alias("value")) for n, v in zip(value_columns, values, strict=True)))).alias("__i", "__v")
    df = f.df.select(*(_c(c) for c in columns), F.col(ORDER), each)
    df = df.select(*(_c(c) for c in columns), F.struct(F.col(ORDER).alias("row"), F.col("__i").alias("i")).alias(ORDER), "__v.variable", "__v.value")
    units = {c: f.units[c] for c in columns if c in f.units} | ({"value": f.units[value_columns[0]]} if f.units.get(value_columns[0]) else {})
    return f.became(df, (*columns, "variable", "value"), units, operation="melt")


def pivot(f: Frame, columns: list[str], names: str, values: str) -> Frame:
    """A column for each label, in order; one value a cell, null where there is none. A null label is None."""
    f.need(*columns, names, values)
    label = F.coalesce(_c(names).cast("string"), F.lit("None"))
    cells = f.df.withColumn("__label", label)
    seen = cells.groupBy(*(_c(c) for c in columns), "__label").agg(F.count("*").alias("n")).groupBy("__label").agg(F.max("n").alias("n")).collect()
    labels = sorted(r["__label"] for r in seen)
    require(all(r["n"] == 1 for r in seen) and not set(labels) & set(columns), "pivot_duplicate_or_collision")
    order = f.df.groupBy(*(_c(c) for c in columns)).agg(F.min(ORDER).alias(ORDER))
    wide = cells.groupBy(*(_c(c) for c in columns)).pivot("__label", labels).agg(F.first(_c(values))) if labels else cells.select(*(_c(c) for c in columns)).distinct()
    same = [wide[f"`{c}`"].eqNullSafe(order[f"`{c}`"]) for c in columns]
    df = wide.join(order, same).select(*(wide[f"`{c}`"] for c in [*columns, *labels]), order[ORDER])
    units = {c: f.units[c] for c in columns if c in f.units} | ({x: f.units[values] for x in labels} if f.units.get(values) else {})
    return f.became(df, (*columns, *labels), units, operation="pivot", labels=labels)


QUARTILES = [0.25, 0.5, 0.75]


def statistics(f: Frame, columns: list[str], function: str = "describe") -> dict:
    """describe, correlation, regression (first column on the others) or outliers, in floating point."""
    f.need(*columns)
    gaps = f.df.agg(F.count("*"), *(F.count_if(missing(c)) for c in columns)).first()
    require(not any(gaps[1:]), "statistics_missing_values_require_policy")
    n = gaps[0]
    require(n > 0, "statistics_empty_sample")
    data = f.df.select(*(_c(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    xs = data.columns
    require(not any(data.agg(*(F.count_if(F.isnan(x) | F.col(x).isNull() | (F.abs(x) == float("inf"))) for x in xs)).first()), "statistics_nonfinite_conversion")
    if function == "describe":
        row = data.agg(*(a for x in xs for a in (F.avg(x), F.min(x), F.max(x), F.stddev_samp(x)))).first()
        cuts = {(r["name"], r["p"]): r["quantile"] for r in quantiles(data, {x: F.col(x) for x in xs}, QUARTILES).collect()}
        return {c: {"count": n, "mean": row[4 * i], "min": row[4 * i + 1], "max": row[4 * i + 2], "std_sample": row[4 * i + 3] if n > 1 else None, "quartiles": [cuts[xs[i], p] for p in QUARTILES]} for i, c in enumerate(columns)}
    if function == "correlation":
        require(n >= 3, "statistics_insufficient_sample")
        k = len(xs)
        row = data.agg(*(F.corr(a, b) for a in xs for b in xs)).first()
        clean = [None if v is None or np.isnan(v) else float(v) for v in row]
        return {"correlation": [clean[i * k : i * k + k] for i in range(k)]}
    if function == "regression":
        require(n > len(columns) and len(columns) >= 2, "regression_insufficient_sample")
        # Centred sums of products are all that the fit needs: one row, however many rows there are.
        k = len(xs)
        means = np.array(data.agg(*(F.avg(x) for x in xs)).first())
        centred = data.select(*((F.col(x) - float(m)).alias(x) for x, m in zip(xs, means, strict=True)))
        s = np.array(centred.agg(*(F.sum(F.col(a) * F.col(b)) for a in xs for b in xs)).first()).reshape(k, k)
        scale = np.sqrt(np.maximum(np.diag(s)[1:], 1e-300))
        inner = s[1:, 1:] / np.outer(scale, scale)
        require(np.linalg.matrix_rank(inner, tol=1e-10) == k - 1, "regression_rank_deficient")
        slopes = np.linalg.solve(inner, s[1:, 0] / scale) / scale
        r2 = float(slopes @ s[1:, 0] / s[0, 0]) if s[0, 0] else None
        return {"intercept": float(means[0] - slopes @ means[1:]), "coefficients": slopes.tolist(), "r_squared": r2}
    require(function == "outliers", "unknown_statistic")
    cuts = {r["p"]: r["quantile"] for r in quantiles(data, {"x": F.col(xs[0])}, QUARTILES).collect()}
    low, high = cuts[0.25], cuts[0.75]
    spread = 1.5 * (high - low)
    lower, upper = low - spread, high + spread
    count = data.where((F.col(xs[0]) < lower) | (F.col(xs[0]) > upper)).count()
    return {"method": "Tukey 1.5 IQR", "column": columns[0], "count": count, "lower": lower, "upper": upper}


def bounds(f: Frame, rows: int, cells: int) -> Frame:
    """Rejects a frame of more rows, or cells, than given: a guard rail for callers that want one."""
    n = f.df.limit(rows + 1).count()
    require(n <= rows and n * len(f.columns) <= cells, "analysis_expansion_limit")
    return f
