"""Exact decimal arithmetic beyond what Spark's 38 digits hold: results are exact or rejected.

Values travel as plain decimal text. The functions are scalar Python and are wrapped as
Arrow-batched functions only where a native decimal can't be wide enough.
"""

from __future__ import annotations

import operator
from decimal import Decimal, InvalidOperation
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeframe.errors import AnalysisError

INPUT_DIGITS, RESULT_DIGITS = 60, 120
_OPS = {"add": operator.add, "subtract": operator.sub, "multiply": operator.mul, "divide": operator.truediv}


def parse(text: str, digits: int = INPUT_DIGITS) -> Decimal:
    """A finite number of at most so many digits on either side of the point."""
    try:
        value = Decimal(text.strip())
    except InvalidOperation:
        raise AnalysisError("invalid_number") from None
    if not value.is_finite():
        raise AnalysisError("nonfinite_numeric_value")
    if len(value.as_tuple().digits) > digits or abs(value.adjusted()) > digits:
        raise AnalysisError("numeric_precision_limit")
    return value


def text_of(value: Fraction) -> str:
    """A fraction as decimal text; rejected if its digits never end or are too many."""
    scale = next((k for k in range(RESULT_DIGITS + 1) if 10**k % value.denominator == 0), None)
    if scale is None:
        rest = value.denominator
        for p in (2, 5):
            while rest % p == 0:
                rest //= p
        raise AnalysisError("nonterminating_decimal_result" if rest > 1 else "numeric_precision_limit")
    whole = abs(value.numerator) * (10**scale // value.denominator)
    if len(str(whole)) > RESULT_DIGITS:
        raise AnalysisError("numeric_precision_limit")
    digits = str(whole).rjust(scale + 1, "0")
    out = digits[:-scale] + "." + digits[-scale:] if scale else digits
    return "-" + out if value < 0 else out


def combine(action: str, a: str, b: str) -> str:
    x, y = (Fraction(parse(v, RESULT_DIGITS)) for v in (a, b))
    if action == "divide" and not y:
        raise AnalysisError("division_by_zero")
    return text_of(_OPS[action](x, y))


def combined(action: str, a: Column, b: Column) -> Column:
    """combine over columns of decimal text; null where either is."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else combine(action, p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    return run(a, b)


#: A number's digits from 10^-240 up, in limbs of 18 digits: all that RESULT_DIGITS allows on either side of the point.
LOWEST, LIMBS, WIDTH = -2 * RESULT_DIGITS, 21, 18


def limbs(text: Column) -> Column:
    """Decimal text as an array of whole numbers, the highest first: value = sum of limb * 10^(18 * place - 240). Nulls for null; other text fails."""
    plain = F.trim(text)
    part = lambda i: F.regexp_extract(plain, r"^([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{1,6}))?$", i)
    digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+", "")
    last = F.coalesce(part(4).try_cast("int"), F.lit(0)) - F.length(part(3))
    above = last + F.greatest(F.length(digits), F.lit(1)) - 1
    fails = F.when(~plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,6})?$"), F.raise_error(F.lit("invalid_number")).cast("string"))
    fails = fails.when((F.length(digits) > RESULT_DIGITS) | (F.abs(above) > RESULT_DIGITS), F.raise_error(F.lit("numeric_precision_limit")).cast("string"))
    aligned = fails.otherwise(F.lpad(F.concat(digits, F.repeat(F.lit("0"), last - LOWEST)), LIMBS * WIDTH, "0"))
    sign = F.when(part(1) == "-", F.lit(-1)).otherwise(F.lit(1))
    pieces = F.regexp_extract_all(aligned, F.lit(f"[0-9]{{{WIDTH}}}"), F.lit(0))
    return F.transform(pieces, lambda p: p.cast("long") * sign)


def summed(parts: Column) -> Column:
    """Aggregate: the exact sum of numbers in limbs as decimal text, null for no values.

    Each limb is a sum of its own, combined before the shuffle; carries are settled once a group.
    """

    @F.pandas_udf("string")
    def settled(sums: pd.Series) -> pd.Series:
        whole = lambda s: sum(int(v) * 10 ** (WIDTH * (LIMBS - 1 - i)) for i, v in enumerate(s))
        return pd.Series([None if s is None or s[0] is None else text_of(Fraction(whole(s), 10**-LOWEST)) for s in sums], dtype=object)

    return settled(F.array(*(F.sum(parts[i].cast("decimal(38,0)")) for i in range(LIMBS))))
