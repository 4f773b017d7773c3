"""SQL names that Spark lacks, or means otherwise: inlined SQL functions of the session, and calls rewritten where they stand.

None of them runs Python. ``log`` of one argument is to the base of 10, ``concat`` leaves nulls
out (its arguments are text or become it), ``trunc`` and ``truncate`` cut a number of whatever type, which it keeps, after
none or a given number of digits, Sunday is day 0 of the week wherever it is asked for, and ``json_array`` and ``json_object``
take values of any types.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from lodeframe.errors import SqlPolicyError, require

_JSON_TYPE = """
    CASE regexp_extract(schema_of_variant(try_parse_json(j)), '^[A-Z]+', 0) WHEN 'STRING' THEN 'VARCHAR' WHEN 'VOID' THEN 'NULL' WHEN 'DECIMAL' THEN 'DOUBLE'
    WHEN 'FLOAT' THEN 'DOUBLE' WHEN 'BIGINT' THEN if(startswith(ltrim(j), '-'), 'BIGINT', 'UBIGINT') ELSE regexp_extract(schema_of_variant(try_parse_json(j)), '^[A-Z]+', 0) END"""
_DEFINED = {
    "lodeframe_dayofweek(d TIMESTAMP)": ("INT", "dayofweek(d) - 1"),
    "week(d TIMESTAMP)": ("INT", "weekofyear(d)"),
    "timestamp_trunc(unit STRING, t TIMESTAMP)": ("TIMESTAMP", "date_trunc(unit, t)"),
    "json_extract(j STRING, p STRING)": ("STRING", "get_json_object(j, p)"),
    "json_query(j STRING, p STRING)": ("STRING", "get_json_object(j, p)"),
    "json_value(j STRING, p STRING)": ("STRING", "CASE WHEN left(trim(get_json_object(j, p)), 1) NOT IN ('{', '[') THEN get_json_object(j, p) END"),
    "json_valid(j STRING)": ("BOOLEAN", "try_parse_json(j) IS NOT NULL"),
    "json_type(j STRING)": ("STRING", _JSON_TYPE),
    "json_contains(j STRING, x STRING)": ("BOOLEAN", "array_contains(from_json(j, 'array<string>'), x)"),
}

#: By name: what stands for it with that number of arguments.
_OTHER = {"LOG": (1, "log10"), "DAYOFWEEK": (1, "lodeframe_dayofweek")}
REWRITTEN = frozenset((*_OTHER, "CONCAT", "TRUNC", "TRUNCATE", "DATE_PART", "EXTRACT", "JSON_ARRAY", "JSON_OBJECT"))
_GAP = r"(?:\s|/\*.*?\*/|--[^\n]*\n)*"
_HEAD = re.compile(rf"`?\w+`?{_GAP}\(", re.S)
_DAY = re.compile(rf"\w+{_GAP}\({_GAP}(?:dow|dayofweek){_GAP}\bfrom\b", re.S | re.I)
_COMMENT = re.compile(r"/\*.*?\*/|--[^\n]*", re.S)


def _cutting(text: str, args: list[tuple[int, int]], head: int) -> str | None:
    """What follows the number in a call that cuts it; None if the call cuts no number. One argument may stand in brackets."""
    unit = "1"
    if len(args) == 2:
        digits = text[slice(*args[1])].strip()
        if digits[:1] in "'\"":
            return None
        require(bool(re.fullmatch(r"-?\d{1,2}", digits)) and abs(int(digits)) <= 18, "function_argument_form", SqlPolicyError)
        n = int(digits)
        unit = "1" if n == 0 else "0." + "0" * (n - 1) + "1" if n > 0 else "1" + "0" * -n
    brackets = ")" * _COMMENT.sub("", text[head : args[0][0]]).count("(")
    # A double between -1 and 0 is cut to minus zero.
    return f"{brackets}), lodeframe_x -> if(lodeframe_x < 0, -(-lodeframe_x - -lodeframe_x % {unit}), lodeframe_x - lodeframe_x % {unit})), 1)"


def rewritten(text: str, calls: list[tuple[str, list[tuple[int, int]], int, int]]) -> str:
    """The text with such calls put into Spark's words; outer calls come before those within them."""
    heads: dict[int, tuple[int, str]] = {}
    before: dict[int, str] = {}
    after: dict[int, str] = {}

    def around(a: int, b: int, left: str, right: str) -> None:
        before[a] = before.get(a, "") + left
        after[b] = right + after.get(b, "")

    documents = {(start, end) for name, _, start, end in calls if name.startswith("JSON_")}
    for name, args, start, end in calls:
        if name == "EXTRACT":
            if day := _DAY.match(text, start):
                heads[start] = (day.end(), "lodeframe_dayofweek(")
            continue
        head = _HEAD.match(text, start).end()
        if args:
            # Words before the first argument or after the last are modifiers, which a rewritten call hasn't.
            plain = not re.match(r"\s*(DISTINCT|ALL)\b", _COMMENT.sub(" ", text[head : args[0][0]]), re.I) and not _COMMENT.sub(" ", text[args[-1][1] : end]).strip(") \t\r\n")
            require(plain, "function_argument_form", SqlPolicyError)
        if name in ("TRUNC", "TRUNCATE"):
            if len(args) in (1, 2) and (rest := _cutting(text, args, head)):
                heads[start] = (head, "element_at(transform(array(")
                heads[args[0][1]] = (end, rest)
        elif name == "DATE_PART":
            if len(args) == 2 and text[slice(*args[0])].strip("'\" ").lower() in ("dow", "dayofweek"):
                heads[start] = (text.index(",", args[0][1]) + 1, "lodeframe_dayofweek(")
        elif name in _OTHER and len(args) == _OTHER[name][0]:
            heads[start] = (head, _OTHER[name][1] + "(")
        elif name == "CONCAT" and args:
            heads[start] = (head, "concat_ws('', ")
        elif name.startswith("JSON_"):
            heads[start] = (head, "to_json(array(" if name == "JSON_ARRAY" else "to_json(map(")
            for i, (a, b) in enumerate(args):
                if (a, b) in documents:
                    around(a, b, "parse_json(", ")")
                else:
                    around(a, b, "CAST(", " AS STRING)" if name == "JSON_OBJECT" and i % 2 == 0 else " AS VARIANT)")
            after[end] = ")" + after.get(end, "")
    out, at = [], 0
    for place in sorted({*heads, *before, *after}):
        out += [text[at:place], after.get(place, ""), before.get(place, "")]
        at = place
        if place in heads:
            at, new = heads[place]
            out.append(new)
    return "".join([*out, text[at:]])


def register(spark: SparkSession) -> None:
    for head, (kind, body) in _DEFINED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
