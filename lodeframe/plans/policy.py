"""Admission of read-only SQL: Spark's parser makes the plan, and a walk over it admits or rejects.

The walk sees the plan before analysis, so no table is touched by a rejected query. It
uses the session's parser through the JVM gateway, which a Spark Connect session lacks;
nothing else in the library does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from lodeframe.errors import SqlPolicyError, require
from lodeframe.functions import dialect

# The functions that a query may call, by category.
FUNCTIONS = frozenset(
    """
    AVG COUNT MAX MIN STDDEV STDDEV_POP STDDEV_SAMP SUM VARIANCE VAR_POP VAR_SAMP
    DENSE_RANK FIRST_VALUE LAG LAST_VALUE LEAD NTH_VALUE NTILE RANK ROW_NUMBER
    COALESCE GREATEST IFNULL LEAST NULLIF
    CHAR_LENGTH CHR CONCAT CONCAT_WS INSTR LEFT LENGTH LOCATE LOWER LPAD LTRIM OCTET_LENGTH REPEAT REPLACE
    REVERSE RIGHT RPAD RTRIM SOUNDEX SUBSTR SUBSTRING TRIM UPPER
    ABS ACOS ASIN ATAN ATAN2 CEIL CEILING COS COT FLOOR LN LOG LOG10 MOD POW POWER ROUND SIGN SIN SQRT TAN
    TRUNCATE TRUNC
    DATE DATEDIFF DATE_ADD DATE_PART DATE_SUB DAY DAYOFMONTH DAYOFWEEK DAYOFYEAR EXTRACT HOUR LAST_DAY MINUTE
    MONTH QUARTER TIMESTAMPDIFF TIMESTAMP_TRUNC WEEK YEAR
    JSON_ARRAY JSON_ARRAY_LENGTH JSON_CONTAINS JSON_EXTRACT JSON_OBJECT JSON_QUERY JSON_TYPE JSON_VALID JSON_VALUE
    IF
    """.split()
)
# Schemas that are no one's data.
SYSTEM_SCHEMAS = frozenset("information_schema mysql performance_schema pg_catalog pg_toast sys".split())
CHARACTERS, NODES, DEPTH, JOINS, LITERAL, REPEATS = 20_000, 20_000, 100, 32, 4_096, 100_000

_RELATIONAL = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect UnresolvedWith "
    "SubqueryAlias UnresolvedRelation UnresolvedHaving OneRowRelation WithWindowDefinition UnresolvedSubqueryColumnAliases Pivot "
    "UnionLoop UnionLoopRef AsOfJoin UnresolvedOrderBy".split()
)
#: Expressions that the parser makes of its own, by the name of the function that they stand for; the rest are operators.
_NAMED = {
    "First": "FIRST_VALUE", "Last": "LAST_VALUE", "StringTrim": "TRIM", "StringTrimLeft": "LTRIM", "StringTrimRight": "RTRIM",
    "Extract": "EXTRACT", "TimestampDiff": "TIMESTAMPDIFF", "Substring": "SUBSTRING", "StringLocate": "LOCATE", "Ceil": "CEIL", "Floor": "FLOOR",
    "DateDiff": "DATEDIFF", "Overlay": "OVERLAY", "TimestampAdd": "TIMESTAMPADD", "CurrentDate": "CURRENT_DATE", "CurrentTimestamp": "CURRENT_TIMESTAMP",
    "CurrentUser": "CURRENT_USER", "LocalTimestamp": "LOCALTIMESTAMP", "CurrentTime": "CURRENT_TIME", "Exists": "EXISTS", "RLike": "REGEXP_LIKE", "LambdaFunction": "LAMBDA",
    "AnyValue": "ANY_VALUE", "ExpressionWithUnresolvedIdentifier": "IDENTIFIER", "PlanWithUnresolvedIdentifier": "IDENTIFIER", "NamedParameter": "PARAMETER", "PosParameter": "PARAMETER",
    "ScalarSubquery": "", "ListQuery": "", "CreateNamedStruct": "STRUCT", "NamedStruct": "STRUCT",
}
# Functions that are called without brackets, so that they look like columns.
_BARE = frozenset("CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER LOCALTIME LOCALTIMESTAMP SESSION_USER USER".split())
#: Operators that the parser writes as functions.
_OPERATORS = frozenset(("BETWEEN",))
_CHANGES = re.compile(r"(Insert|Delete|Update|Merge|Create|Drop|Alter|Truncate|Set|Reset|Use|Cache|Uncache|Analyze|Load|Replace|Add|Refresh|Repair|Rename|Comment|Call|Execute|Declare|Recover|Optimize)")


def _each(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _span(e) -> tuple[int, int]:
    """Where an expression stands in the text, its end exclusive."""
    return e.origin().startIndex().get(), e.origin().stopIndex().get() + 1


def _statements(sql: str) -> int:
    """Number of statements between semicolons that stand outside quotes and comments."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", "x", sql, flags=re.S)
    return sum(bool(s.strip()) for s in bare.split(";"))


class _Walk:
    def __init__(self, allowed: frozenset[str] | None):
        self.allowed, self.nodes, self.joins = allowed, 0, 0
        #: (name, arguments, from, to) of the calls whose meaning here isn't Spark's; an argument is (from, to).
        self.calls: list[tuple[str, list[tuple[int, int]], int, int]] = []

    def count(self, depth: int) -> None:
        self.nodes += 1
        require(self.nodes <= NODES and depth <= DEPTH, "query_too_complex", SqlPolicyError)

    def plan(self, node, ctes: frozenset[str], depth: int) -> None:
        self.count(depth)
        kind = _kind(node)
        require(kind in _RELATIONAL, "forbidden_statement", SqlPolicyError)
        if kind in ("Join", "AsOfJoin"):
            self.joins += 1
            require(self.joins <= JOINS, "too_many_joins", SqlPolicyError)
        if kind == "UnresolvedRelation":
            self.table(list(_each(node.multipartIdentifier())), ctes)
        if kind == "UnresolvedWith":
            for cte in _each(node.cteRelations()):
                own = ctes | {cte._1().casefold()} if node.allowRecursion() else ctes
                self.plan(cte._2(), own, depth + 1)
                ctes = ctes | {cte._1().casefold()}
        for e in _each(node.expressions()):
            self.expression(e, ctes, depth + 1)
        for child in _each(node.children()):
            self.plan(child, ctes, depth + 1)

    def table(self, parts: list[str], ctes: frozenset[str]) -> None:
        require(not any(p.lower() in SYSTEM_SCHEMAS for p in parts[:-1]), "system_schema_forbidden", SqlPolicyError)
        if len(parts) == 1 and parts[0].casefold() in ctes:
            return
        require(self.allowed is None or ".".join(parts) in self.allowed, "table_not_selected", SqlPolicyError)

    def expression(self, e, ctes: frozenset[str], depth: int) -> None:
        self.count(depth)
        kind = _kind(e)
        if kind == "UnresolvedFunction":
            self.function([str(p) for p in _each(e.nameParts())], e)
        elif kind in _NAMED:
            require(not _NAMED[kind] or _NAMED[kind] in FUNCTIONS, "function_not_allowed", SqlPolicyError)
        elif kind == "UnresolvedAttribute":
            parts = [str(p) for p in _each(e.nameParts())]
            require(len(parts) > 1 or parts[0].upper() not in _BARE, "function_not_allowed", SqlPolicyError)
        elif kind == "Literal" and e.value() is not None and e.dataType().typeName() == "string":
            require(len(e.value().toString()) <= LITERAL, "literal_too_large", SqlPolicyError)
        if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
            self.plan(e.plan(), ctes, depth + 1)
        for child in _each(e.children()):
            self.expression(child, ctes, depth + 1)

    def function(self, names: list[str], e) -> None:
        require(len(names) == 1, "qualified_function_forbidden", SqlPolicyError)
        name = names[0].upper()
        require(name in FUNCTIONS or name in _OPERATORS, "function_not_allowed", SqlPolicyError)
        if name == "REPEAT":
            args = list(_each(e.arguments()))
            literal = len(args) > 1 and _kind(args[1]) == "Literal" and args[1].dataType().typeName() in ("integer", "long")
            require(literal and 0 <= int(args[1].value()) <= REPEATS, "function_argument_limit", SqlPolicyError)
        if name in dialect.REWRITTEN:
            # The words of EXTRACT aren't arguments with places of their own.
            places = [] if name == "EXTRACT" else [_span(a) for a in _each(e.arguments())]
            self.calls.append((name, places, *_span(e)))


def admit(spark: SparkSession, sql: str, tables: Iterable[str] | None = None, dialect: str = "spark") -> str:
    """The admitted statement as it is written; see :func:`prepare`."""
    return prepare(spark, sql, tables, dialect)[0]


def prepare(spark: SparkSession, sql: str, tables: Iterable[str] | None = None, source: str = "spark") -> tuple[str, str]:
    """The statement without its closing semicolon, if it is one read-only query within bounds; else SqlPolicyError.

    The second text is for Spark: calls that mean something else there are rewritten in it.
    ``tables`` are the names that it may read; None allows any. Messages carry codes alone
    and never repeat what the query says.
    """
    text = sql.strip() if isinstance(sql, str) else ""
    require(bool(text.strip("; \n\t")), "empty_sql", SqlPolicyError)
    require(len(text) <= CHARACTERS, "sql_too_large", SqlPolicyError)
    require(source not in ("mysql", "mariadb") or "/*!" not in text, "executable_comment_forbidden", SqlPolicyError)
    require(_statements(text) <= 1, "multiple_statements", SqlPolicyError)
    text = text.rstrip("; \n\t")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except PySparkException:
        raise SqlPolicyError("sql_parse_error") from None
    root = _kind(plan)
    require(not _CHANGES.match(root), "forbidden_statement", SqlPolicyError)
    require(root in _RELATIONAL or root in ("UnresolvedHint", "UnresolvedInlineTable", "Generate", "LateralJoin", "ResolvedInlineTable"), "not_readonly", SqlPolicyError)
    walk = _Walk(None if tables is None else frozenset(tables))
    walk.plan(plan, frozenset(), 1)
    return text, dialect.rewritten(text, walk.calls)


def tool_decision(name: str, arguments: dict, tools: Iterable[str], sources: Iterable[str], datasets: Iterable[str], secrets: Iterable[str] = ()) -> tuple[str, str]:
    """(allow or reject, code): a known tool, no configured secret anywhere in its arguments, ids of the selection only."""
    if name not in set(tools):
        return "reject", "unknown_tool"
    said = json.dumps(arguments, ensure_ascii=False, default=str)
    if any(s and s in said for s in secrets):
        return "reject", "configured_secret_detected"
    own = set(sources)
    both = own | set(datasets)
    for field in ("source_id", "dataset_id", "dataset_ids", "input_dataset_ids"):
        given = arguments.get(field)
        ids = given if isinstance(given, list) else [] if given is None else [given]
        if not {str(i) for i in ids} <= (own if field == "source_id" else both):
            return "reject", "source_not_selected" if field == "source_id" else "dataset_not_selected"
    return "allow", "validated_input"
