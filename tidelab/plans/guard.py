"""Read-only SQL guard (F1).

The statement is parsed once by Spark's own parser, and the unresolved plan is walked whole:
children, common table expressions, and the plans inside subquery expressions. Every node must be on a
list of reading nodes; what is not on it (writes, definitions, settings, commands, script transforms,
``EXECUTE IMMEDIATE``, nodes of versions to come) is rejected. So are functions that call into the
JVM, table functions that are not plain generators, and relations that name files. Multi-statement
text does not parse. Without a JVM parser handle (Spark Connect) a conservative text rule is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Plan nodes that only read.
READING_NODES = {
    "Aggregate", "CurrentNamespace$", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join",
    "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot", "Project",
    "RepartitionByExpression", "Sample", "Sort", "SubqueryAlias", "Union", "Unpivot", "UnresolvedFunctionName",
    "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedNamespace", "UnresolvedOrderBy",
    "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableOrView", "UnresolvedTableValuedFunction",
    "UnresolvedTVFAliases", "UnresolvedWith", "WithWindowDefinition",
    "DescribeColumn", "DescribeFunction", "DescribeRelation", "ExplainCommand", "ShowColumns", "ShowFunctions",
    "ShowNamespaces", "ShowNamespacesCommand", "ShowTables", "ShowViews",
}
# Functions that run code outside the query.
CALLING_FUNCTIONS = {"java_method", "reflect", "try_reflect"}
# Table functions and generators that only make rows.
ROW_FUNCTIONS = {
    "explode", "explode_outer", "inline", "inline_outer", "json_tuple", "posexplode", "posexplode_outer", "range", "stack",
}
# First words accepted by the text fallback.
READ_ONLY_WORDS = ("SELECT", "WITH", "EXPLAIN", "DESCRIBE", "DESC", "SHOW", "VALUES", "FROM", "TABLE")
_OTHER_WORDS = re.compile(
    r"\b(INSERT|CREATE|DROP|ALTER|DELETE|UPDATE|MERGE|TRUNCATE|REPLACE|CACHE|UNCACHE|REFRESH|LOAD|SET|RESET|USE|CALL|GRANT"
    r"|REVOKE|MSCK|ANALYZE|EXECUTE|TRANSFORM|REFLECT|TRY_REFLECT|JAVA_METHOD)\b",
    re.IGNORECASE,
)
_TABLE_NAME = re.compile(r"[^/:\\]+")


class SqlGuardError(ValueError):
    pass


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _expression_faults(e) -> Iterator[str]:
    kind = _kind(e)
    if kind == "UnresolvedFunction":
        name = _seq(e.nameParts())[-1]
        if name.lower() in CALLING_FUNCTIONS:
            yield f"function {name}"
    if kind == "UnresolvedGenerator" and e.name().funcName().lower() not in ROW_FUNCTIONS:
        yield f"generator {e.name().funcName()}"
    if "Subquery" in kind or kind in ("Exists", "ListQuery"):
        plan = getattr(e, "plan", None)
        if kind != "InSubquery" and plan is not None:
            yield from _plan_faults(plan())
    for c in _seq(e.children()):
        yield from _expression_faults(c)


def _plan_faults(plan) -> Iterator[str]:
    """What in a parsed plan does more than read."""
    stack = [plan]
    while stack:
        node = stack.pop()
        kind = _kind(node)
        if kind not in READING_NODES:
            yield kind
            continue
        if kind == "UnresolvedRelation":
            parts = _seq(node.multipartIdentifier())
            if not all(_TABLE_NAME.fullmatch(p) for p in parts):
                yield f"file {'.'.join(parts)}"
        if kind == "UnresolvedTableValuedFunction":
            name = _seq(node.name())[-1]
            if name.lower() not in ROW_FUNCTIONS:
                yield f"table function {name}"
        for e in _seq(node.expressions()):
            yield from _expression_faults(e)
        stack += _seq(node.children())
        if kind == "ExplainCommand":  # what it explains is planned, so it must be a reading plan itself
            stack.append(node.logicalPlan())
        if kind == "UnresolvedWith":  # its inner children are the common table expressions
            stack += _seq(node.innerChildren())


def _strip_comments_and_strings(q: str) -> str:
    q = re.sub(r"--[^\n]*", " ", q)
    q = re.sub(r"/\*.*?\*/", " ", q, flags=re.S)
    q = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", q)
    q = re.sub(r'"(?:[^"\\]|\\.)*"', '""', q)
    q = re.sub(r"`[^`/:]*`", "x", q)
    return q


def text_check(query: str) -> None:
    body = _strip_comments_and_strings(query).strip()
    first = re.match(r"[\s(]*([A-Za-z]+)", body)
    if not first or first.group(1).upper() not in READ_ONLY_WORDS:
        raise SqlGuardError("only read-only statements (SELECT, WITH, EXPLAIN, DESCRIBE, SHOW) are allowed")
    if ";" in body.rstrip("; \n\t"):
        raise SqlGuardError("one statement at a time")
    if "`" in body:
        raise SqlGuardError("statement names a file")
    if first.group(1).upper() not in ("EXPLAIN", "DESCRIBE", "DESC", "SHOW"):
        m = _OTHER_WORDS.search(body)
        if m:
            raise SqlGuardError(f"statement contains {m.group(1).upper()}")


def check_read_only(spark: SparkSession, query: str) -> None:
    """Raise ``SqlGuardError`` unless ``query`` is a single read-only statement."""
    if not query or not query.strip():
        raise SqlGuardError("empty query")
    jss = getattr(spark, "_jsparkSession", None)
    if jss is None:
        text_check(query)
        return
    try:
        jplan = jss.sessionState().sqlParser().parsePlan(query.strip().rstrip(";"))
    except Exception as e:  # noqa: BLE001 - parse errors become guard errors with the parser message
        msg = str(e).split("\n", 1)[0]
        raise SqlGuardError(f"cannot parse: {msg}") from None
    fault = next(_plan_faults(jplan), None)
    if fault:
        raise SqlGuardError(f"not read-only: {fault}")
