"""Checks of free-form SQL on Spark's parsed plan, its row cap and its time limit.

This module alone touches Catalyst's classes. Only plan nodes on an allow list pass,
so writes, commands, scripts and whatever a later version adds are refused.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

ALLOWED_RELATIONS = frozenset({"document_facts", "table_registry", "documents"})
SCOPE_COLUMNS = frozenset({"table_id", "document_id"})
MAX_ROWS = 1000
TIMEOUT_S = 10
_NODES = frozenset({
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "LimitAll", "Offset", "Join", "Union", "Distinct", "Except", "Intersect", "SubqueryAlias",
    "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "WithWindowDefinition", "Window", "OneRowRelation", "Pivot", "Unpivot", "Tail", "LateralJoin",
    "Generate", "UnresolvedInlineTable", "NamedParametersQuery", "NameParameterizedQuery", "PosParameterizedQuery", "UnresolvedOrdinal", "CTERelationRef", "WithCTE",
})
# Functions that run code, read files, wait or change the session, in Spark and elsewhere.
FORBIDDEN_FUNCTIONS = frozenset({
    "reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length",
    "pg_read_file", "pg_read_binary_file", "pg_ls_dir", "pg_stat_file", "pg_sleep", "lo_import", "lo_export", "dblink", "dblink_exec", "query_to_xml", "set_config", "pg_terminate_backend", "pg_cancel_backend",
})


def _seq(s) -> list:
    it, out = s.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def _name(x) -> str:
    return x.getClass().getSimpleName()


def _is_scope(e) -> bool:
    return _name(e) == "UnresolvedAttribute" and _seq(e.nameParts())[-1].lower() in SCOPE_COLUMNS


def _constant(e) -> bool:
    """No column occurs in the expression."""
    return _name(e) not in ("UnresolvedAttribute", "UnresolvedStar", "UnresolvedFunction") and all(_constant(c) for c in _seq(e.children()))


def _scopes(condition) -> bool:
    """Whether a condition can hold only for rows of named tables or documents.

    One of its conjuncts must set a scope column equal to a constant, put it in a list of
    constants or in a subquery; of alternatives each must.
    """
    kind, parts = _name(condition), _seq(condition.children())
    if kind == "And":
        return any(map(_scopes, parts))
    if kind == "Or":
        return all(map(_scopes, parts))
    if kind in ("EqualTo", "EqualNullSafe"):
        return any(_is_scope(x) and (_constant(y) or _name(y) == "ScalarSubquery") for x, y in (parts, parts[::-1]))
    if kind == "In":
        return _is_scope(parts[0]) and all(map(_constant, parts[1:]))
    return kind == "InSubquery" and any(_is_scope(x) for x in parts)


class _Check:
    def __init__(self) -> None:
        self.scoped = False

    def expression(self, e, scope: frozenset) -> str | None:
        kind = _name(e)
        if kind == "UnresolvedFunction":
            name = ".".join(_seq(e.nameParts())).lower()
            if name.rpartition(".")[2] in FORBIDDEN_FUNCTIONS:
                return f"Forbidden function: {name}"
        if hasattr(e, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression") and (err := self.plan(e.plan(), scope)):
            return err
        return next((err for c in _seq(e.children()) if (err := self.expression(c, scope))), None)

    def plan(self, p, scope: frozenset) -> str | None:
        kind = _name(p)
        if kind not in _NODES:
            return f"Only SELECT queries are allowed, got {kind}"
        if kind == "UnresolvedWith":
            inner = scope
            for pair in _seq(p.cteRelations()):  # (name, query, ...): a query sees the names before it
                if err := self.plan(pair.productElement(1), inner):
                    return err
                inner = inner | {str(pair.productElement(0)).lower()}
            return self.plan(p.child(), inner)
        if kind == "UnresolvedRelation":
            parts = [x.lower() for x in _seq(p.multipartIdentifier())]
            if len(parts) > 1:
                return f"Schema '{parts[0]}' is not allowed"
            if parts[0] not in scope and parts[0] not in ALLOWED_RELATIONS:
                return f"Relation '{parts[0]}' is not allowed. Queryable: {', '.join(sorted(ALLOWED_RELATIONS))}"
        for e in _seq(p.expressions()):
            self.scoped |= kind in ("Filter", "Join", "UnresolvedHaving") and _scopes(e)
            if err := self.expression(e, scope):
                return err
        return next((err for c in _seq(p.children()) if (err := self.plan(c, scope))), None)


def validate_sql(spark: SparkSession, sql: str | None) -> tuple[bool, str | None]:
    """(ok, error) of a query before it runs: one SELECT over the allowed relations, scoped by a filter."""
    if not sql or not sql.strip():
        return False, "Empty SQL query"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        return False, f"Could not parse SQL: {str(e).splitlines()[0][:150]}"
    check = _Check()
    if err := check.plan(plan, frozenset()):
        return False, err
    return (True, None) if check.scoped else (False, "Query must filter on table_id or document_id")


def enforce_limit(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Cap the outermost rows; Catalyst keeps the smaller of two limits, inner ones are untouched."""
    return df.limit(max_rows)


def execute(spark: SparkSession, sql: str, args: dict | None = None, max_rows: int = MAX_ROWS, timeout_s: float = TIMEOUT_S) -> dict:
    """Validate, cap and run; cancelled after ``timeout_s`` seconds. Types come from the schema."""
    ok, err = validate_sql(spark, sql)
    if not ok:
        return {"success": False, "error": err, "sql_executed": sql}
    group, sc = f"query-{uuid.uuid4().hex}", spark.sparkContext
    timer = threading.Timer(timeout_s, sc.cancelJobGroup, [group])
    try:
        df = enforce_limit(spark.sql(sql, args=args or {}), max_rows)
        sc.setJobGroup(group, "free-form query", interruptOnCancel=True)
        timer.start()
        rows = df.collect()
    except Exception as e:
        return {"success": False, "error": str(e).splitlines()[0][:300], "sql_executed": sql}
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    return {"success": True, "columns": df.columns, "types": [f.dataType for f in df.schema.fields], "rows": [tuple(r) for r in rows], "row_count": len(rows), "sql_executed": sql, "frame": spark.createDataFrame(rows, df.schema)}
