"""What a guarded statement may contain, decided on its plan before anything runs.

A statement is judged twice.  *As parsed*, before Spark resolves it: resolving already evaluates some
expressions (a LIMIT, the arguments of a table function), so nothing refused may get that far.  *As
analysed*: functions that hide behind a built-in name, and whatever only shows when names are resolved.
Both times the rule is an allow-list: query nodes, built-in functions without the ones that call into the
JVM or the operating system, and tables that the catalog knows.  Views and the tables handed in by the
caller are trusted; their own plans are not judged.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

# Node names of Spark's logical plans that only read.
QUERY_NODES = frozenset("""
Aggregate AsOfJoin CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit
Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project Range
RebalancePartitions Repartition RepartitionByExpression ResolvedHint ResolvedInlineTable Sample Sort SubqueryAlias
Union UnionLoop UnionLoopRef Unpivot View Window WithCTE WithWindowDefinition
""".split())
PARSED_NODES = QUERY_NODES | frozenset("""
UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases
UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith
""".split())
ANALYSED_NODES = QUERY_NODES | frozenset("""
DataSourceV2Relation DataSourceV2ScanRelation HiveTableRelation InMemoryRelation LogicalRDD LogicalRelation UnresolvedCatalogRelation
""".split())
# Built-in functions that run code of the caller's choice.
REFUSED_FUNCTIONS = frozenset(["java_method", "reflect", "try_reflect"])
TABLE_FUNCTIONS = frozenset(["explode", "explode_outer", "inline", "inline_outer", "json_tuple", "posexplode", "posexplode_outer", "range", "stack", "variant_explode", "variant_explode_outer"])
# Expressions that call such code, and names that are only known once an expression has been evaluated.
REFUSED_EXPRESSIONS = frozenset("""
ApplyFunctionExpression CallMethodViaReflection ExpressionWithUnresolvedIdentifier PythonUDAF PythonUDF PythonUDTF ScalaUDF
UnresolvedPolymorphicPythonUDTF UserDefinedPythonFunction
""".split())
EXPRESSION_PACKAGES = ("org.apache.spark.sql.catalyst.",)

_functions: dict[str, frozenset[str]] = {}


class Refused(ValueError):
    """The statement holds something that a guarded query may not hold."""


def system_functions(spark: SparkSession) -> frozenset[str]:
    """Spark's built-in functions by name, read once per Spark version."""
    if spark.version not in _functions:
        _functions[spark.version] = frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())
    return _functions[spark.version]


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _nodes(plan, opaque: str | None = None) -> Iterator:
    """All plan nodes, those of CTEs and subqueries too; not what lies below ``opaque`` ones."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        if _kind(node) != opaque:
            todo += _items(node.children()) + _items(node.innerChildren())


def _expressions(node) -> Iterator:
    todo = _items(node.expressions())
    while todo:
        one = todo.pop()
        yield one
        todo += _items(one.children())


def check_parsed(spark: SparkSession, text: str) -> None:
    """Raise ``Refused`` (or Spark's ParseException) unless ``text`` is one query of allowed parts."""
    allowed = system_functions(spark) - REFUSED_FUNCTIONS

    def function(parts: list[str]) -> None:
        if len(parts) > 1 or parts[0].lower() not in allowed:
            raise Refused(f"the function {'.'.join(parts)} is not allowed in a guarded query")

    for node in _nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(text)):
        kind = _kind(node)
        if kind not in PARSED_NODES:
            raise Refused(f"{kind} is not allowed in a guarded query")
        if kind == "UnresolvedTableValuedFunction":
            name = ".".join(_items(node.name()))
            if name.lower() not in TABLE_FUNCTIONS:
                raise Refused(f"the table function {name} is not allowed in a guarded query")
        if kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            # format.`path` would read any file
            if len(parts) > 1 and not spark.catalog.tableExists(".".join("`" + p.replace("`", "``") + "`" for p in parts)):
                raise Refused(f"{'.'.join(parts)} is not a table of the catalog")
        for one in _expressions(node):
            kind = _kind(one)
            if kind == "UnresolvedFunction":
                function(_items(one.nameParts()))
            elif kind == "UnresolvedGenerator":
                function([one.name().funcName()])
            elif kind in REFUSED_EXPRESSIONS:
                raise Refused(f"{kind} is not allowed in a guarded query")


def check_analysed(df) -> None:
    """Raise ``Refused`` unless the resolved plan holds query nodes and built-in expressions only."""
    for node in _nodes(df._jdf.queryExecution().analyzed(), opaque="View"):
        kind = _kind(node)
        if kind not in ANALYSED_NODES:
            raise Refused(f"{kind} is not allowed in a guarded query")
        if kind == "View":
            continue
        for one in _expressions(node):
            if _kind(one) in REFUSED_EXPRESSIONS or not one.getClass().getName().startswith(EXPRESSION_PACKAGES):
                raise Refused(f"{_kind(one)} ({one.prettyName()}) is not allowed in a guarded query")
