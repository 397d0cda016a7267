"""Guarded SQL: run a statement, cap its rows, turn failures into data."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession, types as T

from strata.operators.sqlguard import Refused, check_analysed, check_parsed

REFUSED = "only a single query statement (SELECT / WITH ...) is accepted"
# What placeholders are not looked for in: quoted text, quoted names, comments.
_OPAQUE = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/"


class Guarded:
    """``df`` is the capped result or the error table, ``ok`` and ``error`` tell which."""

    def __init__(self, df: DataFrame, ok: bool, error: str | None = None, rest: DataFrame | None = None):
        self.df, self.ok, self.error = df, ok, error
        self._rest, self._truncated = rest, None

    @property
    def truncated(self) -> bool | None:
        """Whether the statement has more rows than the cap let through (None after a failure).  Asked for
        the first time, this runs the statement up to the row behind the cap."""
        if self._truncated is None and self.ok:
            self._truncated = self._rest is not None and bool(self._rest.take(1))
        return self._truncated


def _error_frame(spark: SparkSession, msg: str, statement: str, error_columns: tuple[str, ...]) -> DataFrame:
    values = {"error": msg, "sql": statement, "query": statement}
    schema = T.StructType([T.StructField(c, T.StringType()) for c in error_columns])
    return spark.createDataFrame([tuple(values[c] for c in error_columns)], schema)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """Plain SQL scan: the statement's result, or an empty table (no columns)
    when it cannot be parsed or resolved."""
    try:
        return spark.sql(text)
    except (ParseException, AnalysisException):
        return spark.createDataFrame([], T.StructType([]))


def _with_tables(text: str, names: dict[str, str]) -> str:
    """``{name}`` outside quotes and comments replaced by the view of that name; other braces stay."""
    if not names:
        return text
    wanted = "|".join(map(re.escape, sorted(names, key=len, reverse=True)))
    return re.sub(rf"({_OPAQUE})|\{{({wanted})\}}", lambda m: m[1] if m[1] is not None else f"`{names[m[2]]}`", text, flags=re.S)


def guarded_sql(spark: SparkSession, text: str, max_rows: int | None = 100, eager: bool = False,
                error_columns: tuple[str, ...] = ("error", "sql"), tables: dict[str, DataFrame] | None = None) -> Guarded:
    """The statement's rows, at most ``max_rows`` (None: all); a failure becomes
    a one-row ``(error, sql)`` table (or ``(error, query)`` / ``(error)``, the
    other shapes, via ``error_columns``).

    Only queries run.  The text is parsed inside a subquery, where nothing but one query is
    grammatical, so DML behind a WITH or FROM, DDL, SET and several statements do not
    parse; the plan is then judged by ``sqlguard`` before and after its names are resolved, so calls into
    the JVM, user-defined functions, scripts and reads of bare files are refused before anything runs.
    ``tables`` names DataFrames that the text refers to as ``{name}``.

    Errors that only show at run time (ANSI casts, division by zero) surface on
    use; ``eager=True`` runs the query once to catch them here.
    """
    statement = text.strip().rstrip(";").strip()
    views = {name: f"guarded_{uuid.uuid4().hex}" for name in tables or {}}
    try:
        # the line breaks keep a closing comment from swallowing the bracket
        query = f"SELECT * FROM (\n{_with_tables(statement, views)}\n)"
        check_parsed(spark, query)
        for name, view in views.items():
            tables[name].createOrReplaceTempView(view)
        full = spark.sql(query)
        check_analysed(full)
        capped = full if max_rows is None else full.limit(max_rows)
        found = Guarded(capped, True, rest=None if max_rows is None else full.offset(max_rows).limit(1))
        if eager:
            found.truncated
            capped.take(1)
        return found
    except ParseException as exc:
        msg = f"{REFUSED}: {exc}"
    except (AnalysisException, Refused) as exc:
        msg = str(exc)
    except Exception as exc:  # runtime failure under eager=True
        msg = f"{type(exc).__name__}: {exc}"
    finally:  # a resolved plan no longer needs the names
        for view in views.values():
            spark.catalog.dropTempView(view)
    return Guarded(_error_frame(spark, msg, statement, error_columns), False, msg)
