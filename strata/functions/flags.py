"""Loosely typed yes/no columns -> boolean, as built-in expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The upper-cased texts that count as "yes".  Matching is exact
# after upper-casing (no trimming), and NULL counts as "no".
ATTENDED_WORDS = ("TRUE", "PRESENT", "1", "YES")
ACTIVE_WORDS = ("TRUE", "ACTIVE", "1", "YES")


def truthy(col: Column | str, words: tuple[str, ...]) -> Column:
    """True when the text form of ``col``, upper-cased, is one of ``words``.

    Booleans cast to 'true', integers to '1', doubles to '1.0' (not a match),
    so the result equals the reference's ``str(x).upper() in words``.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.upper(c.cast("string")).isin(*words), F.lit(False))


def attended(col: Column | str = "attendance_status") -> Column:
    return truthy(col, ATTENDED_WORDS)


def active(col: Column | str = "is_active") -> Column:
    return truthy(col, ACTIVE_WORDS)
