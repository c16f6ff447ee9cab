"""Text expressions that follow Python's rules on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(column: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def fixed(column: Column, digits: int) -> Column:
    """A number with ``digits`` decimals, half to even, without thousands separators."""
    return F.regexp_replace(F.format_number(column, digits), ",", "")


def captured(column: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null where there is none."""
    return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, group))


def first_matching(parts: Column, pattern: str) -> Column:
    """The first element that matches, or null."""
    return F.get(F.filter(parts, lambda p: p.rlike(pattern)), F.lit(0))
