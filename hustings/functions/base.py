"""Helpers of the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, then) -> Column:
    """``then(c)`` with ``c`` worked out once, however often ``then`` looks at it."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
