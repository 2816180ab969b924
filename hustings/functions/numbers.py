"""Number parsing with the rules of each source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hustings.functions.base import col, found

RULES = ("leading", "digits", "first_run")


def case_count(c, rule: str = "leading") -> Column:
    """A count written as text; what can't be read counts 0.

    ``leading`` takes a whole number in front, ``digits`` takes texts of digits
    only, ``first_run`` takes the first digits anywhere.
    """
    c = F.coalesce(col(c).cast("string"), F.lit(""))
    if rule == "leading":
        text = found(c, r"^\s*([+-]?[0-9]+)")
    elif rule == "digits":
        text = found(F.trim(c), r"^([0-9]+)$")
    elif rule == "first_run":
        text = found(c, r"([0-9]+)")
    else:
        raise ValueError(f"rule must be one of {RULES}")
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def to_int(c, default: int | None = None) -> Column:
    """Whole number with grouping commas; else ``default``."""
    text = F.replace(F.trim(col(c)), F.lit(","), F.lit(""))
    return F.coalesce(F.when(text.rlike("^-?[0-9]+$"), text.try_cast("long")), F.lit(default).cast("long"))


def to_float(c, default: float | None = None) -> Column:
    """Decimal number with grouping commas; else ``default``."""
    text = F.regexp_replace(F.trim(col(c)), "[,%]", "")
    return F.coalesce(F.when(text.rlike(r"^-?[0-9]+(\.[0-9]*)?$|^-?\.[0-9]+$"), text.try_cast("double")), F.lit(default).cast("double"))
