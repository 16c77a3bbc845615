"""Scalar expressions on raw strings, dates and scores. What cannot be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clamp, col

# The form of a symbol, and of a number without its signs of currency and thousands.
SYMBOL = r"^[A-Z][A-Z0-9.-]{0,9}$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(text: str) -> Column:
    """A plain, currency or thousands number; parentheses around it are a minus sign."""
    bare = F.regexp_replace(F.regexp_replace(F.col(text), r"[$,]", ""), r"^\((.*)\)$", "-$1")
    digits = F.trim(bare)
    number = digits.try_cast("double")
    return F.when(digits.rlike(NUMBER) & (F.abs(number) != float("inf")), number)


def sanitize_ticker(text: str) -> Column:
    """A symbol without a leading $, remarks in parentheses and what follows a dash; null if none is left."""
    bare = F.regexp_replace(F.col(text), r"^\$|\(.*?\)", "")
    symbol = F.upper(F.trim(F.regexp_replace(bare, r"\s+[—-].*$", "")))
    return F.when(symbol.rlike(SYMBOL), symbol)


def shift_months(date, months: int) -> Column:
    """The date so many months on; a day that the month lacks runs into the next month."""
    return F.date_add(F.add_months(F.trunc(col(date), "MM"), months), F.dayofmonth(col(date)) - 1)


def logistic_percent(value, scale: float = 3.0, center: float = 0.5) -> Column:
    return clamp(100 / (1 + F.exp(-(col(value) - center) * scale)), 0.5, 99.5)


def time_decay(days) -> Column:
    """Weight of evidence by its age, with a week as unit."""
    return F.exp(-col(days) / 7)


def signed_percent(value: str) -> Column:
    return F.format_string("%+.1f%%", F.col(value))
