"""Scalar conventions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pseudonym(value: Column, salt: str) -> Column:
    return F.concat(F.lit("acct_"), F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), 1, 16))


def whole_text(value: Column) -> Column:
    """A number without decimals, half to even."""
    return F.format_string("%.0f", F.bround(value.cast("double"), 0))


def percent_text(value: Column) -> Column:
    return F.concat(F.format_string("%.0f", F.bround(value.cast("double") * 100, 0)), F.lit("%"))


def safe_ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def finite(value: Column) -> Column:
    """Infinities and NaN as 0."""
    return F.when(value.isin(float("inf"), float("-inf")) | F.isnan(value), 0.0).otherwise(value)


def minute_of_day(minute: Column) -> Column:
    return F.pmod(minute, F.lit(1440))


def at_minute(minute: Column) -> Column:
    return F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int"))


def split_list(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\|"), lambda x: x != ""))


def padded_id(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def holds(text: Column, item) -> Column:
    """Whether a |-separated list holds an item (whole, not as part of another)."""
    return F.array_contains(split_list(text), item)


def with_prefix(columns: list[str], prefix: str) -> list[str]:
    return [c for c in columns if c.startswith(prefix)]


def spaced(code: Column) -> Column:
    return F.regexp_replace(code, "_", " ")


def tail(text: Column, n: int = 4) -> Column:
    return F.right(text, F.lit(n))


def grouped_digits(amount: Column) -> Column:
    """A whole number with its last three digits and then each two set off by commas: 12,34,567."""
    return F.regexp_replace(amount.cast("long").cast("string"), r"(?<=\d)(?=(\d\d)*\d{3}$)", ",")


def log_width(amount: Column, low: float = 1.0, high: float = 6.0) -> Column:
    """A line width from the decimal logarithm of an amount, within bounds."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.round(F.log10(F.greatest(amount.cast("double"), F.lit(1.0))), 2)))
