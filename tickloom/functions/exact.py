"""Exact arithmetic: integer sums as decimals, ratios divided once, and the rank conventions of the statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = ("symbol", "day")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wide(x: Column | str) -> Column:
    """An integer as decimal(20,0), whose products and sums do not overflow."""
    return col(x).cast("decimal(20,0)")


def total(x: Column | str, times: Column | str | None = None) -> Column:
    """Exact sum of x, or of x times `times`."""
    value = wide(x) if times is None else wide(x) * wide(times)
    return F.sum(value).cast("decimal(38,0)")


def ratio(top: Column | str, bottom: Column | str, scale: float = 1.0) -> Column:
    """top / bottom * scale in double; null where bottom is 0."""
    b = col(bottom).cast("double")
    return col(top).cast("double") * F.lit(float(scale)) / F.when(b != 0, b)


def millionths(top: Column | str, bottom: Column | str, times: int = 1, over: int = 1) -> Column:
    """top * times / (bottom * over) of whole numbers that are not negative, rounded half up to six places in integers.

    Null where bottom is 0. The quotient is below 2**63 / 10**6.
    """
    a = col(top).cast("decimal(38,0)") * F.lit(2_000_000 * times).cast("decimal(12,0)")
    b = col(bottom).cast("decimal(38,0)") * F.lit(over).cast("decimal(4,0)")
    return F.call_function("div", a + b, F.nullif(b * 2, F.lit(0).cast("decimal(38,0)"))).cast("double") / 1e6


def by_seq(*keys: str) -> Window:
    return Window.partitionBy(*(keys or DAY)).orderBy("seq")


def hms(ns: Column | str) -> Column:
    s = F.floor(col(ns) / 1_000_000_000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
