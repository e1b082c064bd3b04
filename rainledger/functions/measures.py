"""Aggregates used by the reports. Money stays DECIMAL until the caller casts it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(column: str) -> Column:
    return F.sum(column)


def mean(column: str | Column) -> Column:
    """Average over an exact sum, as DOUBLE; NULL when there is nothing to average."""
    return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))


def _exact(total_: Column) -> Column:
    return total_.cast("decimal(24,6)")


def rounded_mean(column: str | Column, digits: int) -> Column:
    """Average rounded as DECIMAL: a binary 54.95 may lie below the half and round down."""
    count = F.count(column).cast("decimal(20,0)")
    return F.round(F.try_divide(_exact(F.sum(column)), count), digits)


def merged_mean(sums: str, counts: str, digits: int) -> Column:
    """``rounded_mean`` of values of which partial sums and counts are known."""
    return F.round(F.try_divide(_exact(F.sum(sums)), F.sum(counts).cast("decimal(20,0)")), digits)


def margin_percent() -> Column:
    """Profit per sales in percent, NULL when sales add up to zero."""
    return F.round(F.try_divide(_exact(F.sum("profit")), _exact(F.sum("sales"))) * 100, 2)


def share_percent(condition: Column) -> Column:
    part, whole = F.count_if(condition), F.count("*").cast("decimal(20,0)")
    return F.round(F.try_divide(_exact(part * 100), whole), 1)
