"""Dates written as text, and names of days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_FIRST = "d/M/yy"
MONTH_FIRST = "M/d/yyyy"

# Week order of the weekday report.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def parse_date(text: str | Column, fmt: str = DAY_FIRST) -> Column:
    """DATE from text, NULL where the text does not match ``fmt``.

    Spark reads every two-digit year as 20xx, but 70 to 99 belong to the last century. The
    century is written in front of the two digits, behind a mark that keeps years already
    given in full from matching. So the text is looked at once, not once per century.
    """
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    if not fmt.endswith("yy") or fmt.endswith("yyyy"):
        return F.try_to_date(text, fmt)
    last_century = F.regexp_replace(text, r"(?<!\d)([7-9]\d)$", "~19$1")
    marked = F.regexp_replace(last_century, r"(?<!\d)([0-6]\d)$", "~20$1")
    return F.try_to_date(marked, fmt.removesuffix("yy") + "'~'yyyy")


def weekday_name(position: Column) -> Column:
    """Full English name for 0 (Monday) to 6 (Sunday)."""
    return F.element_at(F.array(*[F.lit(day) for day in WEEKDAYS]), position + 1)


def field_position(value: Column, *texts: str) -> Column:
    """1-based place of ``value`` in ``texts``, 0 if it is not among them."""
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in texts]), value), F.lit(0))
