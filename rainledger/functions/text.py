"""Text comparison rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(column: str | Column) -> Column:
    """Lower case without outer blanks, so that equal names compare equal whatever their spelling."""
    return F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
