"""The shape most reports share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def report(
    table: DataFrame,
    keys: Sequence[str | Column],
    measures: Sequence[Column],
    order: Sequence[str | Column] = (),
    limit: int | None = None,
) -> DataFrame:
    """Group, measure, sort, and cut to the first ``limit`` rows if one is given.

    Group keys the order does not name break its ties. That fixes which rows a limit keeps,
    and lets the sort spread groups with equal measures over several tasks.
    """
    result = table.groupBy(*keys).agg(*measures)
    if order:
        named = [column for column in order if isinstance(column, str)]
        ties = [name for name in result.columns[: len(keys)] if name not in named]
        result = result.orderBy(*order, *ties)
    return result if limit is None else result.limit(limit)
