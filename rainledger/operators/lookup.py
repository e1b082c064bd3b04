"""Joining the order lines to a lookup without moving the lines when that is safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rainledger.shared import kept

LIMIT_SETTING = "rainledger.broadcast.limitBytes"
DEFAULT_LIMIT = 64 * 1024 * 1024
_ROW_OVERHEAD = 32
_FIELD_BYTES = 16


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(LIMIT_SETTING, str(DEFAULT_LIMIT)))


def row_bytes(table: DataFrame) -> Column:
    """A row of the table in memory: a fixed share per column, and its texts."""
    fixed = F.lit(_ROW_OVERHEAD + _FIELD_BYTES * len(table.columns)).cast("long")
    texts = [f.name for f in table.schema.fields if isinstance(f.dataType, StringType)]
    return reduce(lambda acc, name: acc + F.coalesce(F.octet_length(name), F.lit(0)), texts, fixed)


def measured_bytes(lookups: dict[str, DataFrame]) -> dict[str, int]:
    """Size of every row and text of each lookup, counted by Spark in one job."""
    parts = [
        table.agg(F.coalesce(F.sum(row_bytes(table)), F.lit(0)).alias("bytes")).select(
            F.lit(name).alias("name"), "bytes"
        )
        for name, table in lookups.items()
    ]
    return {row["name"]: row["bytes"] for row in reduce(DataFrame.unionAll, parts).collect()}


def join_lookup(
    lines: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    size: int | None = None,
    ready: bool = False,
) -> DataFrame:
    """Broadcast the lookup when its counted size allows it.

    Beyond the limit the join shuffles on ``on``. Adaptive execution splits the tasks of a hot key
    only if both sides are bare shuffles, so a lookup that is computed is stored first; ``ready`` says
    that it is a stored table already. The lines get an exchange of their own for the same reason.
    """
    if size is None:
        size = measured_bytes({"lookup": lookup})["lookup"]
    if size <= broadcast_limit(lines.sparkSession):
        return lines.join(F.broadcast(lookup), on, how)
    if not ready:
        lookup = kept(lookup, "lookup")
    return lines.join(lookup, on, how)
