"""Reading, storing and joining, as every operator of this subpackage does it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.operators.lookup import broadcast_limit
from rainledger.shared import new_folder

#: A key with more than this share of all rows is joined by broadcast; there are at most 1 / share such keys.
HEAVY_SHARE = 1 / 1000
#: Bytes of rows that Spark gathers for a Python worker at once, unless the session says otherwise. Work that makes blocks of a batch's rows doesn't use it.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, rows go to Python in batches of BATCH_BYTES: by default one holds 64 MB in the executor and the worker."""
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def keep(table: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from files that outlive executors."""
    path = new_folder(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def keep_texts(table: DataFrame, name: str) -> DataFrame:
    """``keep`` for Python work on rows of any size, such as whole texts, with small batches."""
    with small_batches(table.sparkSession):
        return keep(table, name)


def without(table: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names a result column takes."""
    return table.drop(*names)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, also if the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of stored rows to one stored row per key, where ``size`` is the number of rows of that key.

    Heavy keys are fewer than 1 / HEAVY_SHARE by counting, whatever the input, so their rows stay where they
    are and the groups are broadcast. The other keys are shuffled, and none of them can fill a task.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("rows")).first()["rows"]
    heavy_from = max(2, int(total * HEAVY_SHARE))
    heavy, light = groups.where(F.col(size) > heavy_from), groups.where(F.col(size) <= heavy_from)
    marked = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(marked.join(light, key))


def join_groups_sized(rows: DataFrame, groups: DataFrame, key: str, size: str, row_bytes: int) -> DataFrame:
    """``join_groups``, but the rows stay where they are while all groups together are of broadcast size."""
    if groups.count() * row_bytes <= broadcast_limit(rows.sparkSession):
        return rows.join(F.broadcast(groups), key)
    return join_groups(rows, groups, key, size)


def join_sized(rows: DataFrame, lookup: DataFrame, on: list[str], how: str, row_bytes: Column) -> DataFrame:
    """Join to a lookup that is broadcast only if its counted bytes stay below the library's limit."""
    size = lookup.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= broadcast_limit(rows.sparkSession):
        lookup = F.broadcast(lookup)
    return rows.join(lookup, on, how)
