"""Labelled samples for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def labelled(labels: DataFrame, column: str, rows: int, per_class: bool = False) -> DataFrame:
    """doc_id and label (0 or 1) of at most ``rows`` labelled documents (of each class if asked), chosen by hash.

    Held-out rows and rows without id or label are left out; of several labels the mean decides.
    """
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    )
    order = F.xxhash64("doc_id")
    if not per_class:
        return one.orderBy(order, "doc_id").limit(rows)
    parts = [one.where(F.col("label") == c).orderBy(order, "doc_id").limit(rows) for c in (0, 1)]
    return parts[0].unionAll(parts[1])
