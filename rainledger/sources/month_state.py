"""Sums and customer sets per month and segment, stored so that reports add months up instead of counting lines again.

Distinct customers can't be added, but sets can be joined: each customer has a number, and a month's customers of a
segment are bitmaps of 32,768 numbers each. So the state takes at most 4 KB per month, segment and 32,768 known customers,
however many lines there are, and counts stay exact. Lines without a date belong to no month.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainledger.functions.measures import merged_mean
from rainledger.operators.lookup import join_lookup
from rainledger.shared import file_system, kept

COLUMNS = ("order_date", "segment", "customer_id", "order_id", "sales", "profit")
_STATE = (
    "segment string, bucket bigint, bitmap binary, n_lines bigint, n_sales bigint, n_orders bigint, "
    "sales decimal(38,2), profit decimal(38,2), month int"
)
_NUMBERS = "customer_id string, number bigint"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    path, files = file_system(spark, folder)
    there = files.exists(path)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of three kinds: sums of a segment's month, bitmaps of its customers (``bucket``), orders of a month."""
    return _read(spark, f"{path}/months", _STATE)


def customers(spark: SparkSession, path: str) -> DataFrame:
    """The number, from 1, of every customer met so far; numbers never change."""
    return _read(spark, f"{path}/customers", _NUMBERS)


def _number_new(period: DataFrame, path: str) -> None:
    """Numbers for customers without one: their place in their partition, after the partitions before it."""
    spark = period.sparkSession
    known = customers(spark, path)
    last = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("last")).first()["last"]
    unknown = period.select("customer_id").dropna().distinct().join(known, "customer_id", "left_anti")
    placed = kept(unknown.withColumn("place", F.monotonically_increasing_id()), "new-customers")
    part = F.shiftright("place", 33).alias("part")
    # One row per partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    in_part = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    numbered.select("customer_id", (in_part + F.col("offset") + last + 1).alias("number")).write.mode("append").parquet(
        f"{path}/customers"
    )


def _first_of_next_month(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


def refresh(lines: DataFrame, path: str, first: date, last: date) -> list[int]:
    """Replace the state of the whole months from ``first`` to ``last`` by that of the lines; the months found.

    Only lines of those months are read, and only their folders are written, so a new month costs what it holds. Doing it
    again gives the same state; a job that was lost half way is mended by doing it again. One refresh at a time.
    A month that has no lines any more loses its state. Lines may have more columns than ``COLUMNS``.
    """
    spark, path = lines.sparkSession, path.rstrip("/")
    start, end = first.replace(day=1), _first_of_next_month(last)
    within = (F.col("order_date") >= F.lit(start)) & (F.col("order_date") < F.lit(end))
    month = (F.year("order_date") * 100 + F.month("order_date")).alias("month")
    period = kept(lines.filter(within).select(month, *COLUMNS[1:]), "months")
    _number_new(period, path)
    sums = period.groupBy("month", "segment").agg(
        F.count("*").alias("n_lines"), F.count("sales").alias("n_sales"), F.sum("sales").alias("sales"), F.sum("profit").alias("profit")
    )
    orders = period.groupBy("month").agg(F.count_distinct("order_id").alias("n_orders"))
    met = period.select("month", "segment", "customer_id").dropna(subset=["customer_id"]).distinct()
    numbered = join_lookup(met, customers(spark, path), ["customer_id"], ready=True)
    members = numbered.groupBy("month", "segment", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")
    )
    schema = spark.createDataFrame([], _STATE)
    state = schema.unionByName(sums, True).unionByName(orders, True).unionByName(members, True).to(schema.schema)
    # A month's state is small: one file per month.
    state.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(
        f"{path}/months"
    )
    found = sorted(row["month"] for row in sums.select("month").distinct().collect())
    _drop_others(spark, f"{path}/months", start, end, found)
    return found


def _drop_others(spark: SparkSession, folder: str, start: date, end: date, found: list[int]) -> None:
    path, files = file_system(spark, folder)
    low, high = (day.year * 100 + day.month for day in (start, end))
    for entry in files.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith("month=") and low <= int(name[6:]) < high and int(name[6:]) not in found:
            files.delete(entry.getPath(), True)


def monthly_trend(state: DataFrame) -> DataFrame:
    """``final_reports.monthly_trend`` from the state."""
    return (
        state.groupBy(F.floor(F.col("month") / 100).alias("year"), (F.col("month") % 100).alias("month"))
        .agg(
            F.round(F.sum("sales"), 2).alias("total_sales"),
            F.round(F.sum("profit"), 2).alias("total_profit"),
            F.sum("n_orders").alias("order_count"),
        )
        .orderBy("year", "month")
    )


def segment_performance(state: DataFrame) -> DataFrame:
    """``final_reports.segment_performance`` from the state: bitmaps of one bucket are joined over the months, then counted."""
    joined = state.where("bucket IS NOT NULL").groupBy("segment", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    counted = joined.select("segment", F.bitmap_count("bitmap").alias("customers"))
    sums = state.where("n_lines IS NOT NULL").select("segment", "n_lines", "n_sales", "sales", "profit")
    return (
        sums.unionByName(counted, True)
        .groupBy("segment")
        .agg(
            F.coalesce(F.sum("customers"), F.lit(0)).alias("customer_count"),
            F.sum("n_lines").alias("order_count"),
            F.round(F.sum("sales"), 2).alias("total_sales"),
            merged_mean("sales", "n_sales", 2).alias("avg_order_value"),
            F.round(F.sum("profit"), 2).alias("total_profit"),
        )
        .orderBy(F.desc("total_sales"), "segment")
    )
