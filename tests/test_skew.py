"""A third of all rows under one key: same results, and no task gets them all."""

from contextlib import contextmanager
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F


from rainledger.operators import enrich, impute, quality, weather
from rainledger.operators.lookup import LIMIT_SETTING
from rainledger.sources import schemas, writers

DAY = date(2014, 1, 1)
ROWS = 60_000


@contextmanager
def settings(spark, values):
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in values:
            spark.conf.unset(name)


def lines(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(0, ROWS, 1, 8).select(
        F.when(hot, F.lit(0)).otherwise(F.col("id")).alias("row_id"),
        F.when(hot, F.lit(DAY)).otherwise(F.date_add(F.lit(DAY), (F.col("id") % 700).cast("int"))).alias("order_date"),
        F.when(hot, F.lit("rome")).otherwise(F.concat(F.lit("c"), F.col("id") % 20)).alias("city"),
        F.sha2(F.col("id").cast("string"), 256).alias("ballast"),
    )


def readings(spark):
    days = spark.range(700).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"))
    cities = F.explode(F.array(F.lit("rome"), *[F.lit(f"c{i}") for i in range(0, 20, 2)])).alias("city")
    return days.select("date", cities).withColumn("temperature", F.lit(Decimal("280.00")))


SPLIT = {
    LIMIT_SETTING: "0",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


def placed(spark):
    """The lines with a state and a region; the hot day has one of each."""
    return lines(spark).withColumns({"state": F.concat(F.lit("s-"), "city"), "region": F.when(F.col("city") == "rome", "r").otherwise("q")})


def weather_tables(spark):
    found = readings(spark)
    return {
        "temperature": found,
        "humidity": found.withColumnRenamed("temperature", "humidity"),
        "description": found.select("date", "city", F.lit("mist").alias("description")),
    }


def joined(spark):
    return enrich.on_weather(lines(spark), readings(spark), "left", "order_date")


def three_tables(spark):
    return enrich.sales_weather_joined(lines(spark), **weather_tables(spark))


def combined_on_the_fly(spark):
    dated = lines(spark).withColumn("order_date_proper", F.col("order_date"))
    return enrich.sales_weather(dated, weather.combined_weather_left(**weather_tables(spark)))


def filled(spark):
    reference = impute.city_state_reference(placed(spark))
    return impute.sales_weather_final(placed(spark), weather_tables(spark), reference)


@pytest.mark.parametrize(("build", "joins"), [(joined, 1), (three_tables, 1), (combined_on_the_fly, 1), (filled, 4)])
def test_hot_day_is_split_when_the_weather_is_too_large_to_broadcast(spark, build, joins):
    def summary(frame):
        values = [c for c in frame.columns if c not in ("ballast", "row_id")]
        return frame.agg(F.count("*"), *[F.count(c) for c in values], F.bit_xor(F.xxhash64(*frame.columns))).first()

    small = summary(build(spark))
    with settings(spark, SPLIT):
        frame = build(spark)
        frame = frame.groupBy("city").agg(F.bit_xor(F.xxhash64(*frame.columns)))
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("SortMergeJoin(skew=true)") == plan.count("SortMergeJoin") == joins
        assert summary(build(spark)) == small
    assert build in (combined_on_the_fly,) or small[0] == ROWS


def test_copies_of_a_row_id_are_dropped_before_the_shuffle(spark):
    assert quality.dedupe_row_id(lines(spark)).count() == ROWS - ROWS // 3 + 1


def test_heavy_year_is_written_as_several_files(spark, tmp_path):
    known = {"order_date": F.col("order_date"), "order_id": F.col("ballast"), "city": F.col("city")}
    clean = lines(spark).select(
        *[
            known.get(f.name, F.lit(None)).cast("string" if f.name == "row_id" else f.dataType).alias(f.name)
            for f in writers.CLEAN
            if f.name in schemas.CLEAN_COLUMNS
        ]
    )
    with settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB"}):
        writers.write_clean(clean, str(tmp_path / "clean"))
    files = {folder.name: len(list(folder.glob("*.parquet"))) for folder in (tmp_path / "clean").glob("order_year=*")}
    assert set(files) == {"order_year=2014", "order_year=2015"}
    assert files["order_year=2014"] > 3
    assert writers.read_clean(spark, str(tmp_path / "clean")).count() == ROWS
