"""Reports on ``sales_weather_final``: all lines of the period, weather filled where missing."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainledger.functions.dates import WEEKDAYS, field_position, weekday_name
from rainledger.functions.measures import margin_percent, rounded_mean, total
from rainledger.plans.report import report

KELVIN_OFFSET = Decimal("273.15")


def _lines() -> Column:
    return F.count("*").alias("order_count")


def _sales() -> Column:
    return F.round(total("sales"), 2).alias("total_sales")


def _profit() -> Column:
    return F.round(total("profit"), 2).alias("total_profit")


def _margin() -> Column:
    return margin_percent().alias("profit_margin")


def _average(column: str, name: str) -> Column:
    return rounded_mean(column, 2).alias(name)


def with_weather(final: DataFrame) -> DataFrame:
    return final.filter(F.col("weather_condition").isNotNull())


def sample_rows(final: DataFrame, limit: int = 20) -> DataFrame:
    """The first rows in the order of the seven columns shown, so that a rerun shows the same."""
    shown = ["order_date", "city", "state", "region", "temperature", "humidity", "weather_condition"]
    return final.select(*shown).orderBy(*shown).limit(limit)


def top_products_by_profit(final: DataFrame, limit: int = 10) -> DataFrame:
    return report(
        final,
        ["product_name", "category", "sub_category"],
        [total("quantity").alias("total_units_sold"), _sales(), _profit(), _margin()],
        [F.desc("total_profit")],
        limit,
    )


def weather_impact(final: DataFrame) -> DataFrame:
    return report(
        with_weather(final),
        ["weather_condition"],
        [
            F.count("*").alias("number_of_orders"),
            _average("quantity", "avg_items_per_order"),
            _sales(),
            _average("sales", "avg_order_value"),
        ],
        [F.desc("total_sales")],
    )


def monthly_trend(final: DataFrame) -> DataFrame:
    return report(
        final,
        [F.year("order_date").alias("year"), F.month("order_date").alias("month")],
        [_sales(), _profit(), F.count_distinct("order_id").alias("order_count")],
        ["year", "month"],
    )


def temperature_band(celsius: Column) -> Column:
    """Bands share their edges; the colder one wins."""
    return (
        F.when(celsius < 0, "Below 0°C")
        .when(celsius.between(0, 10), "0-10°C")
        .when(celsius.between(10, 20), "10-20°C")
        .when(celsius.between(20, 30), "20-30°C")
        .when(celsius > 30, "Above 30°C")
        .otherwise("Unknown")
    )


def sales_by_temp_range(final: DataFrame, temp_unit: str = "celsius") -> DataFrame:
    if temp_unit not in ("celsius", "kelvin"):
        raise ValueError("temp_unit must be 'celsius' or 'kelvin'")
    celsius = F.col("temperature")
    if temp_unit == "kelvin":
        celsius = celsius - F.lit(KELVIN_OFFSET)
    return report(
        final.filter(F.col("temperature").isNotNull()),
        [temperature_band(celsius).alias("temp_range")],
        [_lines(), _average("sales", "avg_sale"), _margin()],
        ["temp_range"],
    )


def segment_performance(final: DataFrame) -> DataFrame:
    return report(
        final,
        ["segment"],
        [
            F.count_distinct("customer_id").alias("customer_count"),
            _lines(),
            _sales(),
            _average("sales", "avg_order_value"),
            _profit(),
        ],
        [F.desc("total_sales")],
    )


def shipping_efficiency(final: DataFrame) -> DataFrame:
    shipped = final.filter(F.col("ship_date").isNotNull())
    days = rounded_mean(F.datediff("ship_date", "order_date"), 2).alias("avg_delivery_days")
    return report(
        shipped, ["ship_mode"], [_lines(), days, _sales(), _profit()], ["avg_delivery_days"]
    )


def region_state_performance(final: DataFrame) -> DataFrame:
    measures = [_lines(), _sales(), _profit(), _margin()]
    return report(final, ["region", "state"], measures, ["region", F.desc("total_sales")])


def weather_category(final: DataFrame) -> DataFrame:
    return report(
        with_weather(final),
        ["weather_condition", "category"],
        [_lines(), _sales()],
        ["weather_condition", F.desc("total_sales")],
    )


def discount_band(discount: Column) -> Column:
    """A missing discount satisfies no comparison and ends in the last band."""
    return (
        F.when(discount == 0, "No discount")
        .when(discount <= F.lit(Decimal("0.2")), "0-20% discount")
        .when(discount <= F.lit(Decimal("0.4")), "20-40% discount")
        .when(discount <= F.lit(Decimal("0.6")), "40-60% discount")
        .otherwise("60%+ discount")
    )


def discount_effect(final: DataFrame) -> DataFrame:
    return report(
        final,
        [discount_band(F.col("discount")).alias("discount_range")],
        [_lines(), _average("quantity", "avg_quantity"), _sales(), _profit(), _margin()],
        ["discount_range"],
    )


def weather_by_weekday(final: DataFrame) -> DataFrame:
    """Grouped by the weekday's number; its name is written once per group."""
    totals = report(
        with_weather(final),
        ["weather_condition", F.weekday("order_date").alias("weekday")],
        [_lines(), _sales()],
    )
    named = totals.withColumn("day_of_week", weekday_name(F.col("weekday")))
    ordered = named.orderBy("weather_condition", field_position(F.col("day_of_week"), *WEEKDAYS))
    return ordered.select("weather_condition", "day_of_week", "order_count", "total_sales")
