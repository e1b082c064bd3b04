"""Dated order lines, their weather, and the clean table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainledger.functions.dates import DAY_FIRST, parse_date
from rainledger.functions.text import fold
from rainledger.operators.lookup import join_lookup
from rainledger.operators.quality import Rule, Split, clean_rules, reject_reason, split
from rainledger.operators.weather import combined_weather_any
from rainledger.sources.schemas import CLEAN_COLUMNS, ORDERS_RAW


def fold_city(orders: DataFrame) -> DataFrame:
    return orders.withColumns({"city_as_given": F.col("city"), "city": fold("city")})


def parse_dates(orders: DataFrame, fmt: str = DAY_FIRST) -> DataFrame:
    """Adds both dates as DATE columns; text that is no date gives NULL."""
    return orders.withColumns(
        {
            "order_date_proper": parse_date("order_date", fmt),
            "ship_date_proper": parse_date("ship_date", fmt),
        }
    )


def unparsed_dates(dated: DataFrame) -> DataFrame:
    """Lines with a date text that could not be read."""
    return dated.filter(
        (F.col("order_date").isNotNull() & F.col("order_date_proper").isNull())
        | (F.col("ship_date").isNotNull() & F.col("ship_date_proper").isNull())
    )


def orders_view(dated: DataFrame) -> DataFrame:
    """The 21 order columns with the parsed dates in place of the texts."""
    parsed = {"order_date": "order_date_proper", "ship_date": "ship_date_proper"}
    wanted = [parsed.get(name, name) for name in ORDERS_RAW.fieldNames()]
    return dated.select(*[name for name in wanted if name in dated.columns])


def date_range(orders: DataFrame) -> DataFrame:
    return orders.agg(F.min("order_date").alias("start_date"), F.max("order_date").alias("end_date"))


def slice_by_date(
    orders: DataFrame, first: date = date(2012, 10, 1), last: date = date(2017, 11, 30)
) -> DataFrame:
    """Lines whose order date lies in the period of the weather tables, both ends included."""
    return orders.filter(F.col("order_date").between(F.lit(first), F.lit(last)))


def on_weather(
    lines: DataFrame, weather: DataFrame, how: str, date_column: str, size: int | None = None, ready: bool = False
) -> DataFrame:
    """Weather of the line's own date and city."""
    lookup = weather.withColumnRenamed("date", date_column)
    return join_lookup(lines, lookup, [date_column, "city"], how, size, ready)


def sales_weather(
    dated: DataFrame, weather: DataFrame, size: int | None = None, ready: bool = False
) -> DataFrame:
    """Lines that have weather, with temperature, humidity and description appended."""
    joined = on_weather(dated, weather, "inner", "order_date_proper", size, ready)
    return joined.select(*dated.columns, "temperature", "humidity", "description")


def sales_weather_joined(
    orders: DataFrame, temperature: DataFrame, humidity: DataFrame, description: DataFrame
) -> DataFrame:
    """Every line; its weather stays NULL where a table has no row for date and city."""
    lookup = combined_weather_any(temperature, humidity, description).withColumnRenamed(
        "description", "weather_condition"
    )
    joined = on_weather(orders, lookup, "left", "order_date")
    return joined.select(*orders.columns, "temperature", "humidity", "weather_condition")


def typed_lines(dated: DataFrame, *more: str) -> DataFrame:
    """The columns of the clean table as typed ones, plus the raw dates that the checks look at and ``more``."""
    typed = dated.withColumns(
        {
            "order_date_text": F.col("order_date"),
            "ship_date_text": F.col("ship_date"),
            "row_id": F.col("row_id").cast("string"),
            "order_date": F.col("order_date_proper"),
            "ship_date": F.col("ship_date_proper"),
        }
    )
    if "description" in dated.columns:
        typed = typed.withColumn("weather_description", F.col("description"))
    return typed.select(*[c for c in CLEAN_COLUMNS if c in typed.columns], "order_date_text", "ship_date_text", *more)


def line_rules() -> list[Rule]:
    """The rules of the clean table; an order date that can't be read isn't called missing."""
    there, read = F.col("order_date_text").isNotNull(), F.col("order_date").isNotNull()
    own = [Rule("order_date is missing", there | read), Rule("order_date is not a date", ~there | read)]
    names = {rule.name for rule in own}
    return [*[rule for rule in clean_rules() if rule.name not in names], *own]


def split_lines(dated: DataFrame) -> Split:
    """Lines that keep all rules, and the others with their reasons, before any join.

    A line whose date or city is missing or unreadable meets no weather, so the split comes first.
    """
    return split(typed_lines(dated), line_rules())


def rejected_lines(dated: DataFrame) -> DataFrame:
    return split_lines(dated).rejected.select(
        "row_id", "order_id", "order_date_text", "ship_date_text", "city", "reject_reason"
    )


def line_outcomes(dated: DataFrame, weather: DataFrame) -> DataFrame:
    """Number of lines for each end a line can take: clean, without weather, or a reason for its rejection."""
    cells = weather.select(F.col("date").alias("order_date"), "city").distinct().withColumn("found", F.lit(True))
    judged = typed_lines(dated).withColumn("reject_reason", reject_reason(line_rules()))
    joined = join_lookup(judged, cells, ["order_date", "city"], "left")
    end = F.coalesce("reject_reason", F.when(F.col("found"), F.lit("clean")).otherwise("without weather"))
    return joined.groupBy(end.alias("outcome")).agg(F.count("*").alias("n_rows"))


def split_sales_weather(enriched: DataFrame) -> Split:
    """Clean lines with weather, and the lines with weather that break a rule, with the reasons."""
    return split(typed_lines(enriched), line_rules())


def sales_weather_clean(enriched: DataFrame) -> DataFrame:
    return split_sales_weather(enriched).accepted.drop("order_date_text", "ship_date_text")
