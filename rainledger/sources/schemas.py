"""Declared schemas and the rules that go with them."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

MONEY = DecimalType(10, 2)
READING = DecimalType(10, 2)
FRACTION = DecimalType(5, 2)
# Average of readings: four more decimals than the readings themselves.
MEAN_READING = DecimalType(14, 6)
SUM_READING = DecimalType(20, 2)

# Column names and text lengths of the order-line table.
TEXT_LIMITS = {
    "order_id": 50,
    "ship_mode": 50,
    "customer_id": 50,
    "customer_name": 100,
    "segment": 50,
    "country": 50,
    "city": 50,
    "state": 50,
    "postal_code": 20,
    "region": 50,
    "product_id": 50,
    "category": 50,
    "sub_category": 50,
    "product_name": 200,
}
RAW_TEXT_LIMITS = {**TEXT_LIMITS, "order_date": 20, "ship_date": 20}

# Columns that must be present in the clean table.
REQUIRED = (
    "row_id",
    "order_id",
    "order_date",
    "customer_id",
    "customer_name",
    "country",
    "city",
    "product_id",
    "sales",
    "quantity",
)


def _orders(date_type: DataType) -> StructType:
    # row_id is a long: an int runs out at two billion lines.
    # postal_code is text so that leading zeros and foreign codes survive.
    return StructType(
        [
            StructField("row_id", LongType()),
            StructField("order_id", StringType()),
            StructField("order_date", date_type),
            StructField("ship_date", date_type),
            StructField("ship_mode", StringType()),
            StructField("customer_id", StringType()),
            StructField("customer_name", StringType()),
            StructField("segment", StringType()),
            StructField("country", StringType()),
            StructField("city", StringType()),
            StructField("state", StringType()),
            StructField("postal_code", StringType()),
            StructField("region", StringType()),
            StructField("product_id", StringType()),
            StructField("category", StringType()),
            StructField("sub_category", StringType()),
            StructField("product_name", StringType()),
            StructField("sales", MONEY),
            StructField("quantity", IntegerType()),
            StructField("discount", FRACTION),
            StructField("profit", MONEY),
        ]
    )


def _daily(*measures: StructField) -> StructType:
    return StructType([StructField("date", DateType()), StructField("city", StringType()), *measures])


ORDERS_RAW = _orders(StringType())
ORDERS_TYPED = _orders(DateType())

_TEMPERATURE = StructField("temperature", READING)
_HUMIDITY = StructField("humidity", READING)
_DESCRIPTION = StructField("description", StringType())

TEMPERATURE = _daily(_TEMPERATURE)
HUMIDITY = _daily(_HUMIDITY)
DESCRIPTION = _daily(_DESCRIPTION)
COMBINED_WEATHER = _daily(_TEMPERATURE, _HUMIDITY, _DESCRIPTION)

CITY_STATE_REFERENCE = StructType(
    [
        StructField("city", StringType()),
        StructField("state", StringType()),
        StructField("region", StringType()),
    ]
)

CLEAN_COLUMNS = [*ORDERS_TYPED.fieldNames(), "temperature", "humidity", "weather_description"]
