"""Readers for the base tables. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rainledger.functions.text import fold
from rainledger.operators.quality import Rule, Split, split
from rainledger.sources import schemas


_TEXT_FORMATS = ("csv", "json")


def read_table(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options: str
) -> DataFrame:
    """A table of the declared schema. A text file with a value that can't be read stops the job;
    ``read_checked`` sets such rows apart instead."""
    reader = spark.read.schema(schema)
    if fmt in _TEXT_FORMATS:
        options = {"mode": "FAILFAST", **options}
    if fmt == "csv":
        options = {"header": "true", **options}
    return reader.format(fmt).options(**options).load(path)


def read_checked(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv", **options: str) -> Split:
    """Rows of a text file whose values all fit the declared types, and the other rows as text with the reasons."""
    as_text = StructType([StructField(field.name, StringType()) for field in schema])
    given = read_table(spark, path, as_text, fmt, **{"mode": "PERMISSIVE", **options})
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema]
    rules = [
        Rule(f"{f.name} is unreadable", F.col(f.name).isNull() | F.col(f.name).try_cast(f.dataType).isNotNull())
        for f in schema
        if not isinstance(f.dataType, StringType)
    ]
    parts = split(given, rules) if rules else Split(given, given.limit(0).withColumn("reject_reason", F.lit("")))
    return Split(parts.accepted.select(*typed), parts.rejected)


def load_orders_raw(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Order lines as delivered: 21 columns, dates still text."""
    return read_table(spark, path, schemas.ORDERS_RAW, fmt, **options)


def load_orders_typed(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Order lines with DATE columns."""
    return read_table(spark, path, schemas.ORDERS_TYPED, fmt, **options)


def load_temperature(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return daily_readings(read_table(spark, path, schemas.TEMPERATURE, fmt, **options))


def load_humidity(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return daily_readings(read_table(spark, path, schemas.HUMIDITY, fmt, **options))


def load_description(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return daily_texts(read_table(spark, path, schemas.DESCRIPTION, fmt, **options))


def daily_readings(table: DataFrame) -> DataFrame:
    """City spelled the way the joins expect it."""
    return table.withColumn("city", fold("city"))


def daily_texts(table: DataFrame) -> DataFrame:
    """As ``daily_readings``; the weather text is folded too, its given spelling kept beside it."""
    return daily_readings(table).withColumns(
        {"description_as_given": F.col("description"), "description": fold("description")}
    )


def scan_all(table: DataFrame) -> DataFrame:
    return table.select("*")


def conform(table: DataFrame, schema: StructType) -> DataFrame:
    """Declared columns in declared order and type, for tables that do not come from a file."""
    return table.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in schema])
