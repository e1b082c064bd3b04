"""Order lines and weather tables derived from the TPC-H-like tables of the test data.

The mapping is described in FIXTURES.md; the DuckDB side of every check repeats it in SQL.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StructField, StructType

from rainledger.operators.impute import city_state_reference
from rainledger.operators.enrich import fold_city, parse_dates
from rainledger.operators.weather import combined_weather_left
from rainledger.shared import file_state, stored
from rainledger.sources import readers, schemas

FIRST_DAY = "1995-01-01"
# Weather texts of the fixture; the sixth is a missing text.
TEXTS = ("sky is clear", "scattered clouds", "light rain", "mist", "snow", None)
PRODUCT_COLUMNS = ("category", "sub_category", "product_name")


# The tables that the weather and place tables are derived from.
INPUTS = ("orders", "customer", "nation", "region", "lineitem")
LINE_INPUTS = (*INPUTS, "part")

#: The number of a share of the orders, from 0, and the number of shares.
Share = tuple[int, int]

_SCHEMAS: dict[tuple, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its footers are read for the schema only once per state of its files."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path, file_state(spark, path))
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    return file_state(spark, *[f"{sf_dir}/{name}.parquet" for name in INPUTS])


def _city_number() -> Column:
    return F.col("c_nationkey") * 3 + F.col("c_custkey") % 4


def _in_share(rows: DataFrame, key: str, share: Share | None) -> DataFrame:
    """Rows of one share of the orders, set apart at the scan before anything else is worked out about them."""
    if share is None:
        return rows
    number, of = share
    return rows.filter(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(of)) == number)


def _headers(spark: SparkSession, sf_dir: str, share: Share | None = None) -> DataFrame:
    """Orders with customer and place. Joined before the lines, which then shuffle only once."""
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        _in_share(table(spark, sf_dir, "orders"), "o_orderkey", share)
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    )


def typed_lines(
    spark: SparkSession, sf_dir: str, products: bool = True, share: Share | None = None
) -> DataFrame:
    """Order lines with DATE columns.

    Without ``products`` the three columns taken from ``part`` are left out, which saves
    the shuffle of all lines on the part key. With ``share`` only the lines of that share of the
    orders are given; every line belongs to one share.
    """
    # Both sides grow with the data. The hint keeps Catalyst from broadcasting either of them
    # because a compressed file or a narrow projection looks small.
    lines = _in_share(table(spark, sf_dir, "lineitem"), "l_orderkey", share)
    if products:
        # Before the headers: without them a line is less to shuffle on the part key.
        lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    lines = lines.join(_headers(spark, sf_dir, share).hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    order_date = F.col("o_orderdate").cast("date")
    rate = F.col("l_discount").cast(schemas.FRACTION)
    sales = F.col("l_extendedprice").cast(schemas.MONEY)
    columns = {
        "row_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        "order_id": F.concat(F.lit("O-"), F.col("o_orderkey")),
        "order_date": order_date,
        "ship_date": F.when(F.col("l_orderkey") % 11 != 0, F.date_add(order_date, F.col("l_linenumber"))),
        "ship_mode": F.col("o_orderpriority"),
        "customer_id": F.concat(F.lit("C-"), F.col("c_custkey")),
        "customer_name": F.col("c_name"),
        "segment": F.col("c_mktsegment"),
        "country": F.lit("COUNTRY_0"),
        "city": F.concat(F.lit("CITY_"), _city_number()),
        "state": F.col("n_name"),
        "postal_code": F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"),
        "region": F.col("r_name"),
        "product_id": F.concat(F.lit("P-"), F.col("l_partkey")),
        "category": F.col("p_type"),
        "sub_category": F.col("p_brand"),
        "product_name": F.col("p_name"),
        "sales": sales,
        "quantity": F.col("l_quantity").cast("int"),
        "discount": F.when(F.col("l_partkey") % 17 != 0, (rate * 8).cast(schemas.FRACTION)),
        "profit": (sales * (F.lit(Decimal("0.30")) - rate)).cast(schemas.MONEY),
    }
    return lines.select(
        *[c.alias(name) for name, c in columns.items() if products or name not in PRODUCT_COLUMNS]
    )


def raw_lines(
    spark: SparkSession, sf_dir: str, products: bool = True, share: Share | None = None
) -> DataFrame:
    """The same lines with both dates printed day first with a two-digit year."""
    return typed_lines(spark, sf_dir, products, share).withColumns(
        {name: F.date_format(name, "dd/MM/yy") for name in ("order_date", "ship_date")}
    )


def month_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines with both dates printed month first with a full year."""
    return typed_lines(spark, sf_dir).withColumns(
        {name: F.date_format(name, "M/d/yyyy") for name in ("order_date", "ship_date")}
    )


def faulty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines, some of them with an unreadable or missing date, no city, or no quantity."""
    row = F.col("row_id")
    spoiled = {
        "order_date": F.when(row % 103 != 5, F.when(row % 101 == 7, "soon").otherwise(F.col("order_date"))),
        "city": F.when(row % 107 != 11, F.col("city")),
        "quantity": F.when(row % 109 == 13, 0).otherwise(F.col("quantity")),
    }
    return raw_lines(spark, sf_dir).withColumns(spoiled)


def orders(spark: SparkSession, sf_dir: str, products: bool = True) -> DataFrame:
    """Typed lines with the city folded for the joins."""
    return fold_city(typed_lines(spark, sf_dir, products))


def dated_orders(
    spark: SparkSession, sf_dir: str, products: bool = True, share: Share | None = None
) -> DataFrame:
    """Raw lines with the city folded and both dates parsed."""
    return parse_dates(fold_city(raw_lines(spark, sf_dir, products, share)))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each day and city with an order, unless the day is a gap for the city."""
    placed = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    days = placed.select(
        F.col("o_orderdate").cast("date").alias("date"), _city_number().alias("c")
    ).distinct()
    dn, c = F.col("dn"), F.col("c")
    gap = (
        (dn % 50 == 9) | ((dn % 10 == 7) & (c != 75)) | ((dn % 10 == 3) & (c % 30 < 15))
    )
    return days.withColumn("dn", F.datediff("date", F.lit(FIRST_DAY).cast("date"))).filter(~gap)


def _hundredths(number: Column) -> Column:
    return (number.cast("decimal(10,0)") * F.lit(Decimal("0.01"))).cast(schemas.READING)


def _temperature(cells: DataFrame) -> DataFrame:
    dn, c = F.col("dn"), F.col("c")
    return cells.filter((dn * 7 + c * 3) % 5 != 0).withColumn(
        "temperature", _hundredths(25500 + (dn * 37 + c * 101) % 5500)
    )


def _humidity(cells: DataFrame) -> DataFrame:
    dn, c = F.col("dn"), F.col("c")
    return cells.filter((dn * 3 + c * 5) % 7 != 0).withColumn(
        "humidity", _hundredths(3000 + (dn * 53 + c * 17) % 7000)
    )


def _description(cells: DataFrame) -> DataFrame:
    dn, c = F.col("dn"), F.col("c")
    texts = F.array(*[F.lit(text) for text in TEXTS])
    return cells.filter((dn + c * 2) % 6 != 0).withColumn(
        "description", F.element_at(texts, ((dn * 5 + c * 11) % 6 + 1).cast("int"))
    )


_BUILDERS = {
    "temperature": (_temperature, schemas.TEMPERATURE),
    "humidity": (_humidity, schemas.HUMIDITY),
    "description": (_description, schemas.DESCRIPTION),
}


def _delivered(cells: DataFrame, measure: str) -> DataFrame:
    build, schema = _BUILDERS[measure]
    placed = build(cells).withColumn("city", F.concat(F.lit("CITY_"), F.col("c")))
    return placed.select(*schema.fieldNames())


def weather_as_delivered(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    """One weather table before it is read in: day, city as given, and the measure."""
    return _delivered(_cells(spark, sf_dir), measure)


def _stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells, written once so that the three tables share one pass over the orders."""
    schema = StructType(
        [StructField("date", DateType()), StructField("c", LongType()), StructField("dn", IntegerType())]
    )
    return stored(spark, sf_dir, "cells", schema, lambda: _cells(spark, sf_dir), _state(spark, sf_dir))


def weather(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    """One weather table, imported once per application."""
    schema = _BUILDERS[measure][1]
    imported = stored(
        spark,
        sf_dir,
        measure,
        schema,
        lambda: _delivered(_stored_cells(spark, sf_dir), measure),
        _state(spark, sf_dir),
    )
    if measure == "description":
        return readers.daily_texts(imported)
    return readers.daily_readings(imported)


def weather_tables(spark: SparkSession, sf_dir: str, *measures: str) -> dict[str, DataFrame]:
    return {m: weather(spark, sf_dir, m) for m in measures or tuple(_BUILDERS)}


def weather_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tables combined, written once because many reports join it."""
    return stored(
        spark,
        sf_dir,
        "weather_condition",
        schemas.COMBINED_WEATHER,
        lambda: combined_weather_left(**weather_tables(spark, sf_dir)),
        _state(spark, sf_dir),
    )


def reference(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The (city, state, region) table, written once; from stored ``lines`` if there are any."""
    return stored(
        spark,
        sf_dir,
        "city_state_reference",
        schemas.CITY_STATE_REFERENCE,
        lambda: city_state_reference(orders(spark, sf_dir, products=False) if lines is None else lines),
        _state(spark, sf_dir),
    )
