"""Every registered query, built on the driver tables.

Arguments that differ from the defaults fit the dates and amounts of the test data; they
are listed in FIXTURES.md.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DateType, DecimalType, IntegerType, ShortType

from rainledger.functions.dates import MONTH_FIRST
from rainledger.operators import enrich, impute, quality
from rainledger.operators import weather as combine
from rainledger.operators.lookup import join_lookup, measured_bytes
from rainledger.plans import final_reports as final_
from rainledger.plans import weather_reports as weather_
from rainledger.shared import file_bytes, kept, new_folder, shuffles_deleted
from rainledger.sources import driver_tables as source
from rainledger.sources import clean_table, month_state, readers, schemas, writers

Query = Callable[[SparkSession, str], DataFrame]

SLICE = (date(1996, 10, 1), date(2000, 11, 30))
YEAR = 1998
LOOKED_UP = {"order_id": "O-7", "customer_id": "C-7", "product_id": "P-7"}
STATE_UNTIL = date(1999, 12, 15)
HIGH_SALES = 100000
#: Bytes of input files whose lines are stored at once, and the most shares of the orders: each share reads all inputs again.
SHARE_BYTES = 128 << 20
MOST_SHARES = 8
PLACE = ("row_id", "order_date", "city", "state", "region")


# Tables


def dated(spark: SparkSession, sf: str, products: bool = True) -> DataFrame:
    return source.dated_orders(spark, sf, products)


def view(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.orders_view(dated(spark, sf))


def enriched(spark: SparkSession, sf: str, products: bool = True) -> DataFrame:
    return enrich.sales_weather(dated(spark, sf, products), source.weather_condition(spark, sf))


def clean(spark: SparkSession, sf: str, products: bool = True) -> DataFrame:
    return enrich.sales_weather_clean(enriched(spark, sf, products))


def stored_clean(spark: SparkSession, sf: str) -> str:
    """The folder of a new clean table; the lines of large inputs are joined and written in shares of the orders."""
    path = new_folder(spark, "sales_weather_clean")
    bytes_in = file_bytes(spark, *[f"{sf}/{name}.parquet" for name in source.LINE_INPUTS])
    shares = min(MOST_SHARES, 1 + bytes_in // SHARE_BYTES)
    with shuffles_deleted(spark):
        weather = source.weather_condition(spark, sf)
        size = measured_bytes({"weather": weather})["weather"]
        lines = [source.dated_orders(spark, sf, share=(n, shares) if shares > 1 else None) for n in range(shares)]
        enriched_lines = [enrich.sales_weather(part, weather, size, ready=True) for part in lines]
        writers.write_clean_parts([enrich.sales_weather_clean(part) for part in enriched_lines], path)
    return path


def sliced(spark: SparkSession, sf: str, products: bool = True) -> DataFrame:
    return enrich.slice_by_date(source.orders(spark, sf, products), *SLICE)


def final(spark: SparkSession, sf: str, *measures: str, products: bool = True) -> DataFrame:
    """``sales_weather_final`` with all weather columns, or only those a report needs."""
    tables = source.weather_tables(spark, sf, *measures)
    return impute.sales_weather_final(
        sliced(spark, sf, products), tables, source.reference(spark, sf)
    )


# Queries that need more than one call


def load_orders_raw(spark: SparkSession, sf: str) -> DataFrame:
    return readers.conform(source.raw_lines(spark, sf), schemas.ORDERS_RAW)


def load_orders_typed(spark: SparkSession, sf: str) -> DataFrame:
    return readers.conform(source.typed_lines(spark, sf), schemas.ORDERS_TYPED)


def load_temperature(spark: SparkSession, sf: str) -> DataFrame:
    delivered = source.weather_as_delivered(spark, sf, "temperature")
    return readers.daily_readings(readers.conform(delivered, schemas.TEMPERATURE))


def load_humidity(spark: SparkSession, sf: str) -> DataFrame:
    delivered = source.weather_as_delivered(spark, sf, "humidity")
    return readers.daily_readings(readers.conform(delivered, schemas.HUMIDITY))


def load_description(spark: SparkSession, sf: str) -> DataFrame:
    delivered = source.weather_as_delivered(spark, sf, "description")
    return readers.daily_texts(readers.conform(delivered, schemas.DESCRIPTION))


def write_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the clean table and reads it back."""
    return writers.read_clean(spark, stored_clean(spark, sf))


def insert_clean(spark: SparkSession, sf: str) -> DataFrame:
    """A strict load of the lines of the first years, one of all lines, and that again, read back.

    The lines are joined once, as a delivery that is stored, and not again by every load.
    """
    path = new_folder(spark, "clean_table")
    lines = kept(enrich.typed_lines(enriched(spark, sf)), "delivered_lines")
    early = lines.filter(F.col("order_date") < F.lit(SLICE[0]))
    for load in (early, lines, lines):
        clean_table.insert(load, path, enrich.line_rules())
    return clean_table.read(spark, path)


def load_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What became of lines of which some break rules, counted while they were written."""
    path = new_folder(spark, "clean_table")
    load = clean_table.insert(enrich.typed_lines(faulty(spark, sf)), path, enrich.line_rules(), strict=False)
    return load.as_rows(spark)


def loaded_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that a load set apart, read back from beside the table."""
    path = new_folder(spark, "clean_table")
    clean_table.insert(enrich.typed_lines(faulty(spark, sf)), path, enrich.line_rules(), strict=False)
    return clean_table.rejected(spark, path).select(
        "row_id", "order_id", "order_date_text", "ship_date_text", "city", "reject_reason"
    )


def find_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One order, one customer and one product, looked up in the stored table."""
    stored = writers.read_clean(spark, stored_clean(spark, sf))
    found = [
        writers.find_lines(stored, **{column: value}).withColumn("looked_up", F.lit(column))
        for column, value in LOOKED_UP.items()
    ]
    return reduce(DataFrame.unionAll, found)


def bucketed_sales_weather(spark: SparkSession, sf: str) -> DataFrame:
    """``sales_weather_joined`` on lines that are stored by the weather's keys."""
    path = new_folder(spark, "bucketed_lines")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = writers.write_bucketed(sliced(spark, sf), path.rsplit("/", 1)[-1].replace("-", "_"), path, buckets)
    return enrich.sales_weather_joined(lines, **source.weather_tables(spark, sf))


def clean_catalog_view(spark: SparkSession, sf: str) -> DataFrame:
    """The stored clean table through a view of the catalog, read by another session."""
    path = stored_clean(spark, sf)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    writers.clean_view(spark, path, name)
    return spark.newSession().table(name)


def month_states(spark: SparkSession, sf: str) -> DataFrame:
    """The state of the lines' months, put together from a first load, an appended rest, and one month done again."""
    path = new_folder(spark, "month_state")
    lines = sliced(spark, sf, products=False)
    for first, last in ((SLICE[0], STATE_UNTIL), (STATE_UNTIL, SLICE[1]), (STATE_UNTIL, STATE_UNTIL)):
        month_state.refresh(lines, path, first, last)
    return month_state.read(spark, path)


def check_not_null(spark: SparkSession, sf: str) -> DataFrame:
    # The test data lacks no required value; two optional columns give rejects to count.
    columns = (*schemas.REQUIRED, "ship_date", "discount")
    rules = quality.not_null_rules(columns)
    return quality.outcome_counts(source.orders(spark, sf, products=False), rules)


def check_ranges(spark: SparkSession, sf: str) -> DataFrame:
    # No line breaks the default rules; a lower ceiling gives rejects to count.
    rules = quality.range_rules(max_discount=Decimal("0.60"))
    return quality.outcome_counts(source.orders(spark, sf, products=False), rules)


def check_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of all key rules, told apart by name."""
    lines = source.orders(spark, sf, products=False)
    rules = {
        "orders row_id": (lines, ["row_id"]),
        "orders order_id": (lines, ["order_id"]),
        "temperature": (source.weather(spark, sf, "temperature"), ["date", "city"]),
        "humidity": (source.weather(spark, sf, "humidity"), ["date", "city"]),
        "description": (source.weather(spark, sf, "description"), ["date", "city"]),
        "city_state_reference": (source.reference(spark, sf), ["city", "state"]),
    }
    found = [
        quality.check_unique(table, keys, primary=not name.startswith("orders")).select(
            F.lit(name).alias("rule"), quality.key_text(keys).alias("key"), "n_rows"
        )
        for name, (table, keys) in rules.items()
    ]
    return reduce(DataFrame.unionAll, found)


def check_length(spark: SparkSession, sf: str) -> DataFrame:
    # Every text fits its declared limit; a shorter one for the product name gives a violation.
    return quality.check_length(
        source.raw_lines(spark, sf), {**schemas.RAW_TEXT_LIMITS, "product_name": 9}
    )


def row_count(spark: SparkSession, sf: str) -> DataFrame:
    """The steps of the lines in one pass over them, and the rows of the weather."""
    weather = source.weather_condition(spark, sf)
    cells = weather.groupBy(F.col("date").alias("order_date_proper"), "city").agg(F.count("*").alias("cells"))
    lines = join_lookup(dated(spark, sf, products=False), cells, ["order_date_proper", "city"], "left")
    cells_met = F.coalesce("cells", F.lit(0))
    judged = enrich.typed_lines(lines.withColumn("cells_met", cells_met), "cells_met")
    good = quality.reject_reason(enrich.line_rules()).isNull()
    steps = {
        "orders_raw": F.lit(1),
        "sales_weather": F.col("cells_met"),
        "sales_weather_clean": F.when(good, F.col("cells_met")).otherwise(0),
        "slice": F.col("order_date").between(*[F.lit(day) for day in SLICE]).cast("int"),
    }
    combined = quality.row_count(weather).select(F.lit("combined_weather").alias("step"), "n_rows")
    return quality.row_counts(judged, steps).unionAll(combined)


def faulty(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.parse_dates(enrich.fold_city(source.faulty_lines(spark, sf)))


def parse_dates_month_first(spark: SparkSession, sf: str) -> DataFrame:
    lines = enrich.fold_city(source.month_first_lines(spark, sf))
    return enrich.parse_dates(lines, MONTH_FIRST)


def impute_one(spark: SparkSession, sf: str, measure: str) -> DataFrame:
    lines = source.orders(spark, sf, products=False).select(*PLACE)
    fill = {
        "temperature": impute.impute_temperature,
        "humidity": impute.impute_humidity,
        "description": impute.impute_description,
    }[measure]
    return fill(lines, source.weather(spark, sf, measure), source.reference(spark, sf))


def impute_level(spark: SparkSession, sf: str) -> DataFrame:
    lines = source.orders(spark, sf, products=False).select(*PLACE)
    return impute.impute_level(
        lines, source.weather_tables(spark, sf), source.reference(spark, sf)
    )


def _weather_only(combiner: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf: combiner(
        load_temperature(spark, sf), load_humidity(spark, sf), load_description(spark, sf)
    )


QUERIES: dict[str, Query] = {
    # sources, views, layout
    "load_orders_raw": load_orders_raw,
    "load_orders_typed": load_orders_typed,
    "load_temperature": load_temperature,
    "load_humidity": load_humidity,
    "load_description": load_description,
    "scan_all": lambda s, d: readers.scan_all(source.raw_lines(s, d)),
    "sample_rows": lambda s, d: final_.sample_rows(final(s, d, products=False)),
    "write_clean": write_clean,
    "insert_clean": insert_clean,
    "find_lines": find_lines,
    "bucketed_sales_weather": bucketed_sales_weather,
    "clean_catalog_view": clean_catalog_view,
    "load_outcomes": load_outcomes,
    "loaded_rejects": loaded_rejects,
    "orders_view": view,
    "clear_weather_view": lambda s, d: weather_.clear_weather_view(s, clean(s, d, products=False)),
    # joins
    "combined_weather_inner": _weather_only(combine.combined_weather_inner),
    "combined_weather_as_written": _weather_only(combine.combined_weather_as_written),
    "combined_weather_left": _weather_only(combine.combined_weather_left),
    "sales_weather": enriched,
    "sales_weather_joined": lambda s, d: enrich.sales_weather_joined(
        sliced(s, d), **source.weather_tables(s, d)
    ),
    # filling gaps
    "city_state_reference": lambda s, d: impute.city_state_reference(
        source.orders(s, d, products=False)
    ),
    "impute_temperature": lambda s, d: impute_one(s, d, "temperature"),
    "impute_humidity": lambda s, d: impute_one(s, d, "humidity"),
    "impute_description": lambda s, d: impute_one(s, d, "description"),
    "impute_level": impute_level,
    "sales_weather_final": final,
    # cleaning and checks
    "parse_dates": dated,
    "parse_dates_month_first": parse_dates_month_first,
    "rejected_lines": lambda s, d: enrich.rejected_lines(faulty(s, d)),
    "line_outcomes": lambda s, d: enrich.line_outcomes(faulty(s, d), source.weather_condition(s, d)),
    "sales_weather_clean": clean,
    "slice_by_date": sliced,
    "date_range": lambda s, d: enrich.date_range(source.orders(s, d, products=False)),
    "check_not_null": check_not_null,
    "check_ranges": check_ranges,
    "check_unique": check_unique,
    "check_length": check_length,
    "order_id_multiplicity": lambda s, d: quality.order_id_multiplicity(
        enriched(s, d, products=False)
    ),
    "duplicate_row_ids": lambda s, d: quality.duplicate_row_ids(clean(s, d, products=False)),
    "null_row_id_count": lambda s, d: quality.null_row_id_count(clean(s, d, products=False)),
    "row_count": row_count,
    "weather_coverage": lambda s, d: quality.weather_coverage(final(s, d, products=False)),
    "dedupe_row_id": lambda s, d: quality.dedupe_row_id(clean(s, d)),
    # reports on lines with their own weather
    "climate_by_city": lambda s, d: weather_.climate_by_city(enriched(s, d, products=False)),
    "avg_sales_region_city": lambda s, d: weather_.avg_sales_region_city(
        enriched(s, d, products=False)
    ),
    "sales_profit_region_state": lambda s, d: weather_.sales_profit_region_state(
        enriched(s, d, products=False)
    ),
    "customer_profit": lambda s, d: weather_.customer_profit(enriched(s, d, products=False)),
    "customer_sales_profit": lambda s, d: weather_.customer_sales_profit(
        enriched(s, d, products=False)
    ),
    "segment_product_performance": lambda s, d: weather_.segment_product_performance(enriched(s, d)),
    "weather_on_high_sales_days": lambda s, d: weather_.weather_on_high_sales_days(
        dated(s, d, products=False), source.weather(s, d, "description"), HIGH_SALES
    ),
    "top_product_clear_sky_by_region": lambda s, d: weather_.top_product_clear_sky_by_region(
        dated(s, d), source.weather(s, d, "description")
    ),
    "customers_below_region_avg": lambda s, d: weather_.customers_below_region_avg(
        dated(s, d, products=False)
    ),
    "monthly_sales_temp_by_city": lambda s, d: weather_.monthly_sales_temp_by_city(
        dated(s, d, products=False), source.weather(s, d, "temperature"), YEAR
    ),
    "subcategory_by_weather_top": lambda s, d: weather_.subcategory_by_weather_top(
        view(s, d), source.weather_condition(s, d)
    ),
    "category_by_weather": lambda s, d: weather_.category_by_weather(
        view(s, d), source.weather_condition(s, d)
    ),
    "top5_products_per_weather": lambda s, d: weather_.top5_products_per_weather(clean(s, d)),
    "temp_humidity_grid": lambda s, d: weather_.temp_humidity_grid(clean(s, d, products=False)),
    "best_seller_weather": lambda s, d: weather_.best_seller_weather(clean(s, d)),
    "top_cities_favourable": lambda s, d: weather_.top_cities_favourable(clean(s, d)),
    "weather_subcategory_top": lambda s, d: weather_.weather_subcategory_top(clean(s, d)),
    "high_humidity_sales": lambda s, d: weather_.high_humidity_sales(clean(s, d)),
    "ideal_weather_sales": lambda s, d: weather_.ideal_weather_sales(clean(s, d)),
    "avg_sales_clear_sky": lambda s, d: weather_.avg_sales_clear_sky(clean(s, d, products=False)),
    # reports on all lines of the period; those without a weather column take the lines as they are,
    # because filling in weather neither adds nor drops a line (tests/test_shortcuts.py)
    "top_products_by_profit": lambda s, d: final_.top_products_by_profit(sliced(s, d)),
    "weather_impact": lambda s, d: final_.weather_impact(
        final(s, d, "description", products=False)
    ),
    "monthly_trend_from_state": lambda s, d: month_state.monthly_trend(month_states(s, d)),
    "segment_performance_from_state": lambda s, d: month_state.segment_performance(month_states(s, d)),
    "monthly_trend": lambda s, d: final_.monthly_trend(sliced(s, d, products=False)),
    "sales_by_temp_range": lambda s, d: final_.sales_by_temp_range(
        final(s, d, "temperature", products=False), temp_unit="kelvin"
    ),
    "segment_performance": lambda s, d: final_.segment_performance(sliced(s, d, products=False)),
    "shipping_efficiency": lambda s, d: final_.shipping_efficiency(sliced(s, d, products=False)),
    "region_state_performance": lambda s, d: final_.region_state_performance(
        sliced(s, d, products=False)
    ),
    "weather_category": lambda s, d: final_.weather_category(final(s, d, "description")),
    "discount_effect": lambda s, d: final_.discount_effect(sliced(s, d, products=False)),
    "weather_by_weekday": lambda s, d: final_.weather_by_weekday(
        final(s, d, "description", products=False)
    ),
}


def comparable(result: DataFrame) -> DataFrame:
    """Amounts as DOUBLE, whole numbers as BIGINT, dates as ISO text: equal in every engine."""
    columns = []
    for field in result.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, ByteType | ShortType | IntegerType):
            column = column.cast("long")
        elif isinstance(field.dataType, DateType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return result.select(*columns)


def registered() -> dict[str, Query]:
    return {
        name: lambda spark, sf_dir, query=query: comparable(query(spark, sf_dir))
        for name, query in QUERIES.items()
    }
