"""Ties, missing values and edges the test data does not reach."""

from datetime import date
from decimal import Decimal

from rainledger.plans import final_reports as final_
from rainledger.plans import weather_reports as weather_

DAY = date(2014, 3, 5)


def money(value):
    return Decimal(value).quantize(Decimal("0.01"))


def test_products_tied_at_rank_five_all_stay(spark):
    totals = [60, 50, 40, 30, 20, 20, 20, 10]
    rows = [("mist", f"p{i}", "c", "s", money(v), 1) for i, v in enumerate(totals)]
    rows += [(None, "p0", "c", "s", money(99), 1)]
    clean = spark.createDataFrame(
        rows,
        "weather_description string, product_name string, category string, sub_category string, "
        "sales decimal(10,2), quantity int",
    )
    found = weather_.top5_products_per_weather(clean).collect()
    assert [r.rank_within_weather for r in found] == [1, 2, 3, 4, 5, 5, 5]
    assert {r.weather_description for r in found} == {"mist"}


def test_best_product_of_a_region_may_be_shared(spark):
    dated = spark.createDataFrame(
        [(DAY, "a", "north", p, money(v)) for p, v in (("x", 5), ("y", 5), ("z", 4))],
        "order_date_proper date, city string, region string, product_name string, sales decimal(10,2)",
    )
    texts = spark.createDataFrame([(DAY, "a", "the sky is clear now")], "date date, city string, description string")
    found = weather_.top_product_clear_sky_by_region(dated, texts).collect()
    assert {r.product_name for r in found} == {"x", "y"}


def test_customers_below_average(spark):
    rows = [("c1", "n1", "r", money(10)), ("c1", "n1", "r", money(0)), ("c2", "n2", "r", money(8)), ("c3", "n3", "r", None)]
    dated = spark.createDataFrame(
        rows, "customer_id string, customer_name string, region string, profit decimal(10,2)"
    )
    found = [tuple(r) for r in weather_.customers_below_region_avg(dated).collect()]
    assert found == [("c1", "n1", "r", 5.0)]  # the region's average over lines is 6


def test_best_seller_is_found_over_lines_without_weather_too(spark):
    clean = spark.createDataFrame(
        [
            ("pen", "mist", None, money(50), money(100)),
            ("pen", "snow", money(270), money(60), money(1)),
            ("ink", "snow", money(280), money(40), money(90)),
        ],
        "product_name string, weather_description string, temperature decimal(10,2), "
        "humidity decimal(10,2), sales decimal(10,2)",
    )
    found = [tuple(r) for r in weather_.best_seller_weather(clean).collect()]
    assert found == [("pen", 270.0, 60.0, "snow", 1, money(1))]


def test_count_of_orders_skips_missing_ids(spark):
    enriched = spark.createDataFrame(
        [("s", "c", "d", "o1", money(1), money(1)), ("s", "c", "d", None, money(1), None)],
        "segment string, category string, sub_category string, order_id string, "
        "sales decimal(10,2), profit decimal(10,2)",
    )
    row = weather_.segment_product_performance(enriched).first()
    assert (row.number_of_orders, row.total_sales, row.total_profit) == (1, money(2), money(1))


def test_high_sales_day_needs_more_than_the_limit(spark):
    dated = spark.createDataFrame(
        [(DAY, "a", money(600)), (DAY, "a", money(400)), (DAY, "b", money("1000.01")), (None, "a", money(5000))],
        "order_date_proper date, city string, sales decimal(10,2)",
    )
    texts = spark.createDataFrame([(DAY, "a", "mist"), (DAY, "b", None)], "date date, city string, description string")
    found = [tuple(r) for r in weather_.weather_on_high_sales_days(dated, texts).collect()]
    assert found == [("b", DAY, None)]


def test_weekdays_run_from_monday(spark):
    final = spark.createDataFrame(
        [(date(2024, 1, d), "mist", money(d)) for d in range(7, 0, -1)],
        "order_date date, weather_condition string, sales decimal(10,2)",
    )
    found = final_.weather_by_weekday(final).collect()
    assert [r.day_of_week for r in found] == [
        "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"
    ]


def test_zero_sales_have_no_margin(spark):
    final = spark.createDataFrame(
        [("p", "c", "s", 1, money(0), money(5))],
        "product_name string, category string, sub_category string, quantity int, "
        "sales decimal(10,2), profit decimal(10,2)",
    )
    row = final_.top_products_by_profit(final).first()
    assert (row.total_units_sold, row.profit_margin) == (1, None)


def test_temperature_units(spark):
    final = spark.createDataFrame(
        [(money("283.15"), money(1), money(1)), (money("10"), money(1), money(1))],
        "temperature decimal(10,2), sales decimal(10,2), profit decimal(10,2)",
    )
    kelvin = {r.temp_range for r in final_.sales_by_temp_range(final, temp_unit="kelvin").collect()}
    celsius = {r.temp_range for r in final_.sales_by_temp_range(final).collect()}
    assert kelvin == {"0-10°C", "Below 0°C"}
    assert celsius == {"Above 30°C", "0-10°C"}


def test_clear_sky_view_can_be_queried_by_name(spark):
    clean = spark.createDataFrame(
        [("sky is clear", "north", money(4)), ("sky is clear", "north", money(2)), ("mist", "north", money(9))],
        "weather_description string, region string, sales decimal(10,2)",
    )
    weather_.clear_weather_view(spark, clean)
    assert tuple(spark.sql(f"SELECT * FROM {weather_.CLEAR_VIEW}").first()) == ("north", 3.0)
