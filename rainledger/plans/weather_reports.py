"""Reports on order lines with the weather of their own date and city.

Inputs: ``enriched`` is ``sales_weather``, ``clean`` is ``sales_weather_clean`` and
``dated`` is the order lines with parsed dates. Columns called "orders" count lines.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainledger.functions.measures import mean, rounded_mean, total
from rainledger.functions.text import fold
from rainledger.operators.enrich import on_weather
from rainledger.plans.report import report

CLEAR = "sky is clear"
CLEAR_VIEW = "avg_sales_by_clear_weather"


def climate_by_city(enriched: DataFrame) -> DataFrame:
    measures = [mean("temperature").alias("avg_temp"), mean("humidity").alias("avg_humidity")]
    return report(enriched, ["city"], measures)


def avg_sales_region_city(enriched: DataFrame) -> DataFrame:
    return report(enriched, ["region", "city"], [mean("sales").alias("avg_sales")])


def sales_profit_region_state(enriched: DataFrame) -> DataFrame:
    measures = [total("sales").alias("total_sales"), total("profit").alias("total_profit")]
    return report(enriched, ["region", "state"], measures, [F.desc("total_sales")])


def customer_profit(enriched: DataFrame) -> DataFrame:
    keys = ["customer_id", "customer_name"]
    return report(enriched, keys, [total("profit").alias("total_profit")], [F.desc("total_profit")])


def customer_sales_profit(enriched: DataFrame) -> DataFrame:
    keys = ["customer_id", "customer_name"]
    measures = [total("sales").alias("total_sales"), total("profit").alias("total_profit")]
    return report(enriched, keys, measures, [F.desc("total_profit")])


def segment_product_performance(enriched: DataFrame) -> DataFrame:
    measures = [
        F.count("order_id").alias("number_of_orders"),
        total("sales").alias("total_sales"),
        total("profit").alias("total_profit"),
    ]
    keys = ["segment", "category", "sub_category"]
    return report(enriched, keys, measures, ["segment", F.desc("total_sales")])


def weather_on_high_sales_days(
    dated: DataFrame, description: DataFrame, above: float = 1000
) -> DataFrame:
    """Weather texts of the city days that sold for more than ``above``.

    The lines are added up per city and day before they meet the weather, so the join
    sees one row per city day.
    """
    days = report(
        dated.filter(F.col("order_date_proper").isNotNull()),
        ["city", F.col("order_date_proper").alias("order_date")],
        [total("sales").alias("total_sales")],
    ).filter(F.col("total_sales") > above)
    joined = on_weather(days, description.select("date", "city", "description"), "inner", "order_date")
    return joined.select("city", "order_date", "description").distinct()


def top_product_clear_sky_by_region(
    dated: DataFrame, description: DataFrame, text: str = CLEAR
) -> DataFrame:
    clear = description.filter(F.col("description").contains(fold(F.lit(text)))).select("date", "city")
    lines = on_weather(dated, clear, "inner", "order_date_proper")
    totals = report(lines, ["region", "product_name"], [total("sales").alias("total_sales")])
    best = Window.partitionBy("region").orderBy(F.desc("total_sales"))
    ranked = totals.withColumn("rnk", F.rank().over(best))
    return ranked.filter(F.col("rnk") == 1).select("region", "product_name", "total_sales")


def customers_below_region_avg(dated: DataFrame) -> DataFrame:
    """Customers whose average profit per line is below the average of their region.

    Both averages come from one aggregation per customer; the regional sums are added up
    from it, so no region is ever gathered in one task.
    """
    customers = report(
        dated,
        ["customer_id", "customer_name", "region"],
        [F.sum("profit").alias("profit_sum"), F.count("profit").alias("profit_lines")],
    )

    def ratio(profit: str, lines: str) -> Column:
        return F.try_divide(F.col(profit).cast("double"), F.col(lines).cast("double"))

    regions = customers.groupBy("region").agg(
        F.sum("profit_sum").alias("region_sum"), F.sum("profit_lines").alias("region_lines")
    )
    # No size check here: it would cost a pass over the lines. Adaptive execution sees the
    # size of the regional side when its stage is done, and broadcasts it or splits hot regions.
    compared = customers.withColumn("avg_profit_customer", ratio("profit_sum", "profit_lines")).join(
        regions.select("region", ratio("region_sum", "region_lines").alias("avg_profit_region")),
        "region",
    )
    below = compared.filter(F.col("avg_profit_customer") < F.col("avg_profit_region"))
    ordered = below.orderBy(F.desc("avg_profit_region"), "customer_id")
    return ordered.select("customer_id", "customer_name", "region", "avg_profit_customer")


def monthly_sales_temp_by_city(dated: DataFrame, temperature: DataFrame, year: int = 2014) -> DataFrame:
    # A range of dates reaches the scans of both tables, year() would not.
    first, last = F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31))
    in_year = dated.filter(F.col("order_date_proper").between(first, last))
    lines = on_weather(in_year, temperature, "inner", "order_date_proper")
    keys = ["city", F.month("order_date_proper").alias("month")]
    measures = [total("sales").alias("total_sales"), mean("temperature").alias("avg_temp")]
    return report(lines, keys, measures, ["city", "month"])


def subcategory_by_weather_top(view: DataFrame, weather: DataFrame, limit: int = 10) -> DataFrame:
    lines = on_weather(view, weather.select("date", "city", "description"), "inner", "order_date_proper")
    return report(
        lines,
        [F.col("description").alias("weather_type"), "sub_category"],
        [
            F.count("*").alias("order_count"),
            total("quantity").alias("total_units"),
            F.round(total("sales"), 2).alias("total_sales"),
        ],
        [F.desc("total_sales")],
        limit,
    )


def category_by_weather(view: DataFrame, weather: DataFrame) -> DataFrame:
    lines = on_weather(view, weather.select("date", "city", "description"), "inner", "order_date_proper")
    measures = [F.count("*").alias("orders"), total("quantity").alias("items_sold")]
    return report(lines, ["description", "category"], measures, [F.desc("items_sold")])


def top5_products_per_weather(clean: DataFrame, top: int = 5) -> DataFrame:
    """The best ``top`` products of every weather text; equal totals share a rank."""
    totals = report(
        clean.filter(F.col("weather_description").isNotNull()),
        ["weather_description", "product_name", "category", "sub_category"],
        [total("sales").alias("total_sales"), total("quantity").alias("total_quantity")],
    )
    best = Window.partitionBy("weather_description").orderBy(F.desc("total_sales"))
    ranked = totals.withColumn("rank_within_weather", F.rank().over(best))
    kept = ranked.filter(F.col("rank_within_weather") <= top)
    return kept.orderBy("weather_description", F.desc("total_sales"))


def temp_humidity_grid(clean: DataFrame, limit: int = 100) -> DataFrame:
    return report(
        clean.filter(F.col("temperature").isNotNull() & F.col("humidity").isNotNull()),
        [
            F.round("temperature", 0).alias("temp_rounded"),
            F.round("humidity", 0).alias("humidity_rounded"),
        ],
        [
            F.count("*").alias("num_orders"),
            total("sales").alias("total_sales"),
            total("profit").alias("total_profit"),
        ],
        [F.desc("total_sales")],
        limit,
    )


def best_seller_weather(clean: DataFrame) -> DataFrame:
    """Average weather of the best-selling product, per weather text.

    The best seller is found over all lines, the averages over those with both readings.
    One aggregation per product and text serves both steps.
    """
    both = F.col("temperature").isNotNull() & F.col("humidity").isNotNull()

    def known(column: str) -> Column:
        return F.when(both, F.col(column))

    parts = report(
        clean,
        ["product_name", "weather_description"],
        [
            F.sum("sales").alias("all_sales"),
            mean(known("temperature")).alias("avg_temp"),
            mean(known("humidity")).alias("avg_humidity"),
            F.count_if(both).alias("order_count"),
            F.sum(known("sales")).alias("total_sales"),
        ],
    )
    products = parts.groupBy("product_name").agg(F.sum("all_sales").alias("all_sales"))
    best = products.orderBy(F.desc("all_sales"), "product_name").limit(1).select("product_name")
    # One row by construction, hence the unchecked broadcast.
    found = parts.filter(F.col("order_count") > 0).join(F.broadcast(best), "product_name")
    return found.orderBy(F.desc("total_sales")).select(
        "product_name", "avg_temp", "avg_humidity", "weather_description", "order_count", "total_sales"
    )


def top_cities_favourable(
    clean: DataFrame,
    temperature: tuple[int, int] = (268, 299),
    humidity: tuple[int, int] = (48, 86),
    limit: int = 10,
) -> DataFrame:
    return report(
        clean.filter(F.col("temperature").between(*temperature) & F.col("humidity").between(*humidity)),
        ["city", "category", "sub_category"],
        [
            total("sales").alias("total_sales"),
            total("profit").alias("total_profit"),
            F.count("*").alias("num_orders"),
        ],
        [F.desc("total_sales")],
        limit,
    )


def weather_subcategory_top(clean: DataFrame, limit: int = 20) -> DataFrame:
    """Lines without a weather text form a group of their own."""
    return report(
        clean,
        ["weather_description", "sub_category"],
        [
            mean("temperature").alias("avg_temp"),
            mean("humidity").alias("avg_humidity"),
            total("sales").alias("total_sales"),
            F.count("*").alias("num_orders"),
        ],
        [F.desc("total_sales")],
        limit,
    )


def high_humidity_sales(clean: DataFrame, above: int = 70) -> DataFrame:
    return report(
        clean.filter(F.col("humidity") > above),
        ["region", "city", "category", "sub_category"],
        [
            F.count("*").alias("num_orders"),
            total("quantity").alias("total_quantity"),
            total("sales").alias("total_sales"),
        ],
        ["region", "city", F.desc("total_sales")],
    )


def ideal_weather_sales(
    clean: DataFrame,
    temperature: tuple[int, int] = (226, 299),
    humidity: tuple[int, int] = (50, 60),
) -> DataFrame:
    return report(
        clean.filter(F.col("temperature").between(*temperature) & F.col("humidity").between(*humidity)),
        ["region", "city", "category", "sub_category"],
        [
            F.count("*").alias("num_orders"),
            total("sales").alias("total_sales"),
            rounded_mean("temperature", 1).alias("avg_temp"),
            rounded_mean("humidity", 1).alias("avg_humidity"),
        ],
        [F.desc("total_sales")],
    )


def avg_sales_clear_sky(clean: DataFrame, text: str = CLEAR) -> DataFrame:
    clear = clean.filter(F.col("weather_description") == fold(F.lit(text)))
    return report(clear, ["region"], [mean("sales").alias("avg_sales")])


def clear_weather_view(spark: SparkSession, clean: DataFrame) -> DataFrame:
    avg_sales_clear_sky(clean).createOrReplaceTempView(CLEAR_VIEW)
    return spark.table(CLEAR_VIEW)
