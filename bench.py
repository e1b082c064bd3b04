"""Times the pipelines and their reports, and prints one JSON line.

As a user would: the derived tables are built and stored once, then every report reads
the stored table. Building counts too and has its own entries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402

from rainledger.operators import enrich, quality  # noqa: E402
from rainledger.plans import catalogue  # noqa: E402
from rainledger.plans import final_reports as final_  # noqa: E402
from rainledger.plans import weather_reports as weather_  # noqa: E402
from rainledger.session import local_session  # noqa: E402
from rainledger.shared import new_folder  # noqa: E402
from rainledger.sources import driver_tables as source  # noqa: E402
from rainledger.sources import writers  # noqa: E402


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


class Stopwatch:
    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    def time(self, name: str, work: Callable[[], object]) -> None:
        start = time.perf_counter()
        work()
        self.seconds[name] = round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    # Starting the JVM and loading its classes is not part of any query.
    run(source.table(spark, sf_dir, "customer").groupBy("c_nationkey").count())
    watch = Stopwatch()
    folders = {name: new_folder(spark, name) for name in ("sales_weather", "clean", "final", "orders")}

    def build(name: str, frame: Callable[[], DataFrame]) -> DataFrame:
        watch.time(f"build_{name}", lambda: frame().write.parquet(folders[name]))
        return spark.read.parquet(folders[name])

    watch.time("import_weather", lambda: source.weather_condition(spark, sf_dir))
    dated = build("orders", lambda: catalogue.dated(spark, sf_dir))
    watch.time("import_reference", lambda: source.reference(spark, sf_dir, dated))
    enriched = build("sales_weather", lambda: catalogue.enriched(spark, sf_dir))
    watch.time(
        "build_clean", lambda: writers.write_clean(enrich.sales_weather_clean(enriched), folders["clean"])
    )
    clean = writers.read_clean(spark, folders["clean"])
    final = build("final", lambda: catalogue.final(spark, sf_dir))

    temperature = source.weather(spark, sf_dir, "temperature")
    description = source.weather(spark, sf_dir, "description")
    condition = source.weather_condition(spark, sf_dir)

    on_enriched = [
        weather_.climate_by_city,
        weather_.avg_sales_region_city,
        weather_.sales_profit_region_state,
        weather_.customer_profit,
        weather_.customer_sales_profit,
        weather_.segment_product_performance,
        quality.order_id_multiplicity,
    ]
    on_clean = [
        weather_.top5_products_per_weather,
        weather_.temp_humidity_grid,
        weather_.best_seller_weather,
        weather_.top_cities_favourable,
        weather_.weather_subcategory_top,
        weather_.high_humidity_sales,
        weather_.ideal_weather_sales,
        weather_.avg_sales_clear_sky,
        quality.duplicate_row_ids,
        quality.dedupe_row_id,
    ]
    on_final = [
        final_.top_products_by_profit,
        final_.weather_impact,
        final_.monthly_trend,
        final_.segment_performance,
        final_.shipping_efficiency,
        final_.region_state_performance,
        final_.weather_category,
        final_.discount_effect,
        final_.weather_by_weekday,
        quality.weather_coverage,
    ]
    reports: dict[str, Callable[[], DataFrame]] = {
        "scan_combined_weather": lambda: condition,
        "scan_sales_weather": lambda: enriched,
        "scan_sales_weather_clean": lambda: clean,
        "weather_on_high_sales_days": lambda: weather_.weather_on_high_sales_days(
            dated, description, catalogue.HIGH_SALES
        ),
        "top_product_clear_sky_by_region": lambda: weather_.top_product_clear_sky_by_region(
            dated, description
        ),
        "customers_below_region_avg": lambda: weather_.customers_below_region_avg(dated),
        "monthly_sales_temp_by_city": lambda: weather_.monthly_sales_temp_by_city(
            dated, temperature, catalogue.YEAR
        ),
        "subcategory_by_weather_top": lambda: weather_.subcategory_by_weather_top(dated, condition),
        "category_by_weather": lambda: weather_.category_by_weather(dated, condition),
        "sales_by_temp_range": lambda: final_.sales_by_temp_range(final, temp_unit="kelvin"),
    }
    for table, functions in ((enriched, on_enriched), (clean, on_clean), (final, on_final)):
        for function in functions:
            reports[function.__name__] = lambda f=function, t=table: f(t)
    for name, report in reports.items():
        watch.time(name, lambda report=report: run(report()))

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(watch.seconds.values()), 3),
                "unit": "sec",
                "queries": watch.seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "rows": {
                    "orders": dated.count(),
                    "sales_weather": enriched.count(),
                    "sales_weather_clean": clean.count(),
                    "sales_weather_final": final.count(),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
