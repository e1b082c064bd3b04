"""Queries that leave out a join give what they give with it."""

from collections import Counter

import pytest

from rainledger.operators import quality
from rainledger.plans import catalogue
from rainledger.plans import final_reports as final_
from rainledger.plans import weather_reports as weather_


def rows(frame):
    return Counter(map(tuple, frame.collect()))


@pytest.mark.parametrize(
    "report",
    [
        final_.top_products_by_profit,
        final_.monthly_trend,
        final_.segment_performance,
        final_.shipping_efficiency,
        final_.region_state_performance,
        final_.discount_effect,
    ],
)
def test_reports_without_weather_columns(spark, sf_dir, report):
    found = rows(report(catalogue.sliced(spark, sf_dir)))
    assert found and found == rows(report(catalogue.final(spark, sf_dir)))


@pytest.mark.parametrize(
    ("report", "table"),
    [
        (final_.monthly_trend, catalogue.sliced),
        (final_.segment_performance, catalogue.sliced),
        (final_.discount_effect, catalogue.sliced),
        (final_.weather_by_weekday, catalogue.final),
        (quality.weather_coverage, catalogue.final),
        (quality.duplicate_row_ids, catalogue.clean),
        (weather_.temp_humidity_grid, catalogue.clean),
        (weather_.avg_sales_clear_sky, catalogue.clean),
        (weather_.climate_by_city, catalogue.enriched),
        (weather_.customer_sales_profit, catalogue.enriched),
        (quality.order_id_multiplicity, catalogue.enriched),
        (weather_.customers_below_region_avg, catalogue.dated),
    ],
)
def test_reports_without_product_columns(spark, sf_dir, report, table):
    assert rows(report(table(spark, sf_dir))) == rows(report(table(spark, sf_dir, products=False)))
