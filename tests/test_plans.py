"""What Catalyst makes of the queries: no Python, no needless shuffle, early limits."""

import re

import pytest

from rainledger.plans.catalogue import QUERIES


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def initial(text):
    return text.split("== Initial Plan ==")[-1]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    for node in ("Python", "ArrowEval", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_rank_limits_before_the_shuffle(spark, sf_dir):
    for name in ("top5_products_per_weather", "top_product_clear_sky_by_region", "dedupe_row_id"):
        assert plan(spark, sf_dir, name).count("WindowGroupLimit") == 2


def test_top_k_is_one_operator(spark, sf_dir):
    for name in ("subcategory_by_weather_top", "temp_humidity_grid", "top_products_by_profit"):
        text = plan(spark, sf_dir, name)
        assert "TakeOrderedAndProject" in text
        assert "rangepartitioning" not in text


def test_lines_are_shuffled_once_and_weather_is_broadcast(spark, sf_dir):
    text = plan(spark, sf_dir, "avg_sales_clear_sky")
    # lines and headers on the order key, then the groups on region
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 3
    assert "BroadcastHashJoin [order_date_proper" in text


def test_weather_filter_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "avg_sales_clear_sky")
    assert "PushedFilters: [IsNotNull(description), EqualTo(description,sky is clear)" in text
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    assert not any("l_tax" in s or "o_totalprice" in s for s in schemas)


def test_date_slice_reaches_the_scan(spark, sf_dir):
    assert "GreaterThanOrEqual(o_orderdate,1996-10-01" in plan(spark, sf_dir, "monthly_trend")


def test_one_scan_of_the_lines_serves_both_steps(spark, sf_dir):
    for name in ("customers_below_region_avg", "best_seller_weather"):
        frame = QUERIES[name](spark, sf_dir)
        frame.collect()
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in text.split("== Initial Plan ==")[0], name


def test_gap_filling_moves_the_lines_no_further(spark, sf_dir):
    text = initial(plan(spark, sf_dir, "sales_weather_final"))
    assert len(re.findall(r"BroadcastHashJoin \[order_date#\d+(, \w+#\d+)?\], .*LeftOuter, BuildRight", text)) == 4
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", text)) == 1
