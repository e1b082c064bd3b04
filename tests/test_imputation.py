"""The four rungs on hand-made tables, and against a plain Python version."""

from datetime import date
from decimal import ROUND_HALF_UP, Decimal

import pytest

from rainledger.operators import impute
from rainledger.operators.lookup import LIMIT_SETTING

D1, D2, D3 = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)
SITES = [
    ("a", "north1", "north"),
    ("b", "north1", "north"),
    ("c", "north2", "north"),
    ("c", "north3", "north"),  # one city in two states of a region
    ("e", "south1", "south"),
    ("f", "south2", "south"),
]
TEMPERATURES = [
    (D1, "a", Decimal("280.00")),
    (D1, "c", Decimal("290.01")),
    (D1, "e", Decimal("300.00")),
    (D2, "c", Decimal("271.00")),
    (D2, "b", Decimal("275.50")),
]
DESCRIPTIONS = [(D1, "a", None), (D1, "c", "snow"), (D1, "e", "mist"), (D2, "b", "light rain")]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "temperature": spark.createDataFrame(TEMPERATURES, "date date, city string, temperature decimal(10,2)"),
        "humidity": spark.createDataFrame(TEMPERATURES[:2], "date date, city string, humidity decimal(10,2)"),
        "description": spark.createDataFrame(DESCRIPTIONS, "date date, city string, description string"),
    }


@pytest.fixture(scope="module")
def orders(spark):
    rows = [
        (i, day, city, state, region)
        for i, (day, (city, state, region)) in enumerate(
            (day, site) for day in (D1, D2, D3) for site in [*SITES, ("x", None, None), ("y", "west1", "west")]
        )
    ]
    return spark.createDataFrame(rows, "row_id int, order_date date, city string, state string, region string")


@pytest.fixture(scope="module")
def reference(orders):
    return impute.city_state_reference(orders)


def mean6(values):
    exact = sum(values) / Decimal(len(values))
    return exact.quantize(Decimal("0.000001"), ROUND_HALF_UP)


def expected_temperature(day, city, state, region):
    sites = [*SITES, ("y", "west1", "west")]
    readings = {(d, c): v for d, c, v in TEMPERATURES}
    if (day, city) in readings:
        return readings[day, city], "city"
    rungs = {
        "state": [readings[day, c] for c, s, _ in sites if s == state and (day, c) in readings],
        "region": [readings[day, c] for c, _, r in sites if r == region and (day, c) in readings],
        "date": [v for (d, _), v in readings.items() if d == day],
    }
    for rung, values in rungs.items():
        if values:
            return mean6(values), rung
    return None, "none"


def test_temperature_matches_brute_force(orders, tables, reference):
    rows = impute.impute_level(orders, {"temperature": tables["temperature"]}, reference).collect()
    assert len(rows) == orders.count()
    for row in rows:
        expected = expected_temperature(row.order_date, row.city, row.state, row.region)
        assert (row.temperature, row.temperature_level) == expected
    assert {r.temperature_level for r in rows} == {"city", "state", "region", "date", "none"}


def test_city_in_two_states_weighs_twice_in_its_region(orders, tables, reference):
    # No such line above takes the region rung on D1, so ask for a city without readings.
    rows = impute.impute_temperature(
        orders.sparkSession.createDataFrame(
            [(D1, "q", "north9", "north")], "order_date date, city string, state string, region string"
        ),
        tables["temperature"],
        reference,
    ).collect()
    assert rows[0].temperature == mean6([Decimal("280.00"), Decimal("290.01"), Decimal("290.01")])


def test_missing_text_is_filled_from_the_nearest_rung_that_has_one(orders, tables, reference):
    filled = impute.impute_description(orders, tables["description"], reference)
    by_place = {(r.order_date, r.city, r.state): r.description for r in filled.collect()}
    assert by_place[D1, "a", "north1"] == "snow"  # own text missing, none in the state
    assert by_place[D1, "x", None] == "mist"  # alphabetically first of the day
    assert by_place[D2, "a", "north1"] == "light rain"
    assert by_place[D3, "a", "north1"] is None


def test_final_keeps_every_line(orders, tables, reference):
    final = impute.sales_weather_final(orders, tables, reference)
    assert final.columns == [*orders.columns, "temperature", "humidity", "weather_condition"]
    assert final.count() == orders.count()


def test_shuffled_lookups_give_the_same_rows(spark, orders, tables, reference):
    def rows():
        return sorted(map(str, impute.impute_level(orders, tables, reference).collect()))

    small = rows()
    spark.conf.set(LIMIT_SETTING, "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = impute.impute_level(orders, tables, reference)
        assert sorted(map(str, plan.collect())) == small
        assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(LIMIT_SETTING)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reference_takes_the_first_region(spark):
    orders = spark.createDataFrame(
        [("a", "s", "west"), ("a", "s", "east"), ("a", None, "x"), (None, "s", "x"), ("b", "s", None)],
        "city string, state string, region string",
    )
    rows = {tuple(r) for r in impute.city_state_reference(orders).collect()}
    assert rows == {("a", "s", "east"), ("b", "s", None)}
