"""Readers, weather joins, enrichment, checks and the stored layout on hand-made rows."""

from datetime import date
from decimal import Decimal

import pytest

from rainledger import shared
from rainledger.operators import enrich, quality, weather
from rainledger.operators.lookup import LIMIT_SETTING, join_lookup, measured_bytes
from rainledger.plans import weather_reports
from rainledger.shared import shared_folder
from rainledger.sources import readers, schemas, writers

BASE = {
    "row_id": 1,
    "order_id": "O1",
    "order_date": "05/03/14",
    "ship_date": "07/03/14",
    "ship_mode": "First",
    "customer_id": "C1",
    "customer_name": "Ada",
    "segment": "Home",
    "country": "US",
    "city": "Rome",
    "state": "GA",
    "postal_code": "00123",
    "region": "South",
    "product_id": "P1",
    "category": "Cat",
    "sub_category": "Sub",
    "product_name": "Pen",
    "sales": Decimal("10.00"),
    "quantity": 2,
    "discount": Decimal("0.10"),
    "profit": Decimal("1.50"),
}


def raw(spark, *changes):
    rows = [{**BASE, **change} for change in changes]
    return spark.createDataFrame(
        [tuple(r[c] for c in schemas.ORDERS_RAW.fieldNames()) for r in rows], schemas.ORDERS_RAW
    )


def dated(spark, *changes):
    return enrich.parse_dates(enrich.fold_city(raw(spark, *changes)))


@pytest.fixture(scope="module")
def weather_tables(spark):
    day, other = date(2014, 3, 5), date(2014, 3, 6)
    return (
        spark.createDataFrame(
            [(day, "rome", Decimal(280)), (day, "oslo", Decimal(270)), (other, "rome", Decimal(281))],
            schemas.TEMPERATURE,
        ),
        spark.createDataFrame([(day, "rome", Decimal(55)), (day, "oslo", Decimal(60))], schemas.HUMIDITY),
        spark.createDataFrame(
            [(day, "rome", "sky is clear"), (day, "oslo", "snow"), (day, "bari", "snow")], schemas.DESCRIPTION
        ),
    )


def test_csv_and_parquet_readers_use_the_declared_schema(spark, tmp_path):
    lines = raw(spark, {}, {"row_id": 2, "ship_date": None})
    lines.write.option("header", "true").csv(str(tmp_path / "csv"))
    lines.write.parquet(str(tmp_path / "parquet"))
    for fmt in ("csv", "parquet"):
        table = readers.load_orders_raw(spark, str(tmp_path / fmt), fmt)
        assert table.schema == schemas.ORDERS_RAW
        assert sorted(map(tuple, table.collect())) == sorted(map(tuple, lines.collect()))


def test_weather_readers_fold_names(spark, tmp_path):
    day = date(2014, 3, 5)
    path = str(tmp_path / "d")
    spark.createDataFrame([(day, " Rome ", "Sky is Clear")], schemas.DESCRIPTION).write.parquet(path)
    assert tuple(readers.load_description(spark, path).first()) == (day, "rome", "sky is clear", "Sky is Clear")
    path = str(tmp_path / "t")
    spark.createDataFrame([(day, "Rome", Decimal(280))], schemas.TEMPERATURE).write.parquet(path)
    assert readers.load_temperature(spark, path).first().city == "rome"
    path = str(tmp_path / "h")
    spark.createDataFrame([(day, "Rome", Decimal(50))], schemas.HUMIDITY).write.parquet(path)
    assert readers.load_humidity(spark, path).first().city == "rome"


def test_combined_weather(weather_tables):
    assert weather.combined_weather_inner(*weather_tables).count() == 2
    left = {(r.date.day, r.city): (r.humidity, r.description) for r in weather.combined_weather_left(*weather_tables).collect()}
    assert left == {
        (5, "rome"): (Decimal(55), "sky is clear"),
        (5, "oslo"): (Decimal(60), "snow"),
        (6, "rome"): (None, None),
    }


def test_as_written_join_keeps_every_copy(weather_tables):
    rows = weather.combined_weather_as_written(*weather_tables).collect()
    found = {(r.city, r.description): r.copies for r in rows}
    # two cells of the day, three texts of the day: six rows when written out
    assert found == {
        ("rome", "sky is clear"): 1,
        ("rome", "snow"): 2,
        ("oslo", "sky is clear"): 1,
        ("oslo", "snow"): 2,
    }


def test_inner_drops_and_left_keeps_lines_without_weather(spark, weather_tables):
    lines = dated(spark, {}, {"row_id": 2, "city": "ROME "}, {"row_id": 3, "city": "Nowhere"}, {"row_id": 4, "order_date": "x"})
    combined = weather.combined_weather_left(*weather_tables)
    inner = enrich.sales_weather(lines, combined)
    assert sorted(r.row_id for r in inner.collect()) == [1, 2]
    assert inner.columns == [*lines.columns, "temperature", "humidity", "description"]
    typed = lines.drop("order_date").withColumnRenamed("order_date_proper", "order_date")
    left = enrich.sales_weather_joined(typed, *weather_tables).collect()
    assert {r.row_id: r.weather_condition for r in left} == {1: "sky is clear", 2: "sky is clear", 3: None, 4: None}
    assert [r.row_id for r in enrich.unparsed_dates(lines).collect()] == [4]


def test_clean_splits_lines_with_reasons(spark, weather_tables):
    lines = dated(
        spark,
        {},
        {"row_id": None},
        {"row_id": 3, "quantity": 0, "discount": Decimal("1.01")},
        {"row_id": 4, "discount": None, "ship_date": None, "profit": None},
        {"row_id": 5, "ship_date": "soon"},
        {"row_id": 6, "order_id": None},
        {"row_id": 7, "quantity": None},
    )
    enriched = enrich.sales_weather(lines, weather.combined_weather_left(*weather_tables))
    accepted, rejected = enrich.split_sales_weather(enriched)
    assert sorted(r.row_id for r in accepted.collect()) == ["1", "4"]
    assert {r.row_id: r.reject_reason for r in rejected.collect()} == {
        None: "row_id is missing",
        "3": "quantity is not positive; discount is out of range",
        "5": "ship_date is not a date",
        "6": "order_id is missing",
        "7": "quantity is missing",
    }
    clean = enrich.sales_weather_clean(enriched)
    assert clean.columns == schemas.CLEAN_COLUMNS
    assert accepted.count() + rejected.count() == enriched.count()


def test_null_passes_a_range_rule_but_not_a_required_one(spark):
    lines = raw(spark, {"discount": None}, {"discount": Decimal(0)}, {"discount": Decimal(1)}, {"discount": Decimal("1.01")})
    split = quality.check_ranges(lines)
    assert (split.accepted.count(), split.rejected.count()) == (3, 1)
    split = quality.check_not_null(lines, ["discount"])
    assert (split.accepted.count(), split.rejected.count()) == (3, 1)


def test_key_and_length_checks(spark):
    lines = raw(spark, {}, {"order_id": "O2"}, {"row_id": 2, "city": "x" * 51}, {"row_id": None}, {"row_id": None})
    assert {r.row_id: r.n_rows for r in quality.check_unique(lines, ["row_id"]).collect()} == {1: 2}
    assert {r.row_id: r.n_rows for r in quality.check_unique(lines, ["row_id"], primary=True).collect()} == {1: 2, None: 2}
    too_long = {r.column_name: (r.longest, r.too_long) for r in quality.check_length(lines).collect()}
    assert too_long["city"] == (51, 1)
    assert too_long["state"] == (2, 0)
    assert quality.null_row_id_count(lines).first()[0] == 2
    assert [tuple(r) for r in quality.duplicate_row_ids(lines).collect()] == [(None, 2), (1, 2)]
    assert [tuple(r) for r in quality.order_id_multiplicity(lines).collect()] == [("O1", 4)]


def test_dedupe_is_idempotent_and_keeps_the_first(spark):
    lines = raw(spark, {"city": "b"}, {"city": "a"}, {"city": "a"}, {"row_id": 2})
    once = quality.dedupe_row_id(lines)
    assert sorted((r.row_id, r.city) for r in once.collect()) == [(1, "a"), (2, "Rome")]
    assert sorted(map(tuple, quality.dedupe_row_id(once).collect())) == sorted(map(tuple, once.collect()))
    assert once.columns == lines.columns


def test_slice_includes_both_ends(spark):
    days = [date(2012, 9, 30), date(2012, 10, 1), date(2017, 11, 30), date(2017, 12, 1), None]
    table = spark.createDataFrame([(d,) for d in days], "order_date date")
    assert sorted(r[0] for r in enrich.slice_by_date(table).collect()) == days[1:3]
    assert tuple(enrich.date_range(table).first()) == (days[0], days[3])


def test_clean_table_layout(spark, weather_tables, tmp_path):
    lines = dated(spark, {}, {"row_id": 2, "city": "Oslo"}, {"row_id": 3, "order_date": "06/03/14"})
    clean = enrich.sales_weather_clean(
        enrich.sales_weather(lines, weather.combined_weather_left(*weather_tables))
    )
    path = str(tmp_path / "clean")
    writers.write_clean(clean, path)
    back = writers.read_clean(spark, path)
    assert sorted(map(tuple, back.select(*clean.columns).collect())) == sorted(map(tuple, clean.collect()))
    plan = back.filter("order_year = 2014")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year" in plan


def test_lookup_size_counts_rows_and_texts(spark):
    table = spark.createDataFrame([("a", 1), ("bcd", 2), (None, 3)], "t string, n int")
    assert measured_bytes({"x": table, "y": table.limit(0)}) == {"x": 3 * 64 + 4, "y": 0}


def test_lookup_beyond_the_limit_is_not_broadcast_by_us(spark):
    lines = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, v int")
    lookup = spark.createDataFrame([(0, "a"), (1, "b")], "k int, t string")
    small = sorted(map(tuple, join_lookup(lines, lookup, ["k"], "left").collect()), key=str)
    spark.conf.set(LIMIT_SETTING, "10")
    try:
        joined = join_lookup(lines, lookup, ["k"], "left")
        assert "strategy=broadcast" not in joined._jdf.queryExecution().analyzed().toString()
        assert sorted(map(tuple, joined.collect()), key=str) == small
    finally:
        spark.conf.unset(LIMIT_SETTING)


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")


def test_null_in_a_key_part_is_told_apart(spark):
    keys = spark.createDataFrame([("a", None), ("a", None), (None, "a"), ("a", "b"), ("a", "b"), ("c", "d")], "x string, y string")

    def found(primary):
        rows = quality.check_unique(keys, ["x", "y"], primary).select(quality.key_text(["x", "y"]), "n_rows").collect()
        return {tuple(r) for r in rows}

    assert found(False) == {("a|b", 2)}
    assert found(True) == {("a|b", 2), ("a|NULL", 2), ("NULL|a", 1)}


def test_no_line_vanishes_between_orders_and_clean_table(spark, weather_tables):
    lines = dated(
        spark,
        {},
        {"row_id": 2, "order_date": "soon"},
        {"row_id": 3, "order_date": None},
        {"row_id": 4, "city": None},
        {"row_id": 5, "city": "Nowhere"},
        {"row_id": 6, "quantity": 0},
    )
    combined = weather.combined_weather_left(*weather_tables)
    accepted, rejected = enrich.split_lines(lines)
    assert {r.row_id: r.reject_reason for r in rejected.collect()} == {
        "2": "order_date is not a date",
        "3": "order_date is missing",
        "4": "city is missing",
        "6": "quantity is not positive",
    }
    assert accepted.count() + rejected.count() == lines.count()
    ends = {r.outcome: r.n_rows for r in enrich.line_outcomes(lines, combined).collect()}
    assert ends["clean"] == enrich.sales_weather_clean(enrich.sales_weather(lines, combined)).count() == 1
    assert ends["without weather"] == 1 and sum(ends.values()) == lines.count()


def test_unreadable_values_of_a_text_file_are_set_apart(spark, tmp_path):
    header = ",".join(schemas.ORDERS_RAW.fieldNames())
    good = dict.fromkeys(schemas.ORDERS_RAW.fieldNames(), "x") | {"row_id": "1", "sales": "1.50", "quantity": "2", "discount": "0.10", "profit": "1.00"}
    bad = [good | {"row_id": "2", "discount": "ten percent"}, good | {"row_id": "3", "profit": "99999999999.5"}, good | {"row_id": "4", "quantity": "two", "sales": ""}]
    (tmp_path / "lines.csv").write_text("\n".join([header, *(",".join(r.values()) for r in [good, *bad])]))
    accepted, rejected = readers.read_checked(spark, str(tmp_path), schemas.ORDERS_RAW)
    assert accepted.schema == schemas.ORDERS_RAW
    assert [(r.row_id, r.sales, r.discount) for r in accepted.collect()] == [(1, Decimal("1.50"), Decimal("0.10"))]
    assert {r.row_id: (r.reject_reason, r.discount) for r in rejected.collect()} == {
        "2": ("discount is unreadable", "ten percent"),
        "3": ("profit is unreadable", "0.10"),
        "4": ("quantity is unreadable", "0.10"),
    }
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.load_orders_raw(spark, str(tmp_path), "csv").collect()


def test_a_period_of_the_clean_table_reads_only_its_years(spark, tmp_path):
    days = [date(2013, 12, 31), date(2014, 1, 1), date(2014, 6, 1), date(2015, 1, 1)]
    rows = [tuple(day if f.name == "order_date" else None for f in writers.CLEAN if f.name != "order_year") for day in days]
    kinds = [f for f in writers.CLEAN if f.name != "order_year"]
    clean = spark.createDataFrame(rows, schemas.StructType(kinds))
    writers.write_clean(clean, str(tmp_path / "clean"))
    found = writers.read_clean(spark, str(tmp_path / "clean"), date(2014, 1, 1), date(2014, 12, 31))
    assert sorted(r.order_date for r in found.collect()) == days[1:3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year" in plan and "order_year" in plan.split("PartitionFilters")[1][:200]
    assert writers.read_clean(spark, str(tmp_path / "clean")).count() == 4


def test_year_of_a_report_reaches_the_scan(spark, tmp_path):
    lines = dated(spark, {})
    lines.write.parquet(str(tmp_path / "lines"))
    spark.createDataFrame([(date(2014, 3, 5), "rome", Decimal(280))], schemas.TEMPERATURE).write.parquet(str(tmp_path / "t"))
    found = weather_reports.monthly_sales_temp_by_city(
        spark.read.parquet(str(tmp_path / "lines")), spark.read.parquet(str(tmp_path / "t")), 2014
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_date_proper,2014-01-01)" in plan and "GreaterThanOrEqual(date,2014-01-01)" in plan


def test_changed_input_makes_a_new_stored_table(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = schemas.StructType([schemas.StructField("id", schemas.LongType())])

    def build():
        return shared.stored(spark, source, "t", schema, lambda: spark.read.parquet(source), shared.file_state(spark, source))

    spark.range(3).write.parquet(source)
    assert build().count() == build().count() == 3
    spark.range(2).write.mode("append").parquet(source)
    assert build().count() == 5


def test_text_arguments_are_folded(spark):
    clean = spark.createDataFrame([("r", "sky is clear", Decimal("2.00"))], "region string, weather_description string, sales decimal(10,2)")
    assert weather_reports.avg_sales_clear_sky(clean, text=" Sky is Clear").count() == 1
