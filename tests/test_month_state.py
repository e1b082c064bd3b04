"""Reports from the state of months against the same reports on the lines."""

import random
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rainledger.operators import lookup
from rainledger.plans import final_reports
from rainledger.sources import month_state

SCHEMA = "order_date date, segment string, customer_id string, order_id string, sales decimal(10,2), profit decimal(10,2), bucket string"
FIRST, LAST = date(2014, 11, 1), date(2015, 2, 28)


def random_rows(n, seed):
    draw = random.Random(seed)

    def amount():
        return draw.choice([None, Decimal(draw.randint(-500, 90000)) / 100])

    return [
        (
            draw.choice([None, date(2014, 11, 1), date(2014, 12, 31), date(2015, 1, 1), date(2015, 2, 28), date(2015, 3, 1)]),
            draw.choice([None, "", "Consumer", "Corporate"]),
            draw.choice([None, "C-hot", f"C-{draw.randint(1, 60)}"]),
            draw.choice([None, f"O-{draw.randint(1, 40)}"]),
            amount(),
            amount(),
            "x",
        )
        for _ in range(n)
    ]


def lines(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def same(state, of_lines):
    within = of_lines.filter(F.col("order_date").between(F.lit(FIRST), F.lit(LAST)))
    for report in ("monthly_trend", "segment_performance"):
        ours = getattr(month_state, report)(state)
        theirs = getattr(final_reports, report)(within)
        assert ours.columns == theirs.columns
        assert [tuple(r) for r in ours.collect()] == [tuple(r) for r in theirs.collect()], report


def months(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("months/**/*.parquet")}


@pytest.mark.parametrize("limit", [None, "0"])
def test_months_put_together_equal_the_recount(spark, tmp_path, limit):
    path, table = str(tmp_path / "s"), lines(spark, random_rows(400, 1))
    if limit:
        spark.conf.set(lookup.LIMIT_SETTING, limit)
    try:
        assert month_state.refresh(table, path, FIRST, date(2014, 12, 5)) == [201411, 201412]
        assert month_state.refresh(table, path, date(2015, 1, 1), LAST) == [201501, 201502]
        same(month_state.read(spark, path), table)
    finally:
        spark.conf.unset(lookup.LIMIT_SETTING)


def test_only_the_months_asked_for_are_read_and_written(spark, tmp_path):
    path, table = str(tmp_path / "s"), lines(spark, random_rows(300, 2))
    month_state.refresh(table, path, FIRST, LAST)
    before, numbers = months(path), {tuple(r) for r in month_state.customers(spark, path).collect()}
    # Every other month's lines are changed at the source; the state of those months must not notice.
    january = F.col("order_date").between(F.lit(date(2015, 1, 1)), F.lit(date(2015, 1, 31)))
    extra = lines(spark, [(date(2015, 1, 9), "Consumer", "C-new", "O-new", Decimal("7.00"), Decimal("1.00"), "x")])
    changed = table.filter(january).unionByName(extra)
    broken = table.filter(~january).withColumn("sales", F.lit(Decimal("0.01")).cast("decimal(10,2)"))
    month_state.refresh(changed.unionByName(broken), path, date(2015, 1, 20), date(2015, 1, 20))
    after = months(path)
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if "month=201501" not in f}
    same(month_state.read(spark, path), table.filter(~january).unionByName(changed))
    kept_numbers = {tuple(r) for r in month_state.customers(spark, path).collect()}
    assert numbers < kept_numbers and [c for c, _ in kept_numbers - numbers] == ["C-new"]
    assert len({n for _, n in kept_numbers}) == len(kept_numbers) == max(n for _, n in kept_numbers)


def test_again_and_without_lines(spark, tmp_path):
    path, table = str(tmp_path / "s"), lines(spark, random_rows(200, 3))
    for _ in range(2):
        month_state.refresh(table, path, FIRST, LAST)
    same(month_state.read(spark, path), table)
    gone = date(2014, 12, 1)
    left = table.filter(F.month("order_date") != 12)
    assert month_state.refresh(left, path, gone, gone) == []
    same(month_state.read(spark, path), left)


def test_empty(spark, tmp_path):
    path = str(tmp_path / "s")
    assert month_state.read(spark, path).count() == 0
    assert month_state.refresh(lines(spark, []), path, FIRST, LAST) == []
    same(month_state.read(spark, path), lines(spark, []))


def test_more_customers_than_a_bitmap_holds(spark, tmp_path):
    path = str(tmp_path / "s")
    table = spark.range(80000).select(
        F.when(F.col("id") % 2 == 0, F.lit(FIRST)).otherwise(F.lit(LAST)).alias("order_date"),
        F.lit("Consumer").alias("segment"),
        F.concat(F.lit("C-"), F.floor(F.col("id") / 2 + F.col("id") % 2 * 10000).cast("string")).alias("customer_id"),
        F.col("id").cast("string").alias("order_id"),
        F.lit(Decimal("1.00")).alias("sales"),
        F.lit(Decimal("1.00")).alias("profit"),
    )
    month_state.refresh(table, path, FIRST, FIRST)
    month_state.refresh(table, path, LAST, LAST)
    same(month_state.read(spark, path), table)
    assert month_state.read(spark, path).select("bucket").dropna().distinct().count() == 2
