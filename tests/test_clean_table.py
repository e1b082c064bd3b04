"""Loads into the clean table: whole or not at all, again without harm, counted while they are written."""

from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from rainledger.operators.quality import not_null_rules, range_rules
from rainledger.sources import clean_table, writers
from rainledger.sources.schemas import CLEAN_COLUMNS



def lines(spark, rows):
    """Clean lines from (row_id, order date, quantity, weather text)."""
    known = spark.createDataFrame(rows, "row_id string, order_date date, quantity int, weather_description string")
    fixed = {"sales": F.lit(Decimal("1.50")), "discount": F.lit(Decimal("0.10")), "ship_date": F.lit(None).cast("date")}
    types = {f.name: f.dataType for f in writers.CLEAN}
    return known.select(
        *[
            F.col(c) if c in known.columns else fixed.get(c, F.lit("x" if types[c].simpleString() == "string" else None)).cast(types[c]).alias(c)
            for c in CLEAN_COLUMNS
        ]
    )


YEAR_ROWS = [(str(i), date(2014 + i % 3, 1 + i % 12, 1), 1 + i % 5, ["mist", "snow", None][i % 3]) for i in range(60)]


def rows(table):
    return sorted((r["row_id"], r["order_date"], r["quantity"], r["weather_description"] or "", r["order_year"]) for r in table.collect())


def want(given):
    return sorted((i, d, q, w or "", d.year) for i, d, q, w in given)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_first_load_and_periods(spark, tmp_path):
    path = str(tmp_path / "t")
    load = clean_table.insert(lines(spark, YEAR_ROWS), path)
    assert load == (1, {"read": 60, "accepted": 60, "rejected": 0, "new": 60, "known": 0}, [2014, 2015, 2016])
    assert rows(clean_table.read(spark, path)) == want(YEAR_ROWS)
    assert clean_table.read(spark, path).columns == writers.CLEAN.fieldNames()
    period = clean_table.read(spark, path, date(2015, 3, 1), date(2015, 8, 31))
    assert rows(period) == want([r for r in YEAR_ROWS if date(2015, 3, 1) <= r[1] <= date(2015, 8, 31)])
    read = {name.split("/")[-2] for name in period.inputFiles()}
    assert read == {"order_year=2015"}


def test_a_broken_rule_leaves_the_table_untouched(spark, tmp_path):
    path = str(tmp_path / "t")
    clean_table.insert(lines(spark, YEAR_ROWS), path)
    before = files(path), rows(clean_table.read(spark, path))
    bad = [("900", date(2014, 5, 1), 2, "mist"), ("901", date(2014, 5, 1), 0, "mist"), (None, date(2019, 5, 1), -1, "mist")]
    with pytest.raises(clean_table.RejectedLines) as refused:
        clean_table.insert(lines(spark, bad), path)
    assert refused.value.outcomes == {"read": 3, "accepted": 1, "rejected": 2, "row_id is missing": 1, "quantity is not positive": 2}
    assert (files(path), rows(clean_table.read(spark, path))) == before
    assert clean_table.versions(spark, path) == [1]
    with pytest.raises(clean_table.RejectedLines):
        clean_table.insert(lines(spark, bad), str(tmp_path / "new"))
    assert rows(clean_table.read(spark, str(tmp_path / "new"))) == [] and files(tmp_path / "new") == {}


def failing(spark, given, row_id):
    """The lines, but the task that meets the given one dies."""
    broken = F.when(F.col("row_id") == row_id, F.raise_error(F.lit("task lost"))).otherwise(F.col("row_id"))
    return lines(spark, given).repartition(6, "row_id").withColumn("row_id", broken.cast("string"))


def test_a_task_that_dies_in_the_middle(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(PySparkException):
        clean_table.insert(failing(spark, YEAR_ROWS, "31"), path)
    assert rows(clean_table.read(spark, path)) == [] and clean_table.versions(spark, path) == []
    clean_table.insert(lines(spark, YEAR_ROWS), path)
    before = files(path)
    more = [(str(100 + i), date(2014, 2, 2), 1, "mist") for i in range(40)]
    with pytest.raises(PySparkException):
        clean_table.insert(failing(spark, more, "120"), path)
    assert files(path) == before and rows(clean_table.read(spark, path)) == want(YEAR_ROWS)


def test_a_driver_lost_before_publishing(spark, tmp_path, monkeypatch):
    """Folders are left, but no manifest names them; the load can be run again."""
    path = str(tmp_path / "t")
    clean_table.insert(lines(spark, YEAR_ROWS), path)
    more = [("500", date(2014, 2, 2), 1, "mist"), ("501", date(2018, 2, 2), 1, "mist")]
    with monkeypatch.context() as lost:
        lost.setattr(clean_table, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        kept_delete = clean_table._delete
        lost.setattr(clean_table, "_delete", lambda s, f: None if "/load-" in f and f.count("/") == path.count("/") + 1 else kept_delete(s, f))
        with pytest.raises(KeyboardInterrupt):
            clean_table.insert(lines(spark, more), path)
    assert rows(clean_table.read(spark, path)) == want(YEAR_ROWS)
    load = clean_table.insert(lines(spark, more), path)
    assert load.version == 2 and rows(clean_table.read(spark, path)) == want(YEAR_ROWS + more)
    assert clean_table.drop_unused(spark, path)
    assert rows(clean_table.read(spark, path)) == want(YEAR_ROWS + more)
    assert clean_table.versions(spark, path) == [2] and clean_table.drop_unused(spark, path) == []


def test_the_same_load_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    clean_table.insert(lines(spark, YEAR_ROWS), path)
    before = files(path)
    again = clean_table.insert(lines(spark, YEAR_ROWS), path)
    assert again == (1, {"read": 60, "accepted": 60, "rejected": 0, "new": 0, "known": 60}, [])
    assert files(path) == before


def test_only_touched_years_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    clean_table.insert(lines(spark, YEAR_ROWS), path)
    _, folders = clean_table.manifest(spark, path)
    overlap = [YEAR_ROWS[0], YEAR_ROWS[1], ("700", date(2015, 7, 7), 3, "snow"), ("701", date(2020, 7, 7), 3, "snow")]
    load = clean_table.insert(lines(spark, overlap), path)
    assert load.years == [2015, 2020] and load.outcomes["new"] == 2 and load.outcomes["known"] == 2
    _, after = clean_table.manifest(spark, path)
    assert {y for y in after if after[y] != folders.get(y)} == {2015, 2020}
    assert rows(clean_table.read(spark, path)) == want(YEAR_ROWS + overlap[2:])
    assert rows(clean_table.read(spark, path, version=1)) == want(YEAR_ROWS)
    weather = [r["weather_description"] for r in spark.read.parquet(after[2015]).coalesce(1).collect()]
    assert weather == sorted(weather, key=lambda w: (w is not None, w or ""))


def test_one_row_id_in_several_lines_of_a_load(spark, tmp_path):
    path = str(tmp_path / "t")
    twice = [("1", date(2014, 1, 1), 1, "mist"), ("1", date(2014, 1, 1), 2, "mist"), ("1", date(2015, 1, 1), 3, "mist")]
    for _ in range(2):
        clean_table.insert(lines(spark, twice), path)
    assert rows(clean_table.read(spark, path)) == want(twice)


def test_lenient_loads_keep_the_rejected_lines(spark, tmp_path):
    path = str(tmp_path / "t")
    bad = [("1", date(2014, 1, 1), 0, "mist"), ("2", None, 1, "mist"), ("3", date(2014, 1, 1), 1, "mist")]
    load = clean_table.insert(lines(spark, bad), path, strict=False)
    assert load.outcomes == {"read": 3, "accepted": 1, "rejected": 2, "order_date is missing": 1, "quantity is not positive": 1, "new": 1, "known": 0}
    assert rows(clean_table.read(spark, path)) == want(bad[2:])
    clean_table.insert(lines(spark, bad[:1]), path, strict=False)
    clean_table.drop_unused(spark, path)
    reasons = sorted((r["row_id"], r["reject_reason"]) for r in clean_table.rejected(spark, path).collect())
    assert reasons == [("1", "quantity is not positive")] * 2 + [("2", "order_date is missing")]


def test_loads_that_meet(spark, tmp_path):
    path = str(tmp_path / "t")
    clean_table.insert(lines(spark, YEAR_ROWS), path)
    version, years = clean_table.manifest(spark, path)
    clean_table.insert(lines(spark, [("900", date(2014, 1, 1), 1, "mist")]), path)
    with pytest.raises(clean_table.ConcurrentLoad):
        clean_table._publish(spark, path, version + 1, years)
    assert clean_table.read(spark, path).count() == 61


def test_no_lines(spark, tmp_path):
    path = str(tmp_path / "t")
    load = clean_table.insert(lines(spark, YEAR_ROWS).limit(0), path)
    assert load == (0, {"read": 0, "accepted": 0, "rejected": 0, "new": 0, "known": 0}, [])
    assert clean_table.read(spark, path).count() == 0 and clean_table.rejected(spark, path).count() == 0


def test_one_scan_writes_and_counts(spark, tmp_path):
    source = str(tmp_path / "source")
    lines(spark, YEAR_ROWS).write.parquet(source)
    judged = clean_table.judged(spark.read.parquet(source), [*not_null_rules(), *range_rules()])
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan


def test_strict_write(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(ValueError, match="quantity is not positive"):
        writers.write_clean(lines(spark, [*YEAR_ROWS, ("99", date(2014, 1, 1), 0, "mist")]), path, strict=True)
    with pytest.raises(PySparkException):
        writers.write_clean(failing(spark, YEAR_ROWS, "31"), path, strict=True)
    assert list(tmp_path.iterdir()) == []
    writers.write_clean(lines(spark, YEAR_ROWS), path, strict=True)
    assert rows(writers.read_clean(spark, path)) == want(YEAR_ROWS)
    with pytest.raises(ValueError, match="new folder"):
        writers.write_clean(lines(spark, YEAR_ROWS), path, strict=True)
    assert [f.name for f in tmp_path.iterdir()] == ["c"]


def test_whole_lines_are_written_for_growing_years_alone(spark, tmp_path, monkeypatch):
    path, written = str(tmp_path / "t"), []
    clean_table.insert(lines(spark, YEAR_ROWS), path)
    plain = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, to, *a, **k: (written.append(to.split("/")[-1]), plain(self, to, *a, **k))[1])
    clean_table.insert(lines(spark, YEAR_ROWS), path)
    assert written == ["staged"]
    load = clean_table.insert(lines(spark, [*YEAR_ROWS, ("700", date(2015, 7, 7), 3, "snow")]), path)
    assert written == ["staged", "staged", "merged"] and load.years == [2015] and load.outcomes["known"] == 60
    assert rows(clean_table.read(spark, path)) == want([*YEAR_ROWS, ("700", date(2015, 7, 7), 3, "snow")])


def test_query_joins_its_lines_once(spark, sf_dir, monkeypatch):
    from rainledger.plans import catalogue

    sources, insert = [], clean_table.insert
    monkeypatch.setattr(clean_table, "insert", lambda given, *a: (sources.append({f.split("/")[-2] for f in given.inputFiles()}), insert(given, *a))[1])
    catalogue.insert_clean(spark, sf_dir)
    assert len(sources) == 3 and sources[0] == sources[1] == sources[2] and all(s.startswith("delivered_lines") for s in sources[0])
