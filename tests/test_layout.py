"""What the stored layouts save: row groups at a lookup, a shuffle at a join, and a view for other sessions."""

import re
import time
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from rainledger.operators import enrich
from rainledger.operators.lookup import LIMIT_SETTING
from rainledger.plans import catalogue
from rainledger.shared import SHUFFLE_CLEANUP
from rainledger.sources import driver_tables, writers
from rainledger.sources.schemas import CLEAN_COLUMNS

ROWS = 60_000


def clean(spark):
    """Lines of one year whose order and customer are spread over all weather texts and regions."""
    number = F.col("id")
    known = {
        "row_id": number.cast("string"),
        "order_id": F.concat(F.lit("O-"), F.md5((number % 20_000).cast("string"))),
        "customer_id": F.concat(F.lit("C-"), F.md5((number % 9_000).cast("string"))),
        "order_date": F.lit(date(2014, 3, 1)),
        "weather_description": F.concat(F.lit("w"), F.xxhash64("id") % 7),
        "region": F.concat(F.lit("r"), F.xxhash64("id") % 11),
        "product_name": F.sha2(number.cast("string"), 512),
    }
    types = {f.name: f.dataType for f in writers.CLEAN}
    return spark.range(ROWS).select(*[known.get(c, F.lit(None)).cast(types[c]).alias(c) for c in CLEAN_COLUMNS])


def rows_scanned(frame):
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "clean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hadoop = spark._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(256 * 1024))
    hadoop.set("parquet.page.size.row.check.min", "1000")
    try:
        writers.write_clean(clean(spark), path)
    finally:
        hadoop.unset("parquet.block.size")
        hadoop.unset("parquet.page.size.row.check.min")
    stored = writers.read_clean(spark, path)
    assert rows_scanned(stored.filter("product_name IS NOT NULL")) == ROWS
    order, customer = (f"{p}-" + __import__("hashlib").md5(b"77").hexdigest() for p in "OC")
    for column, value, hits in (("order_id", order, 3), ("customer_id", customer, 7)):
        found = writers.find_lines(stored, **{column: value})
        assert found.count() == hits
        assert rows_scanned(writers.find_lines(stored, **{column: value})) < ROWS / 2
    assert rows_scanned(writers.find_lines(stored, order_id="O-none")) < ROWS / 10
    with pytest.raises(ValueError):
        writers.find_lines(stored, segment="x")


def test_bucketed_lines_join_without_a_shuffle(spark, tmp_path):
    start = date(2014, 1, 1)
    lines = spark.range(5000).select(
        F.col("id").alias("row_id"),
        F.date_add(F.lit(start), (F.col("id") % 200).cast("int")).alias("order_date"),
        F.concat(F.lit("city"), F.col("id") % 9).alias("city"),
    )
    readings = [(start + timedelta(d), f"city{c}", Decimal(d + c)) for d in range(190) for c in range(8)]
    weather = spark.createDataFrame(readings, "date date, city string, temperature decimal(10,2)")
    weather.write.parquet(str(tmp_path / "weather"))
    weather = spark.read.parquet(str(tmp_path / "weather"))
    stored = writers.write_bucketed(lines, "bucketed_test_lines", str(tmp_path / "lines"), 8)
    want = sorted(enrich.on_weather(lines, weather, "left", "order_date").collect())
    spark.conf.set(LIMIT_SETTING, "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = enrich.on_weather(stored, weather, "left", "order_date")
        assert sorted(joined.collect()) == want
        plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" in plan and len(re.findall(r"\bExchange ", plan)) == 1
        assert "SelectedBucketsCount: 8 out of 8" in plan
        shuffled = enrich.on_weather(lines, weather, "left", "order_date")
        shuffled.collect()
        other = shuffled._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert len(re.findall(r"\bExchange ", other)) == 2
    finally:
        spark.conf.unset(LIMIT_SETTING)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_test_lines")


def test_a_view_for_other_sessions(spark, tmp_path):
    path = str(tmp_path / "clean")
    writers.write_clean(clean(spark).limit(50), path)
    try:
        writers.clean_view(spark, path, "clean_lines")
        other = spark.newSession().table("clean_lines")
        here = writers.read_clean(spark, path)
        assert [(f.name, f.dataType) for f in other.schema] == [(f.name, f.dataType) for f in here.schema]
        assert sorted(r["row_id"] for r in other.collect()) == sorted(r["row_id"] for r in here.collect())
        here.createOrReplaceTempView("clean_lines_here")
        assert other.columns == spark.table("clean_lines_here").columns
        assert "PartitionFilters: [isnotnull(order_year" in other.filter("order_year = 2014")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP VIEW IF EXISTS clean_lines")


def driver_folder(spark, folder):
    """Driver tables with repeated and missing keys: every order twice as often as its neighbour, some without customer or part."""
    day = datetime(1996, 1, 1)
    tables = {
        "region": ([(0, "r0"), (1, "r1")], "r_regionkey int, r_name string"),
        "nation": ([(n, f"n{n}", n % 2) for n in range(4)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": (
            [(c if c else None, f"name{c}", c % 4, "seg") for c in range(12)] + [(3, "again", 1, "seg")],
            "c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
        ),
        "orders": (
            [(o if o else None, o % 13, day + timedelta(o % 40), "low") for o in range(60)] + [(7, 7, day, "high")],
            "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string",
        ),
        "part": ([(p, "t", "b", f"p{p}") for p in range(5)] + [(2, "t", "b", "again")], "p_partkey long, p_type string, p_brand string, p_name string"),
        "lineitem": (
            [(None if i == 5 else i % 61, i % 7 if i % 9 else None, i % 4, 1.0 + i, float(i % 5), 0.01) for i in range(300)] * 2,
            "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_discount double",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_shares_of_the_orders_hold_every_line_once(spark, tmp_path, monkeypatch):
    folder = driver_folder(spark, tmp_path / "tables")
    want = Counter(map(tuple, catalogue.clean(spark, folder).collect()))
    assert sum(want.values()) > 100 and max(want.values()) > 1
    monkeypatch.setattr(catalogue, "MOST_SHARES", 3)
    for least in (1 << 40, 1):
        monkeypatch.setattr(catalogue, "SHARE_BYTES", least)
        found = catalogue.clean_catalog_view(spark, folder)
        writes = {re.search(r"/part-\d+-([0-9a-f-]{36})", file)[1] for file in found.inputFiles()}
        assert len(writes) == (3 if least == 1 else 1)
        assert Counter(map(tuple, found.drop("order_year").collect())) == want


def test_shuffles_of_a_share_are_deleted_before_the_next(spark, sf_dir, monkeypatch):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    def left(before):
        for _ in range(100):  # they are deleted beside the driver's own work
            if not (found := shuffled() - before):
                break
            time.sleep(0.1)
        return found

    driver_tables.weather_condition(spark, sf_dir)
    monkeypatch.setattr(catalogue, "SHARE_BYTES", 1, raising=False)
    monkeypatch.setattr(catalogue, "MOST_SHARES", 3, raising=False)
    before, written, plain = shuffled(), [], DataFrameWriter.parquet

    def parquet(self, to, *args, **named):
        written.append(left(before))
        return plain(self, to, *args, **named)

    # Spark's own broadcasts aside, every join shuffles as it does with large tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    try:
        catalogue.clean_catalog_view(spark, sf_dir)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert left(before) == set()
    assert len(written) == 3 and not any(written)
    assert spark.conf.get(SHUFFLE_CLEANUP, None) is None


def test_parts_are_written_whole_or_not_at_all(spark, tmp_path):
    path, lines = str(tmp_path / "clean"), clean(spark).limit(40)
    broken = lines.withColumn("region", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        writers.write_clean_parts([lines, broken], path)
    assert list(tmp_path.iterdir()) == []
    writers.write_clean_parts([lines, lines.limit(0), lines], path)
    assert [f.name for f in tmp_path.iterdir()] == ["clean"]
    assert writers.read_clean(spark, path).count() == 80
    with pytest.raises(ValueError, match="new folder"):
        writers.write_clean_parts([lines], path)
