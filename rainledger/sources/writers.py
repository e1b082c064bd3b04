"""Stored layout of the clean table."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from rainledger.operators.quality import not_null_rules, passes, range_rules
from rainledger.shared import file_system, shuffles_deleted
from rainledger.sources.schemas import CLEAN_COLUMNS, ORDERS_TYPED, READING

#: Columns that lines are looked up by; their values are spread over all row groups of the layout.
LOOKUP_COLUMNS = ("order_id", "customer_id", "product_id", "city")
#: A Bloom filter per row group and column, as large as its values need; a dictionary serves where there are few values.
LOOKUP_OPTIONS = {
    "parquet.bloom.filter.adaptive.enabled": "true",
    **{f"parquet.bloom.filter.enabled#{name}": "true" for name in LOOKUP_COLUMNS},
}

_TYPED = {field.name: field.dataType for field in ORDERS_TYPED}
CLEAN = StructType(
    [
        StructField("row_id", StringType()),
        *[StructField(name, _TYPED[name]) for name in CLEAN_COLUMNS[1:21]],
        StructField("temperature", READING),
        StructField("humidity", READING),
        StructField("weather_description", StringType()),
        StructField("order_year", IntegerType()),
    ]
)


def arranged(lines: DataFrame, *folders: str) -> DataFrame:
    """Lines spread by the columns that name their folders, sorted inside by weather text and region.

    A period then skips folders and a weather filter skips row groups. The rebalance hint lets adaptive execution
    split a heavy folder and join up light ones.
    """
    return lines.hint("rebalance", *folders).sortWithinPartitions(*folders, "weather_description", "region")


def write_clean(clean: DataFrame, path: str, mode: str = "errorifexists", strict: bool = False) -> None:
    """Parquet folders per order year, laid out for later filters.

    With ``strict`` a line without a required value, or with one out of range, refuses the whole write: the lines are
    checked while they are written to a folder aside, which takes the place of ``path`` in one rename. That needs a
    ``path`` that isn't there yet; ``clean_table.insert`` adds to a table that has rows.
    """
    if strict:
        if mode != "errorifexists":
            raise ValueError(f"a strict write needs a new folder, not {path}")
        write_clean_parts([clean], path, strict)
        return
    _by_year(clean).write.options(**LOOKUP_OPTIONS).mode(mode).partitionBy("order_year").parquet(path)


def write_clean_parts(parts: Sequence[DataFrame], path: str, strict: bool = False) -> None:
    """The lines of several tables as one clean table in a new folder, all or nothing.

    The parts are written one after the other to a folder aside, and the shuffle files of each are deleted before the next:
    the disk then holds the table and the shuffles of one part, and not those of all lines.
    """
    spark = parts[0].sparkSession
    target, files = file_system(spark, path.rstrip("/"))
    if files.exists(target):
        raise ValueError(f"a write of parts or a strict one needs a new folder, not {path}")
    aside, _ = file_system(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    rules = [*not_null_rules(), *range_rules()] if strict else []
    broken: Counter[str] = Counter()
    try:
        with shuffles_deleted(spark):
            for part in parts:
                seen = Observation()
                counts = [F.count_if(~passes(rule)).alias(str(i)) for i, rule in enumerate(rules)]
                write = _by_year(part.observe(seen, *counts) if counts else part).write.options(**LOOKUP_OPTIONS)
                write.mode("append").partitionBy("order_year").parquet(aside.toString())
                broken.update({rule.name: n for i, rule in enumerate(rules) if (n := seen.get[str(i)])})
        if broken:
            raise ValueError(f"write refused, {path} is not there: {dict(broken)}")
        if not files.rename(aside, target):
            raise OSError(f"{aside} can't be renamed to {path}")
    except BaseException:
        files.delete(aside, True)
        raise


def _by_year(clean: DataFrame) -> DataFrame:
    return arranged(clean.select(*CLEAN_COLUMNS).withColumn("order_year", F.year("order_date")), "order_year")


def write_rejected(rejected: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines with their reject_reason, beside the clean table."""
    rejected.write.mode(mode).parquet(path)


def read_clean(
    spark: SparkSession, path: str, first: date | None = None, last: date | None = None
) -> DataFrame:
    """The clean table, or its lines from ``first`` to ``last``, both included.

    The folders are named by year, so a period is stated as years too: only their folders are read.
    """
    clean = spark.read.schema(CLEAN).parquet(path)
    if first is not None:
        clean = clean.filter((F.col("order_year") >= first.year) & (F.col("order_date") >= F.lit(first)))
    if last is not None:
        clean = clean.filter((F.col("order_year") <= last.year) & (F.col("order_date") <= F.lit(last)))
    return clean


def find_lines(clean: DataFrame, **values: str) -> DataFrame:
    """Lines with the given order_id, customer_id, product_id or city.

    The sort by weather and region puts no order near each other in the files; the filters written with each row group
    tell which of them can hold the value, and the others are not read.
    """
    unknown = set(values) - set(LOOKUP_COLUMNS)
    if unknown:
        raise ValueError(f"no lookup by {', '.join(sorted(unknown))}")
    return reduce(lambda found, item: found.filter(F.col(item[0]) == F.lit(item[1])), sorted(values.items()), clean)


def write_bucketed(
    lines: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str] = ("order_date", "city")
) -> DataFrame:
    """Lines stored by the hash of the weather's keys, as a catalog table over ``path``, read back.

    A join on these keys to a lookup that is too large to broadcast then shuffles the lookup alone. The rebalance hint
    gives a heavy bucket several files and several writing tasks; but one task joins it, so lines of which a few days and
    cities hold a large share are better joined from ``write_clean``'s layout, where adaptive execution splits them.
    """
    spread = lines.hint("rebalance", buckets, *keys)
    spread.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return lines.sparkSession.table(table)


def clean_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A view in the catalog over the stored clean table, for every session that shares the catalog.

    It lasts as long as the catalog does: for one application with Spark's own, beyond it with a metastore. Years that are
    added to the folder later are seen as well.
    """
    columns = ", ".join(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in CLEAN)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM parquet.`{path}`")
    return spark.table(name)
