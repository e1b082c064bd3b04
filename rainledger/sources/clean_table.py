"""A clean table that takes a load whole or not at all, and the same load twice without harm.

The table is a folder of loads and a row of manifests. A manifest names, for each order year, the one folder that holds
its lines; the newest manifest is the table. A load writes folders of its own first and is published by
renaming one small file, so readers see all of it or nothing, and a load that fails, or whose driver is lost, leaves
folders that no manifest names (``drop_unused`` removes them).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rainledger.operators.quality import Rule, not_null_rules, passes, range_rules, reject_reason
from rainledger.shared import file_system
from rainledger.sources.schemas import CLEAN_COLUMNS
from rainledger.sources.writers import CLEAN, LOOKUP_OPTIONS, arranged

KEY = "row_id"
_MANIFESTS = "_manifests"
_STORED = StructType([field for field in CLEAN if field.name != "order_year"])
_TEXTS = ("order_date_text", "ship_date_text")


class Load(NamedTuple):
    """What became of the lines of a load.

    ``outcomes`` counts lines: read, accepted and rejected, one entry per rule that was broken (a line can break
    several), and of the accepted ones those that were new and those that the table had. They are counted in the passes
    that write; a stage that Spark runs anew because an executor was lost can count lines twice, never too few.
    """

    version: int
    outcomes: dict[str, int]
    years: list[int]

    def as_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.outcomes.items()), "outcome string, n_rows bigint")


class RejectedLines(ValueError):
    """A strict load met lines that break rules; the table is as it was."""

    def __init__(self, outcomes: dict[str, int]):
        super().__init__(f"load refused, nothing was written: {outcomes}")
        self.outcomes = outcomes


class ConcurrentLoad(RuntimeError):
    """Another load was published meanwhile; this one can be run again."""


def _children(spark: SparkSession, folder: str) -> list[str]:
    path, files = file_system(spark, folder)
    return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []


def _delete(spark: SparkSession, folder: str) -> None:
    path, files = file_system(spark, folder)
    files.delete(path, True)


def _years(spark: SparkSession, folder: str) -> dict[int, str]:
    """The folders that a write by order_year left, by year."""
    prefix = "order_year="
    return {int(n[len(prefix) :]): f"{folder}/{n}" for n in _children(spark, folder) if n.startswith(prefix)}


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the table, oldest first; none if it was never loaded."""
    names = _children(spark, f"{path}/{_MANIFESTS}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, str]]:
    """The newest version (0 if there is none), or a given one, and the folder of each order year."""
    known = versions(spark, path)
    version = version or (known[-1] if known else 0)
    if not version:
        return 0, {}
    file, files = file_system(spark, f"{path}/{_MANIFESTS}/{version:08}.json")
    stream = files.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return version, {int(year): f"{path}/{folder}" for year, folder in json.loads(text).items()}


def _publish(spark: SparkSession, path: str, version: int, years: dict[int, str]) -> None:
    """The new manifest is written aside and renamed: from then on it is the table."""
    folder = f"{path}/{_MANIFESTS}"
    aside, files = file_system(spark, f"{folder}/{uuid.uuid4().hex}.tmp")
    final, _ = file_system(spark, f"{folder}/{version:08}.json")
    stream = files.create(aside, False)
    try:
        shown = {str(year): name.removeprefix(f"{path}/") for year, name in sorted(years.items())}
        stream.write(bytearray(json.dumps(shown).encode()))
    finally:
        stream.close()
    if files.exists(final) or not files.rename(aside, final):
        files.delete(aside, False)
        raise ConcurrentLoad(f"version {version} of {path} is there already")


def read(
    spark: SparkSession, path: str, first: date | None = None, last: date | None = None, version: int | None = None
) -> DataFrame:
    """The table, or its lines from ``first`` to ``last``, both included: only the folders of their years are read."""
    _, years = manifest(spark, path, version)
    wanted = [
        folder
        for year, folder in sorted(years.items())
        if (first is None or year >= first.year) and (last is None or year <= last.year)
    ]
    clean = _lines(spark, wanted)
    if first is not None:
        clean = clean.filter(F.col("order_date") >= F.lit(first))
    if last is not None:
        clean = clean.filter(F.col("order_date") <= F.lit(last))
    return clean


def _lines(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    found = spark.read.schema(_STORED).parquet(*folders) if folders else spark.createDataFrame([], _STORED)
    return found.withColumn("order_year", F.year("order_date"))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """The rejected lines of all loads with their reasons and, if the loads gave them, the dates as text."""
    texts = ", ".join(f"{name} string" for name in _TEXTS)
    schema = StructType([*_STORED.fields, *StructType.fromDDL(f"reject_reason string, {texts}").fields])
    folders = [f"{path}/{load}/staged/outcome=rejected" for load in sorted(_children(spark, path)) if load.startswith("load-")]
    there = [f"{f}/{n}" for f in folders for n in _children(spark, f) if n.startswith("order_year=")]
    return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)


def judged(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The columns of the table, NULL where a load has none, with outcome, reject_reason and order_year."""
    reason = reject_reason(rules)
    types = {field.name: field.dataType for field in _STORED}
    marked = lines.withColumns({"reject_reason": reason, "outcome": F.when(reason.isNull(), "accepted").otherwise("rejected")})

    def column(name: str) -> Column:
        given = F.col(name) if name in lines.columns else F.lit(None)
        return given.cast(types.get(name, "string")).alias(name)

    # Only rejected lines need their dates as text.
    texts = [F.when(F.col("reject_reason").isNotNull(), F.col(n) if n in lines.columns else F.lit(None)).cast("string").alias(n) for n in _TEXTS]
    broken = [(~passes(rule)).alias(f"_broken_{i}") for i, rule in enumerate(rules)]
    return marked.select(
        *[column(name) for name in CLEAN_COLUMNS], *texts, "reject_reason", "outcome", *broken
    ).withColumn("order_year", F.year("order_date"))


def _stage(lines: DataFrame, rules: Sequence[Rule], folder: str) -> dict[str, int]:
    """Accepted and rejected lines, written and counted in one pass over the source."""
    seen = Observation()
    broken = [f"_broken_{i}" for i in range(len(rules))]
    counted = judged(lines, rules).observe(
        seen,
        F.count(F.lit(1)).alias("read"),
        F.count_if(F.col("outcome") == "accepted").alias("accepted"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected"),
        *[F.count_if(F.col(b)).alias(b) for b in broken],
    )
    rows = counted.drop(*broken)
    arranged(rows, "outcome", "order_year").write.options(**LOOKUP_OPTIONS).partitionBy("outcome", "order_year").parquet(folder)
    found = seen.get
    named = {rule.name: found[b] for rule, b in zip(rules, broken, strict=True) if found[b]}
    return {"read": found["read"], "accepted": found["accepted"], "rejected": found["rejected"], **named}


def _fresh(spark: SparkSession, staged: Sequence[str], there: Sequence[str]) -> DataFrame:
    """The staged lines whose key their year does not hold yet."""
    known = _lines(spark, there).select("order_year", KEY)
    return _lines(spark, staged).join(known, ["order_year", KEY], "left_anti")


def _grow(spark: SparkSession, load: str, staged: dict[int, str], years: dict[int, str]) -> tuple[dict[int, str], int]:
    """New lines of years that the table has, written with the lines that were there: the folders, and how many were known.

    The keys alone tell first which years get new lines; whole lines are read and moved for those only.
    """
    if not staged:
        return {}, 0
    counts = _fresh(spark, list(staged.values()), [years[year] for year in staged]).groupBy("order_year").count().collect()
    known = _lines(spark, list(staged.values())).count() - sum(row["count"] for row in counts)
    grown = [row["order_year"] for row in counts]
    if grown:
        there = [years[year] for year in grown]
        merged = _lines(spark, there).unionByName(_fresh(spark, [staged[year] for year in grown], there))
        arranged(merged, "order_year").write.options(**LOOKUP_OPTIONS).partitionBy("order_year").parquet(f"{load}/merged")
    for folder in staged.values():
        _delete(spark, folder)
    return _years(spark, f"{load}/merged") if grown else {}, known


def insert(lines: DataFrame, path: str, rules: Sequence[Rule] | None = None, strict: bool = True) -> Load:
    """Add the lines that keep all rules to the table; a strict load is refused whole if one line breaks one.

    A line counts as loaded before if its order year holds its row_id; so loading again, or a load that overlaps with an
    earlier one, adds nothing twice. Only years that get new lines are written anew, with the lines that they had,
    and only the keys of the years that the load touches are read. Lines with one row_id inside one load all stay.
    """
    spark = lines.sparkSession
    path = path.rstrip("/")
    rules = [*not_null_rules(), *range_rules()] if rules is None else rules
    version, years = manifest(spark, path)
    load = f"{path}/load-{uuid.uuid4().hex}"
    try:
        outcomes = _stage(lines, rules, f"{load}/staged")
        if strict and outcomes["rejected"]:
            raise RejectedLines(outcomes)
        staged = _years(spark, f"{load}/staged/outcome=accepted")
        touched = {year: folder for year, folder in staged.items() if year in years}
        merged, known = _grow(spark, load, touched, years)
        published = {year: folder for year, folder in staged.items() if year not in years} | merged
        outcomes |= {"new": outcomes["accepted"] - known, "known": known}
        if published:
            version += 1
            _publish(spark, path, version, years | published)
    except BaseException:
        _delete(spark, load)
        raise
    if not published and not outcomes["rejected"]:
        _delete(spark, load)
    return Load(version, outcomes, sorted(published))


def drop_unused(spark: SparkSession, path: str) -> list[str]:
    """Delete older versions and what failed loads left; rejected lines stay. Not while a load or an older reader runs."""
    path = path.rstrip("/")
    version, years = manifest(spark, path)
    used, gone = set(years.values()), []
    for load in [n for n in _children(spark, path) if n.startswith("load-")]:
        folders = [
            folder
            for part in ("staged/outcome=accepted", "fresh", "merged")
            for folder in _years(spark, f"{path}/{load}/{part}").values()
        ]
        gone += [folder for folder in folders if folder not in used]
    for folder in gone:
        _delete(spark, folder)
    for old in versions(spark, path):
        if old < version:
            _delete(spark, f"{path}/{_MANIFESTS}/{old:08}.json")
    return gone
