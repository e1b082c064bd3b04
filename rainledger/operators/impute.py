"""Filling weather gaps from the nearest known readings of the same day.

A line takes the reading of its own city; failing that the mean over the cities of its
state, then of its region, then of all cities. Texts have no mean: the alphabetically
first known text of the rung is taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rainledger.operators.lookup import join_lookup, row_bytes
from rainledger.shared import new_folder
from rainledger.sources.schemas import MEAN_READING

TEXT = "description"
# Rung name -> the line's columns it is looked up by, nearest rung first.
RUNGS = {
    "city": ["order_date", "city"],
    "state": ["order_date", "state"],
    "region": ["order_date", "region"],
    "date": ["order_date"],
}


def city_state_reference(orders: DataFrame) -> DataFrame:
    """One region for each (city, state); the alphabetically first if the lines disagree.

    Distinct triples come first, so the text minimum sorts a handful of rows, not all lines.
    """
    known = orders.filter(F.col("city").isNotNull() & F.col("state").isNotNull())
    triples = known.select("city", "state", "region").distinct()
    return triples.groupBy("city", "state").agg(F.min("region").alias("region"))


def _readings(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables stacked: one column per measure, NULL in the rows of the others."""
    stacked = [t.select(F.col("date").alias("order_date"), "city", name) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)


def _placed(tables: dict[str, DataFrame], reference: DataFrame) -> DataFrame:
    """Every reading once for each state of its city; ``own`` marks one of them, also where no state is known."""
    one_each = Window.partitionBy("city").orderBy("state")
    places = reference.withColumn("own", F.row_number().over(one_each) == 1)
    joined = _readings(tables).join(places, "city", "left")
    return joined.withColumn("own", F.coalesce("own", F.lit(True)))


def _sums(name: str) -> list[Column]:
    if name == TEXT:
        return [F.min(name).alias(name)]
    once = F.when(F.col("own"), F.col(name))
    return [
        F.max(name).alias(f"max_{name}"),
        F.sum(name).alias(f"sum_{name}"),
        F.count(name).alias(f"count_{name}"),
        F.sum(once).alias(f"own_sum_{name}"),
        F.count(once).alias(f"own_count_{name}"),
    ]


def _value(name: str) -> Column:
    if name == TEXT:
        return F.col(name)
    rung = F.col("rung")
    mean = F.try_divide(F.col(f"sum_{name}"), F.col(f"count_{name}")).cast(MEAN_READING)
    own_mean = F.try_divide(F.col(f"own_sum_{name}"), F.col(f"own_count_{name}")).cast(MEAN_READING)
    city = F.col(f"max_{name}").cast(MEAN_READING)
    return F.when(rung == "city", city).when(rung == "date", own_mean).otherwise(mean).alias(name)


def lookup_rows(tables: dict[str, DataFrame], reference: DataFrame) -> DataFrame:
    """rung, order_date, place and one value per measure: all four rungs from one aggregation.

    The grouping sets are (day, city), (day, state), (day, region) and (day). A city listed under several states of a
    region counts once for each of them in the region's mean, and once in the day's. Days and places that are NULL
    meet no line and are left out.
    """
    columns = ["order_date", "city", "state", "region"]
    sets = [[F.col(c) for c in keys] for keys in RUNGS.values()]
    grouped = _placed(tables, reference).groupingSets(sets, *[F.col(c) for c in columns])
    # One bit per column, the first one the highest: set where the column is no key of the row's set.
    unused = {sum(1 << (3 - i) for i, c in enumerate(columns) if c not in keys): rung for rung, keys in RUNGS.items()}
    rung = reduce(lambda chain, item: chain.when(F.col("unused") == item[0], F.lit(item[1])), unused.items(), F)
    sums = [c for name in tables for c in _sums(name)]
    rows = grouped.agg(F.grouping_id().alias("unused"), *sums).withColumns(
        {"rung": rung, "place": F.coalesce("city", "state", "region")}
    )
    known = F.col("order_date").isNotNull() & ((F.col("rung") == "date") | F.col("place").isNotNull())
    return rows.filter(known).select("rung", "order_date", "place", *[_value(name) for name in tables])


def rungs(tables: dict[str, DataFrame], reference: DataFrame) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """One lookup per rung holding ``<rung>_<measure>`` for every measure, and the bytes of each.

    All of them are one stored table with a folder per rung; the bytes are counted while it is written.
    """
    rows, seen = lookup_rows(tables, reference), Observation()
    counted = rows.observe(
        seen, *[F.coalesce(F.sum(F.when(F.col("rung") == rung, row_bytes(rows))), F.lit(0)).alias(rung) for rung in RUNGS]
    )
    path = new_folder(rows.sparkSession, "rungs")
    counted.write.partitionBy("rung").parquet(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    lookups = {}
    for rung, keys in RUNGS.items():
        values = [F.col(name).alias(f"{rung}_{name}") for name in tables]
        own = [F.col("order_date"), *[F.col("place").alias(c) for c in keys[1:]]]
        lookups[rung] = stored.filter(F.col("rung") == rung).select(*own, *values)
    return lookups, seen.get


def _level(name: str) -> Column:
    found = reduce(
        lambda chain, rung: chain.when(F.col(f"{rung}_{name}").isNotNull(), F.lit(rung)), RUNGS, F
    )
    return found.otherwise("none")


def impute(
    orders: DataFrame,
    tables: dict[str, DataFrame],
    reference: DataFrame,
    levels: bool = False,
) -> DataFrame:
    """``orders`` plus one filled column per table, named after the measure.

    The four rungs of all measures share four joins. With ``levels`` each measure also
    gets ``<measure>_level``: city, state, region, date or none.
    """
    lookups, sizes = rungs(tables, reference)
    found = orders
    for rung, keys in RUNGS.items():
        found = join_lookup(found, lookups[rung], keys, "left", size=sizes[rung], ready=True)
    filled = [F.coalesce(*[F.col(f"{r}_{name}") for r in RUNGS]).alias(name) for name in tables]
    if levels:
        filled += [_level(name).alias(f"{name}_level") for name in tables]
    return found.select(*orders.columns, *filled)


def impute_temperature(orders: DataFrame, temperature: DataFrame, reference: DataFrame) -> DataFrame:
    return impute(orders, {"temperature": temperature}, reference)


def impute_humidity(orders: DataFrame, humidity: DataFrame, reference: DataFrame) -> DataFrame:
    return impute(orders, {"humidity": humidity}, reference)


def impute_description(orders: DataFrame, description: DataFrame, reference: DataFrame) -> DataFrame:
    return impute(orders, {TEXT: description}, reference)


def impute_level(orders: DataFrame, tables: dict[str, DataFrame], reference: DataFrame) -> DataFrame:
    """As ``impute``, telling for every value which rung it came from."""
    return impute(orders, tables, reference, levels=True)


def sales_weather_final(
    orders: DataFrame, tables: dict[str, DataFrame], reference: DataFrame
) -> DataFrame:
    """All lines with filled weather; the text is called ``weather_condition``.

    ``tables`` may hold fewer than three measures when a report needs only those.
    """
    wanted: Sequence[str] = [name for name in ("temperature", "humidity", TEXT) if name in tables]
    filled = impute(orders, {name: tables[name] for name in wanted}, reference)
    return filled.withColumnRenamed(TEXT, "weather_condition")
