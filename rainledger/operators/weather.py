"""Temperature, humidity and description side by side per date and city."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["date", "city"]
COLUMNS = ["date", "city", "temperature", "humidity", "description"]


def combined_weather_inner(
    temperature: DataFrame, humidity: DataFrame, description: DataFrame
) -> DataFrame:
    """Only the cells for which all three tables have a row."""
    return temperature.join(humidity, KEYS).join(description, KEYS).select(*COLUMNS)


def combined_weather_left(
    temperature: DataFrame, humidity: DataFrame, description: DataFrame
) -> DataFrame:
    """Every temperature cell, with humidity and description where known."""
    return temperature.join(humidity, KEYS, "left").join(description, KEYS, "left").select(*COLUMNS)


def combined_weather_any(
    temperature: DataFrame, humidity: DataFrame, description: DataFrame
) -> DataFrame:
    """Every cell that any of the three tables has: one lookup instead of three."""
    both = temperature.join(humidity, KEYS, "full").join(description, KEYS, "full")
    return both.select(*COLUMNS)


def combined_weather_as_written(
    temperature: DataFrame, humidity: DataFrame, description: DataFrame
) -> DataFrame:
    """The view whose second condition forgets the city: a cell meets every text of its date.

    Equal rows are kept as one row with the number of ``copies``, so nothing is lost and
    no date has to list all its pairs.
    """
    cells = temperature.join(humidity, KEYS).select("date", "city", "temperature", "humidity")
    texts = description.groupBy("date", "description").agg(F.count("*").alias("copies"))
    return cells.join(texts, "date").select(*COLUMNS, "copies")
