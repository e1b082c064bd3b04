"""Checks on tables: what a database constraint would refuse, as rows one can look at."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainledger.functions.measures import share_percent
from rainledger.sources.schemas import REQUIRED, TEXT_LIMITS


class Rule(NamedTuple):
    """``holds`` may be NULL, which passes, as in a CHECK constraint."""

    name: str
    holds: Column


class Split(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def not_null_rules(columns: Sequence[str] = REQUIRED) -> list[Rule]:
    return [Rule(f"{name} is missing", F.col(name).isNotNull()) for name in columns]


def range_rules(max_discount: Decimal = Decimal("1")) -> list[Rule]:
    return [
        Rule("quantity is not positive", F.col("quantity") > 0),
        Rule("discount is out of range", F.col("discount").between(F.lit(0), F.lit(max_discount))),
    ]


def clean_rules() -> list[Rule]:
    readable = F.col("ship_date_text").isNull() | F.col("ship_date").isNotNull()
    return [*not_null_rules(), *range_rules(), Rule("ship_date is not a date", readable)]


def passes(rule: Rule) -> Column:
    """A rule that gives NULL is kept."""
    return F.coalesce(rule.holds, F.lit(True))


def reject_reason(rules: Sequence[Rule]) -> Column:
    """Names of all broken rules, NULL if there are none."""
    broken = F.concat_ws("; ", *[F.when(~passes(rule), F.lit(rule.name)) for rule in rules])
    return F.nullif(broken, F.lit(""))


def split(table: DataFrame, rules: Sequence[Rule]) -> Split:
    everything = reduce(lambda a, b: a & b, [passes(rule) for rule in rules])
    rejected = table.withColumn("reject_reason", reject_reason(rules)).filter(~everything)
    return Split(table.filter(everything), rejected)


def check_not_null(table: DataFrame, columns: Sequence[str] = REQUIRED) -> Split:
    return split(table, not_null_rules(columns))


def check_ranges(table: DataFrame, max_discount: Decimal = Decimal("1")) -> Split:
    return split(table, range_rules(max_discount))


def outcome_counts(table: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Lines per outcome; accepted lines stand under 'accepted'."""
    outcome = F.coalesce(reject_reason(rules), F.lit("accepted"))
    return table.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n_rows"))


def check_unique(table: DataFrame, keys: Sequence[str], primary: bool = False) -> DataFrame:
    """Key values that occur more than once.

    A unique rule lets keys with a NULL part repeat; a primary key refuses them, even a single one.
    """
    counted = table.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    whole = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    broken = whole & (F.col("n_rows") > 1)
    return counted.filter(broken | ~whole if primary else broken)


def key_text(keys: Sequence[str]) -> Column:
    """The parts of a key as one text in which a NULL part shows."""
    return F.concat_ws("|", *[F.coalesce(F.col(key).cast("string"), F.lit("NULL")) for key in keys])


def check_length(table: DataFrame, limits: dict[str, int] = TEXT_LIMITS) -> DataFrame:
    """One row per text column: limit, longest text and how many texts are too long."""
    checked = [(name, limit) for name, limit in limits.items() if name in table.columns]
    measured = table.agg(
        *[F.max(F.length(name)).alias(f"longest_{name}") for name, _ in checked],
        *[F.count_if(F.length(name) > limit).alias(f"over_{name}") for name, limit in checked],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(limit).alias("max_length"),
                F.col(f"longest_{name}").alias("longest"),
                F.col(f"over_{name}").alias("too_long"),
            )
            for name, limit in checked
        ]
    )
    return measured.select(F.inline(rows))


def order_id_multiplicity(orders: DataFrame) -> DataFrame:
    """Orders with more than one line, the longest first."""
    counted = orders.groupBy("order_id").agg(F.count("*").alias("cnt"))
    return counted.filter(F.col("cnt") > 1).orderBy(F.desc("cnt"), "order_id")


def duplicate_row_ids(clean: DataFrame, limit: int = 10) -> DataFrame:
    counted = clean.groupBy("row_id").agg(F.count("*").alias("duplicate_count"))
    repeated = counted.filter(F.col("duplicate_count") > 1)
    return repeated.orderBy(F.desc("duplicate_count"), "row_id").limit(limit)


def null_row_id_count(clean: DataFrame) -> DataFrame:
    return clean.filter(F.col("row_id").isNull()).agg(F.count("*").alias("null_row_ids"))


def dedupe_row_id(table: DataFrame) -> DataFrame:
    """One line per row_id: the first in the order of all other columns.

    Catalyst turns the filter into a per-task limit ahead of the shuffle, so a row_id with
    very many copies sends one line per task.
    """
    rest = [name for name in table.columns if name != "row_id"]
    first = Window.partitionBy("row_id").orderBy(*rest)
    return table.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n")


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n_rows"))


def row_counts(lines: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Number of rows after each named step, in one pass: each step says how many rows a line gives."""
    sums = lines.agg(*[F.coalesce(F.sum(rows.cast("long")), F.lit(0)).alias(name) for name, rows in steps.items()])
    pairs = [F.struct(F.lit(name).alias("step"), F.col(name).alias("n_rows")) for name in steps]
    return sums.select(F.inline(F.array(*pairs)))


def weather_coverage(final: DataFrame) -> DataFrame:
    """How many lines got a temperature, a humidity and a description, as counts and percentages."""
    known = {
        "temp": F.col("temperature").isNotNull(),
        "humidity": F.col("humidity").isNotNull(),
        "desc": F.col("weather_condition").isNotNull(),
    }
    return final.agg(
        F.count("*").alias("total_records"),
        *[F.count_if(c).alias(f"{name}_coverage") for name, c in known.items()],
        *[share_percent(c).alias(f"{name}_pct") for name, c in known.items()],
    )
