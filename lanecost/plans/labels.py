"""Summaries with the texts that stand beside their figures in reports. A missing figure gives a missing text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import col
from ..functions.text import comma_text, dollar_text, dollar_text_auto, number_text, percent_text, snapped

HEAVY = 1000  # kilograms; lighter rows have an empty text


def _whole_percent(c: str) -> Column:
    return F.concat(F.bround(snapped(c), 0).cast("decimal(38,0)").cast("string"), F.lit("%"))


def _orders(c: str) -> Column:
    return F.concat(comma_text(c), F.lit(" orders"))


def _lines(*parts: Column) -> Column:
    return F.concat(parts[0], *[x for p in parts[1:] for x in (F.lit("\n"), p)])


def _if_heavy(text: Column) -> Column:
    return F.when(F.col("total_weight") > HEAVY, text).when(F.col("total_weight") <= HEAVY, F.lit(""))


def storage(ranking: DataFrame) -> DataFrame:
    """A storage ranking with cost, units and unit cost as texts."""
    return ranking.withColumns(
        {
            "cost_label": dollar_text_auto("storage_cost"),
            "units_label": comma_text("total_units"),
            "efficiency_label": dollar_text("cost_per_unit", 2),
        }
    )


def order_shares(rows: DataFrame, share: str, orders: str) -> DataFrame:
    """Share of the orders in whole percent, then their number."""
    return rows.withColumn("label", _lines(_whole_percent(share), _orders(orders)))


def service_summary(summary: DataFrame) -> DataFrame:
    """Share of the orders with one decimal, then their number."""
    return summary.withColumn("label", _lines(percent_text("pct_orders"), _orders("orders")))


def band_routes(rows: DataFrame) -> DataFrame:
    """Weight of heavy rows in tens of kilograms, then the orders."""
    tens = F.concat(comma_text(F.bround(snapped("total_weight"), -1)), F.lit(" kg"))
    return rows.withColumn("label", _if_heavy(_lines(tens, _orders("total_orders"))))


def route_service(rows: DataFrame) -> DataFrame:
    """Weight of heavy rows, then the orders in brackets."""
    weight = F.concat(comma_text("total_weight"), F.lit(" kg"))
    orders = F.concat(F.lit("("), _orders("orders"), F.lit(")"))
    return rows.withColumn("label_text", _if_heavy(_lines(weight, orders)))


def service_costs(rows: DataFrame) -> DataFrame:
    """Cost per kilogram, then the weight."""
    cost = F.concat(F.lit("$"), number_text(F.bround(snapped("avg_cost_per_kg"), 2)), F.lit("/kg"))
    weight = F.concat(comma_text(col("total_weight")), F.lit(" kg total"))
    return rows.withColumn("label", _lines(cost, weight))
