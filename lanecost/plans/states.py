"""The marts as states by day that add up, so that a new day is priced alone and merged with the days before.

A state has one row for each key of its mart and each order date: the rows counted, and for each measure its sum and how
many rows knew it. Sums are decimals of DIGITS digits after the point, so they do not depend on the order in which days,
tasks or files are added. A mart is a roll-up of its state: a measure is null as soon as one row did not know it.

Rates compete within an order id. The states of two days add up to the state of both if no id has rows on both, as where
ids are unique.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import ratio
from ..operators.bands import band_position
from ..operators.rating import rate_orders
from .marts import ORDER_COLUMNS, RATE_COLUMNS, checked_rows, require_columns, warehouse_capacity_of, warehouse_costs_of

DIGITS = 9
DAY = "order_date"
SHIPPING_KEY = ("origin_port", "destination_port", "carrier", "weight_band", "mode_dsc")
SHIPPING_MEASURES = ("shipping_cost", "weight")
PLANT_KEY = ("plant_code",)
PLANT_MEASURES = ("weight", "unit_quantity")


def _state(rows: DataFrame, key: Sequence[str], measures: Sequence[str]) -> DataFrame:
    parts = [F.count(F.lit(1)).alias("n_rows")]
    for m in measures:
        parts.append(F.sum(F.col(m).cast(f"decimal(29,{DIGITS})")).alias(f"{m}_sum"))
        parts.append(F.count(m).alias(f"{m}_known"))
    return rows.groupBy(*key, DAY).agg(*parts)


def shipping_state(orders: DataFrame, rates: DataFrame, *, ties: str = "all", unique_ids: bool = False) -> DataFrame:
    """The state of the shipping mart: rated orders by lane, carrier, weight band, mode and day."""
    require_columns(orders, (*ORDER_COLUMNS, DAY), "shipping cost calculation")
    require_columns(rates, RATE_COLUMNS, "shipping cost calculation")
    rated = rate_orders(orders, rates, ties=ties, unique_ids=unique_ids)
    return _state(rated, SHIPPING_KEY, SHIPPING_MEASURES)


def plant_state(orders: DataFrame) -> DataFrame:
    """The state that both warehouse marts share: orders by plant and day."""
    require_columns(orders, ("plant_code", "weight", "unit_quantity", DAY), "warehouse cost calculation")
    return _state(orders, PLANT_KEY, PLANT_MEASURES)


def _parts(state: DataFrame) -> tuple[list[str], list[str]]:
    """Key columns (the day among them) and columns that add up."""
    adds = [c for c in state.columns if c == "n_rows" or c.endswith(("_sum", "_known"))]
    return [c for c in state.columns if c not in adds], adds


def _added(state: DataFrame, key: Sequence[str]) -> DataFrame:
    _, adds = _parts(state)
    return state.groupBy(*key).agg(*[F.sum(c).cast(state.schema[c].dataType).alias(c) for c in adds])


def merge(*states: DataFrame) -> DataFrame:
    """One state from several of the same mart; days that occur in several are added up."""
    key, _ = _parts(states[0])
    return _added(reduce(DataFrame.unionByName, states), key)


def between(state: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """The days of a state from `first` to `last`, both included. A stored state reads the files of these days only."""
    if first is not None:
        state = state.where(F.col(DAY) >= F.lit(first))
    return state if last is None else state.where(F.col(DAY) <= F.lit(last))


def _whole(measure: str) -> Column:
    """The sum of a measure, null when any row did not know it."""
    return F.when(F.col(f"{measure}_known") == F.col("n_rows"), F.col(f"{measure}_sum").cast("double"))


def shipping_costs(state: DataFrame, *, check: bool = True) -> DataFrame:
    """The shipping mart of all days of a state."""
    mart = (
        _added(state, SHIPPING_KEY)
        .select(
            *SHIPPING_KEY,
            _whole("shipping_cost").alias("total_shipping_cost"),
            _whole("weight").alias("total_weight"),
            F.col("n_rows").alias("n_orders"),
        )
        .withColumn("avg_cost_per_kg", ratio("total_shipping_cost", "total_weight"))
        .withColumn("weight_band_ord", band_position("weight_band"))
    )
    return checked_rows(mart) if check else mart


def warehouse_costs(state: DataFrame, wh_costs: DataFrame, *, period: tuple[int, int] | None = None) -> DataFrame:
    """The warehouse cost mart of all days of a state."""
    plants = _added(state, PLANT_KEY).select(
        *PLANT_KEY,
        F.col("n_rows").alias("total_orders"),
        _whole("weight").alias("total_weight"),
        _whole("unit_quantity").alias("total_units"),
    )
    return warehouse_costs_of(plants, wh_costs, period=period)


def warehouse_capacity(state: DataFrame, wh_capacities: DataFrame) -> DataFrame:
    """The capacity mart of all days of a state."""
    plants = _added(state, PLANT_KEY).select(*PLANT_KEY, F.col("n_rows").alias("n"))
    return warehouse_capacity_of(plants, wh_capacities)


def write_days(state: DataFrame, path: str, first: date, last: date | None = None) -> None:
    """Store a state's days from `first` to `last` (the same day by default), a folder for each day.

    Days are replaced, never added to, so a run can be repeated and late orders come in by running their day again. A day
    of the period without any row is emptied. Other days of the state are not written.
    """
    last = first if last is None else last
    days = state.sparkSession.sql(
        "SELECT explode(sequence(CAST(:first AS DATE), CAST(:last AS DATE))) AS day", {"first": str(first), "last": str(last)}
    )
    own = between(state, first, last)
    # a row without a key stands for each day, so that every folder of the period is replaced
    blank = days.select(*[F.col("day").alias(DAY) if c == DAY else F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns])
    every = own.unionByName(blank)
    writer = every.repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DAY).parquet(path)


def read_days(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """A stored state; with a period, only the folders of its days are read."""
    return between(spark.read.parquet(path), first, last).where("n_rows IS NOT NULL")
