"""Service-level costing and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.missing import lenient_sum, percent, ratio, strict_sum
from ..functions.text import route_text
from ..operators.lookup import lookup
from ..operators.rating import (
    LANE,
    RATE_ORDER,
    candidates,
    first_per_order,
    first_rates,
    freight_cost,
)
from ..operators.totals import with_totals
from .marts import require_columns
from .shipping import strict_sum_over

CRF = "CRF"  # customer referred freight: the customer pays, no cost is computed

SERVICE_COLUMNS = (
    "order_id",
    "service_level",
    "weight",
    "carrier",
    "origin_port",
    "destination_port",
    "shipping_cost",
)

# Which row of an order id counts: the first by order date, then by rate, then by the remaining columns. Rows of a
# table have no order in Spark, so whoever wants another first row names its columns.
ROW_ORDER = ("order_date", *RATE_ORDER, *SERVICE_COLUMNS[1:])


def first_row(rows: DataFrame, row_order: tuple[str, ...] = ROW_ORDER) -> DataFrame:
    """The row of each order id that comes first by those columns of `row_order` that the rows have."""
    lead = tuple(c for c in row_order if c in rows.columns)
    return first_per_order(rows.select("order_id", *lead), lead)


def _service_cost() -> Column:
    """Null for CRF and for an unknown level, 0 without a rate, else the freight cost."""
    level = F.col("service_level")
    return F.when(level != CRF, F.coalesce(freight_cost(), F.lit(0.0)))


def service_costing(orders: DataFrame, rates: DataFrame) -> DataFrame:
    """Every order with every rate of its lane and the resulting cost."""
    return candidates(orders, rates, how="left").withColumn("shipping_cost", _service_cost())


def service_costing_by_level(orders: DataFrame, rates: DataFrame) -> DataFrame:
    """The rows of `service_costing` counted and summed by level and mode, without making them.

    Orders are first summed by lane and weight, and then meet the rates of their lane: rows are as many as weights, not
    as orders.
    """
    lane = [left for left, _ in LANE]
    alike = orders.groupBy(*lane, "weight").agg(F.count(F.lit(1)).alias("orders"))
    costed = candidates(alike, rates, how="left").withColumn("cost", _service_cost())
    return costed.groupBy("service_level", "mode_dsc").agg(
        F.sum("orders").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("cost").isNull(), F.col("orders"))), F.lit(0)).alias("n_uncosted"),
        F.sum(F.col("cost") * F.col("orders")).alias("total_cost"),
    )


def cost_by_first_rate(
    orders: DataFrame,
    rates: DataFrame,
    *,
    unique_ids: bool = False,
    rate_order: tuple[str, ...] = RATE_ORDER,
    row_order: tuple[str, ...] = ROW_ORDER,
) -> DataFrame:
    """One row per order, costed with the first rate of its lane (no band test).

    Rows of a table have no order in Spark, so "first" follows rate_order within a lane and row_order within an
    order id; pass an ordinal column to follow file order. The orders meet one row per lane and never fan out.
    """
    first = first_rates(rates, rate_order)
    joined = lookup(orders, first, LANE, how="left")
    costed = joined.withColumn("shipping_cost", _service_cost())
    if not unique_ids:
        costed = first_row(costed, row_order)
    return costed.select(*SERVICE_COLUMNS)


def service_lanes(costed: DataFrame) -> DataFrame:
    """Orders, weight and cost per lane, carrier and level: the base of the three summaries."""
    require_columns(costed, SERVICE_COLUMNS, "service level analysis")
    return costed.groupBy("carrier", "origin_port", "destination_port", "service_level").agg(
        F.count(F.lit(1)).alias("orders"),
        strict_sum("weight").alias("total_weight"),
        lenient_sum("shipping_cost").alias("total_cost"),
    )


def _roll_up(lanes: DataFrame, *keys: str) -> DataFrame:
    return lanes.groupBy(*keys).agg(
        F.sum("orders").alias("orders"),
        strict_sum("total_weight").alias("total_weight"),
        F.sum("total_cost").alias("total_cost"),
    )


def _billed(c: Column) -> Column:
    """A measure that customers do not pay for themselves; null for CRF and unknown levels."""
    return F.when(F.col("service_level") != CRF, c)


def _billed_cost() -> Column:
    """Cost counted into the base of cost shares: nothing for CRF, null for an unknown level."""
    level = F.col("service_level")
    return F.when(level == CRF, F.lit(0.0)).when(level != CRF, F.col("total_cost"))


def _cost_share(base: Column | str) -> Column:
    level = F.col("service_level")
    share = percent("total_cost", base)
    return F.when(level == CRF, F.lit(0.0)).when(level != CRF, share)


def service_summary(lanes: DataFrame) -> DataFrame:
    """Orders, weight and cost per service level with unit costs and shares."""
    df = with_totals(
        _roll_up(lanes, "service_level"),
        orders=F.sum("orders"),
        weight=strict_sum("total_weight"),
        billed=strict_sum(_billed_cost()),
    )
    return df.select(
        "service_level",
        "orders",
        "total_weight",
        "total_cost",
        ratio("total_weight", "orders").alias("avg_weight_per_order"),
        _billed(ratio("total_cost", "orders")).alias("avg_cost_per_order"),
        _billed(ratio("total_cost", "total_weight")).alias("avg_cost_per_kg"),
        percent("orders", "totals.orders").alias("pct_orders"),
        percent("total_weight", "totals.weight").alias("pct_weight"),
        _cost_share("totals.billed").alias("pct_cost"),
    )


def carrier_service(lanes: DataFrame) -> DataFrame:
    """Service levels of each carrier with shares within the carrier."""
    df = _roll_up(lanes, "carrier", "service_level").withColumn("billed", _billed_cost())
    own = W.partitionBy("carrier")
    return df.select(
        "carrier",
        "service_level",
        "orders",
        "total_weight",
        "total_cost",
        _billed(ratio("total_cost", "total_weight")).alias("avg_cost_per_kg"),
        percent("orders", F.sum("orders").over(own)).alias("pct_carrier_orders"),
        percent("total_weight", strict_sum_over("total_weight", own)).alias("pct_carrier_weight"),
        _cost_share(strict_sum_over("billed", own)).alias("pct_carrier_cost"),
    )


def route_service(lanes: DataFrame) -> DataFrame:
    """Service levels of each route with the share of all billed cost."""
    df = with_totals(
        _roll_up(lanes, "origin_port", "destination_port", "service_level"),
        billed=strict_sum(_billed_cost()),
        orders=F.sum("orders"),
        weight=strict_sum("total_weight"),
    )
    return df.select(
        "origin_port",
        "destination_port",
        "service_level",
        "orders",
        "total_weight",
        "total_cost",
        _billed(ratio("total_cost", "total_weight")).alias("avg_cost_per_kg"),
        route_text("origin_port", "destination_port").alias("route"),
        _cost_share("totals.billed").alias("pct_cost"),
    )


def service_cost_efficiency(summary: DataFrame) -> DataFrame:
    """Cost per kg of the levels that carry a cost."""
    return summary.where(F.col("service_level") != CRF).select(
        "service_level", "avg_cost_per_kg", "total_weight"
    )


def analyze_service_levels(
    rows: DataFrame, *, one_row_per_order: bool = False, row_order: tuple[str, ...] = ROW_ORDER
) -> dict[str, DataFrame]:
    """The three summaries of costed order rows; the first row of each order counts, by `row_order`."""
    require_columns(rows, SERVICE_COLUMNS, "service level analysis")
    if not one_row_per_order:
        rows = first_row(rows, row_order)
    lanes = service_lanes(rows)
    return {
        "service_summary": service_summary(lanes),
        "carrier_service": carrier_service(lanes),
        "route_service": route_service(lanes),
    }


def service_distribution(orders: DataFrame) -> DataFrame:
    """Orders per service level and their share of all orders."""
    df = with_totals(
        orders.groupBy("service_level").agg(F.count(F.lit(1)).alias("n")), n=F.sum("n")
    )
    return df.withColumn("percentage", percent("n", "totals.n")).drop("totals")
