"""Summaries of the shipping-cost mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.missing import choose, percent, ratio, strict_mean, strict_sum
from ..functions.text import ARROW, band_label, band_text, comma_text, dollar_text, route_text
from ..operators.bands import band_position
from ..operators.lookup import lookup
from ..operators.rating import LANE, clean_rates
from ..operators.totals import with_totals


# What counts as large enough for a label.
LABEL_ORDERS, LABEL_WEIGHT = 10000, 100000
DETAIL_WEIGHT = 10000


def routes(shipping: DataFrame) -> DataFrame:
    """Cost and orders per lane, carrier and mode (the export form)."""
    return shipping.groupBy("origin_port", "destination_port", "carrier", "mode_dsc").agg(
        strict_sum("total_shipping_cost").alias("total_shipping_cost"),
        F.sum("n_orders").alias("n_orders"),
    )


def route_summary(shipping: DataFrame) -> DataFrame:
    """Routes with their share of the total cost and the cost per order."""
    df = with_totals(
        routes(shipping), cost=strict_sum("total_shipping_cost"), orders=F.sum("n_orders")
    )
    return df.withColumns(
        {
            "pct_of_total": percent("total_shipping_cost", "totals.cost"),
            "avg_cost_per_order": ratio("total_shipping_cost", "n_orders"),
        }
    ).drop("totals")


def route_labels(shipping: DataFrame) -> DataFrame:
    """Routes with the texts shown beside them."""
    lane = F.concat("origin_port", F.lit(ARROW), "destination_port", F.lit("\n"), "carrier")
    label = F.concat("cost_label", F.lit("\n("), comma_text("n_orders"), F.lit(" orders)"))
    return (
        routes(shipping)
        .withColumn("route_label", lane)
        .withColumn("cost_label", dollar_text("total_shipping_cost", 0))
        .withColumn("label_text", label)
    )


def category_order(df: DataFrame, category: str, measure: str) -> DataFrame:
    """Categories in the order of their median measure."""
    return (
        df.groupBy(category)
        .agg(F.median(measure).alias("sort_value"))
        .orderBy(F.asc_nulls_last("sort_value"), category)
    )


def transport_modes(shipping: DataFrame) -> DataFrame:
    """Cost, orders and weight per transport mode (the export form)."""
    return (
        shipping.groupBy("mode_dsc")
        .agg(
            strict_sum("total_shipping_cost").alias("total_cost"),
            F.sum("n_orders").alias("total_orders"),
            strict_sum("total_weight").alias("total_weight"),
        )
        .withColumn("avg_cost_per_order", ratio("total_cost", "total_orders"))
    )


def transport_mode_summary(shipping: DataFrame) -> DataFrame:
    """Transport modes with their share of the total cost and the cost per kg."""
    df = with_totals(
        transport_modes(shipping),
        cost=strict_sum("total_cost"),
        orders=F.sum("total_orders"),
        weight=strict_sum("total_weight"),
    )
    return df.withColumns(
        {
            "pct_of_total": percent("total_cost", "totals.cost"),
            "avg_cost_per_kg": ratio("total_cost", "total_weight"),
        }
    ).drop("totals")


def shipping_shares(shipping: DataFrame) -> DataFrame:
    """Each mart row's share of the total cost and of all orders."""
    df = with_totals(shipping, cost=strict_sum("total_shipping_cost"), orders=F.sum("n_orders"))
    return df.select(
        "origin_port",
        "destination_port",
        "carrier",
        "weight_band",
        "mode_dsc",
        "total_shipping_cost",
        "n_orders",
        percent("total_shipping_cost", "totals.cost").alias("pct_total_cost"),
        percent("n_orders", "totals.orders").alias("pct_total_orders"),
    )


def weight_band_use(shipping: DataFrame) -> DataFrame:
    """Orders and weight per carrier and band, with the label of the large ones."""
    large = (F.col("total_orders") > LABEL_ORDERS) | (F.col("total_weight") > LABEL_WEIGHT)
    label = F.concat("carrier", F.lit("\n"), comma_text("total_orders"), F.lit(" orders"))
    return (
        shipping.groupBy("carrier", "weight_band")
        .agg(
            F.sum("n_orders").alias("total_orders"),
            strict_sum("total_weight").alias("total_weight"),
        )
        .withColumn("avg_weight_per_order", ratio("total_weight", "total_orders"))
        .withColumn("point_label", F.when(large, label).otherwise(F.lit("")))
    )


def weight_band_detail(shipping: DataFrame) -> DataFrame:
    """Mart rows with order and weight labels; only rows above 10,000 kg show theirs."""
    weight = comma_text("total_weight")
    label = F.concat(comma_text("n_orders"), F.lit(" orders\n"), weight, F.lit(" kg"))
    return (
        shipping.withColumn("weight_band", band_label("weight_band"))
        .withColumn("order_label", label)
        .withColumn("significant", F.col("total_weight") > DETAIL_WEIGHT)
        .withColumn("label_text", choose(F.col("significant"), F.col("order_label"), F.lit("")))
    )


def weight_band_efficiency(shipping: DataFrame) -> DataFrame:
    """Totals and unweighted mean unit costs per carrier, mode and band."""
    return shipping.groupBy("carrier", "mode_dsc", "weight_band").agg(
        strict_sum("total_shipping_cost").alias("total_cost"),
        strict_sum("total_weight").alias("total_weight"),
        F.sum("n_orders").alias("total_orders"),
        strict_mean(ratio("total_shipping_cost", "total_weight")).alias("avg_cost_per_kg"),
        strict_mean(ratio("total_shipping_cost", "n_orders")).alias("avg_cost_per_order"),
    )


def row_efficiency(shipping: DataFrame) -> DataFrame:
    """Per mart row: cost per kg, cost per order and weight moved per unit of cost."""
    return shipping.withColumns(
        {
            "cost_per_kg": ratio("total_shipping_cost", "total_weight"),
            "cost_per_order": ratio("total_shipping_cost", "n_orders"),
            "efficiency_score": ratio("total_weight", "total_shipping_cost"),
        }
    )


def weight_band_service_mix(orders: DataFrame, rates: DataFrame) -> DataFrame:
    """Weight, orders and cost per carrier, candidate band and service level.

    Every rate of the lane counts, in band or not. The measures are sums that a rate only scales, so
    orders are summed per lane first and the join with the rate card works on lanes, not on orders.
    """
    lanes = (
        orders.where(F.col("service_level").isNotNull())
        .groupBy(*[left for left, _ in LANE])
        .agg(strict_sum("weight").alias("lane_weight"), F.count(F.lit(1)).alias("lane_orders"))
    )
    card = clean_rates(rates).withColumnRenamed("carrier", "rate_carrier")
    band = band_label(band_text("minm_wgh_qty", "max_wgh_qty"))
    mix = (
        lookup(lanes, card, LANE, how="left")
        .groupBy("carrier", band.alias("weight_band"), "service_level")
        .agg(
            strict_sum("lane_weight").alias("total_weight"),
            F.sum("lane_orders").alias("total_orders"),
            strict_sum(F.col("lane_weight") * F.col("rate")).alias("total_cost"),
        )
        .withColumn("avg_cost_per_kg", ratio("total_cost", "total_weight"))
    )
    in_band = F.sum("total_orders").over(W.partitionBy("carrier", "weight_band"))
    return mix.withColumn("pct_orders", percent("total_orders", in_band))


def carrier_service_mix(mix: DataFrame) -> DataFrame:
    """Service levels of each carrier with their share of its orders and weight."""
    carrier = W.partitionBy("carrier")
    return (
        mix.groupBy("carrier", "service_level")
        .agg(
            F.sum("total_orders").alias("total_orders"),
            strict_sum("total_weight").alias("total_weight"),
        )
        .withColumn("pct_orders", percent("total_orders", F.sum("total_orders").over(carrier)))
        .withColumn(
            "pct_weight", percent("total_weight", strict_sum_over("total_weight", carrier))
        )
    )


def strict_sum_over(c: str, window) -> Column:
    """Windowed sum that is null when any row of the window is null."""
    known = F.count(c).over(window) == F.count(F.lit(1)).over(window)
    return F.when(known, F.sum(c).over(window))


def weight_band_routes(shipping: DataFrame) -> DataFrame:
    """Weight, orders and unweighted mean cost per kg per route, carrier and band."""
    band = band_label("weight_band")
    # Fixed rule: an unknown band out of PORT09 is the open 0 - 5000 band.
    filled = F.when(band.isNull() & (F.col("origin_port") == "PORT09"), F.lit("0 - 5000")).otherwise(band)
    return (
        shipping.withColumn("route", route_text("origin_port", "destination_port"))
        .withColumn("weight_band", filled)
        .groupBy("route", "carrier", "weight_band")
        .agg(
            strict_sum("total_weight").alias("total_weight"),
            F.sum("n_orders").alias("total_orders"),
            strict_mean("avg_cost_per_kg").alias("avg_cost_per_kg"),
        )
        .withColumn("weight_band_ord", band_position("weight_band"))
    )


def carrier_costs(shipping: DataFrame) -> DataFrame:
    """Mean cost per mart row, weight and cost per kg per carrier and mode."""
    return (
        shipping.groupBy("carrier", "mode_dsc")
        .agg(
            strict_mean("total_shipping_cost").alias("avg_cost"),
            strict_sum("total_weight").alias("total_volume"),
            strict_sum("total_shipping_cost").alias("total_cost"),
        )
        .select(
            "carrier",
            "mode_dsc",
            "avg_cost",
            "total_volume",
            ratio("total_cost", "total_volume").alias("cost_per_kg"),
        )
    )
