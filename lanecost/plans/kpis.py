"""Key figures as one-row frames: the number and its display text; null means "No data"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import lenient_sum, percent, ratio, strict_mean, strict_sum
from ..functions.text import dollar_text, dollar_text_auto, percent_text, route_text
from ..operators.filters import FilterSpec, is_chosen

NO_DATA = "No data"
ON_TIME_SHARE = 0.942  # fixed value of the on-time key figure


def _shown(text: Column) -> Column:
    return F.coalesce(text, F.lit(NO_DATA))


def _total_cost() -> Column:
    return lenient_sum("total_shipping_cost").alias("total_cost")


def _cost_per_kg() -> Column:
    cost, weight = lenient_sum("total_shipping_cost"), lenient_sum("total_weight")
    return ratio(cost, weight).alias("avg_cost_kg")


def _utilisation() -> Column:
    return (F.avg("capacity_utilization") * 100).alias("warehouse_util")


def _on_time(n: Column | None = None) -> Column:
    n = F.count(F.lit(1)) if n is None else n
    return (ratio(F.bround(n * F.lit(ON_TIME_SHARE), 0), n) * 100).alias("otd_rate")


def _storage_cost() -> Column:
    return F.nullif(lenient_sum("storage_cost"), F.lit(0.0)).alias("total_storage_cost")


def _unit_cost() -> Column:
    return F.nullif(F.avg("cost_per_unit"), F.lit(0.0)).alias("avg_cost_unit")


def _ground_share() -> Column:
    ground = F.col("mode_dsc") == "GROUND"
    cost = F.when(F.count_if(ground) > 0, lenient_sum(F.when(ground, F.col("total_shipping_cost"))))
    return percent(cost, lenient_sum("total_shipping_cost")).alias("ground_pct")


TEXTS = {
    "total_cost": dollar_text,
    "avg_cost_kg": dollar_text,
    "warehouse_util": percent_text,
    "otd_rate": percent_text,
    "total_storage_cost": dollar_text_auto,
    "avg_cost_unit": dollar_text_auto,
    "ground_pct": percent_text,
}


def _with_texts(df: DataFrame) -> DataFrame:
    """Add the display text beside each number."""
    return df.withColumns({f"{c}_text": _shown(TEXTS[c](c)) for c in df.columns if c in TEXTS})


def total_shipping_cost(shipping: DataFrame) -> DataFrame:
    return _with_texts(shipping.agg(_total_cost()))


def cost_per_kg(shipping: DataFrame) -> DataFrame:
    return _with_texts(shipping.agg(_cost_per_kg()))


def warehouse_utilisation(capacity: DataFrame) -> DataFrame:
    """Mean utilisation in percent."""
    return _with_texts(capacity.agg(_utilisation()))


def on_time_share(orders: DataFrame) -> DataFrame:
    """The on-time key figure: a fixed share of the orders, rounded to whole orders, in percent."""
    return _with_texts(orders.agg(_on_time()))


def measured_on_time_share(orders: DataFrame) -> DataFrame:
    """Our own figure from the data: orders that shipped without a late day, in percent."""
    on_time = F.count_if(F.col("ship_late_day_count") == 0)
    return orders.agg(percent(on_time, F.count("ship_late_day_count")).alias("on_time_rate"))


def total_storage_cost(costs: DataFrame) -> DataFrame:
    return _with_texts(costs.agg(_storage_cost()))


def mean_cost_per_unit(costs: DataFrame) -> DataFrame:
    return _with_texts(costs.agg(_unit_cost()))


def ground_share(shipping: DataFrame) -> DataFrame:
    """Ground transport's share of the cost in percent; none without any ground row."""
    return _with_texts(shipping.agg(_ground_share()))


def costliest_route(shipping: DataFrame) -> DataFrame:
    """The route with the highest cost; equal costs go to the first route in name order."""
    by_route = shipping.groupBy("origin_port", "destination_port").agg(
        lenient_sum("total_shipping_cost").alias("total_cost")
    )
    top = by_route.orderBy(
        F.desc("total_cost"), F.asc_nulls_last("origin_port"), F.asc_nulls_last("destination_port")
    ).limit(1)
    return top.where(F.col("total_cost") != 0).select(
        route_text("origin_port", "destination_port").alias("top_route"), "total_cost"
    )


def script_figures(shipping: DataFrame, costs: DataFrame) -> DataFrame:
    """Transport total and mean unit cost, both null when an input is; air to ground cost is ours."""

    def mode_cost(mode: str) -> Column:
        return F.sum(F.when(F.col("mode_dsc") == mode, F.col("total_shipping_cost")))

    unit = costs.agg(strict_mean("cost_per_unit")).scalar()
    return shipping.agg(
        strict_sum("total_shipping_cost").alias("total_transport_cost"),
        ratio(mode_cost("AIR"), mode_cost("GROUND")).alias("air_ground_ratio"),
    ).select(
        "total_transport_cost",
        unit.alias("avg_cost_per_unit"),
        "air_ground_ratio",
    )


def _beside(base: DataFrame, other: DataFrame) -> DataFrame:
    """Two one-row frames as one row; the second is a scalar subquery."""
    row = other.agg(F.first(F.struct(*other.columns)).alias("row")).scalar()
    wide = base.withColumn("_row", row)
    return wide.select(*base.columns, *[F.col(f"_row.{c}").alias(c) for c in other.columns])


def overview_kpis(shipping: DataFrame, capacity: DataFrame, orders: DataFrame) -> DataFrame:
    df = shipping.agg(_total_cost(), _cost_per_kg())
    df = _beside(df, capacity.agg(_utilisation()))
    return _with_texts(_beside(df, orders.agg(_on_time())))


def overview_kpis_of_orders(
    shipping: DataFrame, orders: DataFrame, wh_capacities: DataFrame, spec: FilterSpec
) -> DataFrame:
    """The same figures under a filter, from one tally of the orders by plant, carrier and service level.

    Orders, capacity use and the plants that a carrier serves all come from the tally, so the orders are read once for
    them and once for their rates. `shipping` is filtered already.
    """
    tally = orders.groupBy("plant_code", "carrier", "service_level").agg(F.count(F.lit(1)).alias("n"))
    chosen = {"plant_code": spec.warehouse, "carrier": spec.carrier, "service_level": spec.service_level}
    chosen = {c: F.col(c) == v for c, v in chosen.items() if is_chosen(v)}
    matching = reduce(lambda a, b: a & b, chosen.values(), F.lit(True))
    plants = tally.groupBy("plant_code").agg(
        F.sum("n").alias("orders"),
        F.sum(F.when(matching, F.col("n"))).alias("matching"),
        F.coalesce(F.bool_or(chosen.get("carrier", F.lit(True))), F.lit(False)).alias("served"),
    )
    sizes = wh_capacities.groupBy("plant_id").agg(F.collect_list("daily_capacity").alias("sizes"))
    plants = plants.join(sizes, plants["plant_code"].eqNullSafe(sizes["plant_id"]), "left")
    shown = F.col("served") & chosen.get("plant_code", F.lit(True))
    used = F.filter(F.transform("sizes", lambda size: ratio(F.col("orders"), size)), lambda u: u.isNotNull())
    used = F.when(shown, used)
    total = F.sum(F.aggregate(used, F.lit(0.0), lambda a, u: a + u))
    n = F.coalesce(F.sum("matching"), F.lit(0))
    figures = plants.agg(
        (ratio(total, F.sum(F.size(used))) * 100).alias("warehouse_util"), _on_time(n)
    )
    return _with_texts(_beside(shipping.agg(_total_cost(), _cost_per_kg()), figures))


def cost_kpis(shipping: DataFrame, costs: DataFrame) -> DataFrame:
    """The cost figures and the costliest route; the mart is summed by route once for both."""
    cost, ground = F.col("total_shipping_cost"), F.col("mode_dsc") == "GROUND"
    by_route = shipping.groupBy("origin_port", "destination_port").agg(
        lenient_sum(cost).alias("cost"),
        F.count_if(ground).alias("ground_rows"),
        lenient_sum(F.when(ground, cost)).alias("ground_cost"),
    )
    ends = [e for c in ("origin_port", "destination_port") for e in (F.isnull(c).alias(f"no_{c}"), F.col(c))]
    first = F.min(F.struct((-F.col("cost")).alias("cost"), *ends))
    ground_cost = F.when(F.sum("ground_rows") > 0, F.sum("ground_cost"))
    figures = by_route.agg(percent(ground_cost, lenient_sum("cost")).alias("ground_pct"), first.alias("first"))
    route = F.when(F.col("first.cost") != 0, route_text("first.origin_port", "first.destination_port"))
    figures = figures.select("ground_pct", route.alias("top_route"))
    df = _beside(costs.agg(_storage_cost(), _unit_cost()), figures)
    return _with_texts(df).withColumn("top_route", _shown(F.col("top_route")))
