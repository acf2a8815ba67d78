"""The registered queries: every operator run over the whole tables of one data folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import tpch
from .operators import filters, rating
from .operators.filters import FilterSpec
from .plans import exports, kpis, labels, marts, quality, service, shipping, states, warehouse
from .sources import export

# o_orderkey is the primary key of orders and order_id is o_orderkey + 1, so ids are unique here;
# the query order_id_duplicates counts the exceptions. Queries named *_repeated_ids make no such claim.
UNIQUE_IDS = True

RATING = ["order_id", "carrier", "origin_port", "destination_port", "service_level", "weight"]
STORAGE = ["plant_code", "weight", "unit_quantity"]

PLANT = FilterSpec(warehouse="PLANT03")
CARRIER = FilterSpec(carrier="V44_2")
PLANT_AND_CARRIER = FilterSpec(warehouse="PLANT03", carrier="V44_1")
ALL_THREE = FilterSpec(warehouse="PLANT03", carrier="V44_1", service_level="DTD")
UNRATED_CARRIER = FilterSpec(carrier="V44_3")

Query = Callable[[SparkSession, str], DataFrame]


# Engines add doubles in different orders, so results are rounded: sums of amounts with at most three
# decimals to four, everything else (unit costs, shares, scores) to eight. A quotient can lie exactly
# halfway between two results; the nudge sends it up whatever the last bit says.
NUDGE = 1e-10
AMOUNTS = {
    "amount",
    "sort_value",
    "storage_cost",
    "total_cost",
    "total_shipping_cost",
    "total_storage_cost",
    "total_transport_cost",
    "total_units",
    "total_volume",
    "total_weight",
    "transport_cost",
}


def decimals(column: str) -> int:
    return 4 if column in AMOUNTS else 8


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        [
            F.round(F.col(f.name) + (0 if f.name in AMOUNTS else NUDGE), decimals(f.name)).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


# Inputs


def _orders(spark, d, columns=None):
    return tpch.order_list(spark, d, columns)


def _repeated(spark, d):
    """The order list under an id that many orders share."""
    orders = _orders(spark, d, [*RATING, "order_date", "product_id"])
    return orders.withColumn("order_id", F.col("product_id")).drop("product_id")


def _shipping(spark, d, check=True, **options):
    orders = _orders(spark, d, RATING)
    options.setdefault("unique_ids", UNIQUE_IDS)
    return marts.shipping_costs(orders, tpch.freight_rates(spark, d), check=check, **options)


def _costs(spark, d):
    return marts.warehouse_costs(_orders(spark, d, STORAGE), tpch.wh_costs(spark, d))


def _missing_costs(spark, d):
    """The plants' costs with a cost table that lacks a plant."""
    known = tpch.wh_costs(spark, d).where("wh <> 'PLANT25'")
    return marts.warehouse_costs(_orders(spark, d, STORAGE), known)


def _two_periods(spark, d):
    """The cost table with a second, dearer period."""
    first = tpch.wh_costs(spark, d)
    second = first.withColumns({"cost_unit": F.col("cost_unit") * 1.5, "year": F.lit(2014), "month": F.lit(1)})
    return first.unionByName(second)


def _seeded_orders(spark, d):
    """The order list with bad and missing values by a fixed rule on its ids."""

    def bad(column, every, value):
        return F.when(F.col("order_id") % every == 0, F.lit(value)).otherwise(F.col(column))

    return _orders(spark, d).withColumns(
        {
            "order_id": F.when(F.col("order_id") % 61 == 0, -F.col("order_id")).otherwise(F.col("order_id")),
            "weight": bad("weight", 97, 0.0),
            "unit_quantity": bad("unit_quantity", 89, -1.0),
            "ship_ahead_day_count": bad("ship_ahead_day_count", 83, -2),
            "ship_late_day_count": bad("ship_late_day_count", 79, -1),
            "service_level": bad("service_level", 73, None),
            "origin_port": bad("origin_port", 71, None),
            "order_date": bad("order_date", 67, None),
        }
    )


def _seeded_rates(spark, d):
    """The rate card with bad values by a fixed rule."""
    low, port = F.col("minm_wgh_qty"), F.col("orig_port_cd")
    return tpch.freight_rates(spark, d).withColumns(
        {
            "rate": F.when(port == "PORT02", -F.col("rate")).otherwise(F.col("rate")),
            "minimum_cost": F.when(port == "PORT03", -1.0).otherwise(F.col("minimum_cost")),
            "max_wgh_qty": F.when(port == "PORT04", low - 1).otherwise(F.col("max_wgh_qty")),
            "mode_dsc": F.when(port == "PORT05", F.lit("RAIL")).otherwise(F.col("mode_dsc")),
            "svc_cd": F.when(port == "PORT06", F.lit(None)).otherwise(F.col("svc_cd")),
        }
    )


def _capacity(spark, d):
    return marts.warehouse_capacity(_orders(spark, d, ["plant_code"]), tpch.wh_capacities(spark, d))


def _mix(spark, d):
    orders = _orders(spark, d, RATING)
    return shipping.weight_band_service_mix(orders, tpch.freight_rates(spark, d))


def _service_lanes(spark, d):
    orders, rates = _orders(spark, d, RATING), tpch.freight_rates(spark, d)
    return service.service_lanes(service.cost_by_first_rate(orders, rates, unique_ids=UNIQUE_IDS))


def _repeated_service_lanes(spark, d):
    rates = tpch.freight_rates(spark, d)
    return service.service_lanes(service.cost_by_first_rate(_repeated(spark, d), rates))


def _shipping_days(spark, d):
    """The shipping state by day."""
    orders = _orders(spark, d, [*RATING, "order_date"])
    return states.shipping_state(orders, tpch.freight_rates(spark, d), unique_ids=UNIQUE_IDS)


def _plant_days(spark, d):
    return states.plant_state(_orders(spark, d, [*STORAGE, "order_date"]))


def _halves(state):
    """A state as two of its own, by days, merged again."""
    early = F.day(states.DAY) < 16
    return states.merge(state.where(early), state.where(~early))


def _day_sums(spark, d):
    sums = [F.col(f"{m}_sum").cast("double").alias(f"{m}_sum") for m in states.SHIPPING_MEASURES]
    known = [f"{m}_known" for m in states.SHIPPING_MEASURES]
    return _shipping_days(spark, d).select(*states.SHIPPING_KEY, states.DAY, "n_rows", *known, *sums)


def _on_shipping(plan) -> Query:
    return lambda spark, d: plan(_shipping(spark, d))


def _on_costs(plan) -> Query:
    return lambda spark, d: plan(_costs(spark, d))


def _on_lanes(plan) -> Query:
    return lambda spark, d: plan(_service_lanes(spark, d))


def _rated(spark, d, orders=None, **options):
    orders = _orders(spark, d, RATING) if orders is None else orders
    rated = rating.rate_orders(orders, tpch.freight_rates(spark, d), **options)
    return rated.select("order_id", "mode_dsc", "weight_band", "rate", "gap", "shipping_cost")


def _in_band(spark, d):
    rated = rating.in_band(_orders(spark, d, RATING), tpch.freight_rates(spark, d))
    return rated.select("order_id", "mode_dsc", "weight_band", "rate", "gap")


def _service_costing(spark, d):
    rows = service.service_costing(_orders(spark, d, RATING), tpch.freight_rates(spark, d))
    return rows.select(
        "order_id", "service_level", "mode_dsc", "minm_wgh_qty", "max_wgh_qty", "rate", "shipping_cost"
    )


def _service_costing_by_level(spark, d):
    """Service costing summed: orders times rates of their lane, rows without a cost, and the cost."""
    return service.service_costing_by_level(_orders(spark, d, RATING), tpch.freight_rates(spark, d))


def _unrated(spark, d):
    rates = tpch.freight_rates(spark, d)
    return rating.unrated_orders(_orders(spark, d, RATING), rates).select("order_id", "carrier", "weight")


def _filtered_shipping(spec) -> Query:
    return lambda spark, d: filters.filter_shipping(_shipping(spark, d), spec)


def _filtered_costs(spec, by_carrier) -> Query:
    def query(spark, d):
        orders = _orders(spark, d, ["plant_code", "carrier"]) if by_carrier else None
        return filters.filter_plants(_costs(spark, d), spec, orders)

    return query


def _filtered_capacity(spec) -> Query:
    def query(spark, d):
        orders = _orders(spark, d, ["plant_code", "carrier"])
        return filters.filter_plants(_capacity(spark, d), spec, orders)

    return query


def _filtered_orders(spec) -> Query:
    return lambda spark, d: filters.filter_orders(_orders(spark, d), spec)


def _filter_audit(spark, d):
    orders = _orders(spark, d, ["plant_code", "carrier"])
    kept = (F.col("plant_code") == "PLANT03") & (F.col("carrier") == "V44_1")
    return filters.filter_audit(orders, kept, PLANT_AND_CARRIER)


def _filter_choices(spark, d):
    return filters.filter_choices(_orders(spark, d, ["plant_code", "carrier", "service_level"]))


def _breakdown(plan, **options) -> Query:
    return lambda spark, d: plan(_shipping(spark, d), _costs(spark, d), **options)


def _quadrants_chart(spark, d):
    shown = filters.filter_plants(_costs(spark, d), PLANT)
    return warehouse.unit_cost_quadrants(shown, base=_costs(spark, d))


def _overview_kpis(spec) -> Query:
    def query(spark, d):
        orders = _orders(spark, d, ["plant_code", "carrier", "service_level"])
        shown = filters.filter_shipping(_shipping(spark, d), spec)
        return kpis.overview_kpis_of_orders(shown, orders, tpch.wh_capacities(spark, d), spec)

    return query


def _cost_kpis(spec) -> Query:
    def query(spark, d):
        return kpis.cost_kpis(
            filters.filter_shipping(_shipping(spark, d), spec),
            filters.filter_plants(_costs(spark, d), spec),
        )

    return query


def _relationships(spark, d):
    return quality.check_relationships(
        _orders(spark, d, RATING + ["plant_code"]),
        tpch.freight_rates(spark, d),
        tpch.wh_costs(spark, d),
        tpch.wh_capacities(spark, d),
    )


def _check_mart(plan, *args) -> Query:
    return lambda spark, d: plan(_shipping(spark, d, check=False), *args)


def _route_export(spark, d):
    stamped = export.stamp_export(
        shipping.routes(filters.filter_shipping(_shipping(spark, d), CARRIER)), CARRIER.text()
    )
    return stamped.drop("timestamp")


EXPORTED_AT = datetime(2024, 1, 5, 7, 8, 9)


def _exports(spec) -> Query:
    def query(spark, d):
        built = {"shipping_costs": _shipping(spark, d), "warehouse_costs": _costs(spark, d)}
        orders = _orders(spark, d, ["plant_code", "carrier", "service_level"])
        return exports.export_sizes(exports.exports_of(built, orders, spec), EXPORTED_AT)

    return query


def _overview_storage(spark, d):
    """The storage export under a plant and a carrier, as `exports_of` has it."""
    orders = _orders(spark, d, ["plant_code", "carrier", "service_level"])
    built = {"shipping_costs": _shipping(spark, d), "warehouse_costs": _costs(spark, d)}
    return next(e.frame for e in exports.exports_of(built, orders, CARRIER) if e.name == "storage_costs")


def _clipped(spark, d):
    """Plant costs, those of every third plant negative, clipped for display."""
    costs = _costs(spark, d)
    third = F.substring("plant_code", 6, 2).cast("int") % 3 == 0
    signed = {c: F.when(third, -F.col(c)).otherwise(F.col(c)) for c in ("storage_cost", "cost_unit", "cost_per_unit", "cost_per_kg")}
    return export.clip_negative_costs(costs.withColumns(signed)).select("plant_code", *signed)


def _required(spark, d):
    """Required columns of the rate choice and the service levels on tables that lack some of them."""
    orders = _orders(spark, d, [*RATING, "order_date"]).drop("weight")
    rates = tpch.freight_rates(spark, d).drop("rate", "svc_cd")
    costed = service.cost_by_first_rate(_orders(spark, d, RATING), tpch.freight_rates(spark, d), unique_ids=UNIQUE_IDS)
    found = quality.check_required_columns(orders, marts.ORDER_COLUMNS, "shipping costs")
    found = found.unionByName(quality.check_required_columns(rates, marts.RATE_COLUMNS, "shipping costs"))
    costed = costed.drop("shipping_cost")
    return found.unionByName(quality.check_required_columns(costed, service.SERVICE_COLUMNS, "service levels"))


def _structure(spark, d):
    """The shipping mart's structure as it is, and with a column gone, a measure as text and no row."""
    mart = _shipping(spark, d, check=False)
    broken = mart.drop("carrier").withColumn("total_weight", F.col("total_weight").cast("string"))
    frames = {"whole": mart, "broken": broken, "empty": mart.where("n_orders < 0")}
    found = [quality.structure_checks(f, LANE_KEY).select(F.lit(n).alias("frame"), "*") for n, f in frames.items()]
    return reduce(DataFrame.unionAll, found)


LANE_KEY = ["origin_port", "destination_port", "carrier"]

QUERIES: dict[str, Query] = {
    # sources
    "order_list": _orders,
    "freight_rate_card": lambda spark, d: rating.clean_rates(tpch.freight_rates(spark, d)),
    "warehouse_cost_table": tpch.wh_costs,
    "warehouse_capacity_table": tpch.wh_capacities,
    # rating
    "rates_in_band": _in_band,
    "best_rates": lambda spark, d: _rated(spark, d, unique_ids=UNIQUE_IDS),
    "best_rates_first": lambda spark, d: _rated(spark, d, ties="first", unique_ids=UNIQUE_IDS),
    "best_rates_repeated_ids": lambda spark, d: _rated(spark, d, _repeated(spark, d)),
    "best_rates_first_repeated_ids": lambda spark, d: _rated(
        spark, d, _repeated(spark, d), ties="first"
    ),
    "unrated_orders": _unrated,
    "service_costing": _service_costing,
    # marts
    "shipping_costs": lambda spark, d: marts.sort_shipping(_shipping(spark, d)),
    "shipping_costs_first_rate": lambda spark, d: _shipping(spark, d, ties="first"),
    "shipping_costs_repeated_ids": lambda spark, d: marts.shipping_costs(
        _repeated(spark, d), tpch.freight_rates(spark, d)
    ),
    "warehouse_costs": _costs,
    "warehouse_costs_in_period": lambda spark, d: marts.warehouse_costs(
        _orders(spark, d, STORAGE), _two_periods(spark, d), period=(2014, 1)
    ),
    "warehouse_costs_per_order": _on_costs(marts.warehouse_costs_per_order),
    "warehouse_capacity": _capacity,
    "capacity_status": lambda spark, d: warehouse.capacity_status(_capacity(spark, d)),
    # marts from states by day
    "shipping_state_by_day": _day_sums,
    "shipping_costs_of_days": lambda spark, d: states.shipping_costs(_shipping_days(spark, d)),
    "shipping_costs_of_merged_days": lambda spark, d: states.shipping_costs(_halves(_shipping_days(spark, d))),
    "warehouse_costs_of_days": lambda spark, d: states.warehouse_costs(
        _plant_days(spark, d), tpch.wh_costs(spark, d)
    ),
    "warehouse_capacity_of_days": lambda spark, d: states.warehouse_capacity(
        _plant_days(spark, d), tpch.wh_capacities(spark, d)
    ),
    # filters
    "shipping_of_plant": _filtered_shipping(PLANT),
    "shipping_of_plant_and_carrier": _filtered_shipping(PLANT_AND_CARRIER),
    "shipping_of_raw_plant_code": _filtered_shipping(FilterSpec(warehouse="PLANT03", map_keys=False)),
    "storage_of_plant": _filtered_costs(PLANT, by_carrier=False),
    "storage_of_carrier": _filtered_costs(CARRIER, by_carrier=True),
    "orders_filtered": _filtered_orders(ALL_THREE),
    "capacity_of_carrier": _filtered_capacity(PLANT_AND_CARRIER),
    "filter_choices": _filter_choices,
    "filter_audit": _filter_audit,
    # shipping summaries
    "route_export": _route_export,
    "route_summary": _on_shipping(shipping.route_summary),
    "route_labels": _on_shipping(shipping.route_labels),
    "route_order": lambda spark, d: shipping.category_order(
        shipping.route_labels(_shipping(spark, d)), "route_label", "total_shipping_cost"
    ),
    "transport_export": _on_shipping(shipping.transport_modes),
    "transport_mode_summary": _on_shipping(shipping.transport_mode_summary),
    "shipping_shares": _on_shipping(shipping.shipping_shares),
    "weight_band_use": _on_shipping(shipping.weight_band_use),
    "weight_band_detail": _on_shipping(shipping.weight_band_detail),
    "weight_band_efficiency": _on_shipping(shipping.weight_band_efficiency),
    "row_efficiency": _on_shipping(shipping.row_efficiency),
    "weight_band_routes": _on_shipping(shipping.weight_band_routes),
    "weight_band_service_mix": _mix,
    "carrier_service_mix": lambda spark, d: shipping.carrier_service_mix(_mix(spark, d)),
    "carrier_costs": _on_shipping(shipping.carrier_costs),
    # service levels
    "service_distribution": lambda spark, d: service.service_distribution(
        _orders(spark, d, ["service_level"])
    ),
    "service_summary": _on_lanes(service.service_summary),
    "carrier_service": _on_lanes(service.carrier_service),
    "route_service": _on_lanes(service.route_service),
    "service_cost_efficiency": lambda spark, d: service.service_cost_efficiency(
        service.service_summary(_service_lanes(spark, d))
    ),
    "service_summary_repeated_ids": lambda spark, d: service.service_summary(
        _repeated_service_lanes(spark, d)
    ),
    "carrier_service_repeated_ids": lambda spark, d: service.carrier_service(
        _repeated_service_lanes(spark, d)
    ),
    "route_service_repeated_ids": lambda spark, d: service.route_service(_repeated_service_lanes(spark, d)),
    # texts beside the figures
    "storage_labels": lambda spark, d: labels.storage(warehouse.storage_ranking_of_all(_costs(spark, d))),
    "service_mix_labels": lambda spark, d: labels.order_shares(_mix(spark, d), "pct_orders", "total_orders"),
    "band_route_labels": lambda spark, d: labels.band_routes(
        shipping.weight_band_routes(_shipping(spark, d))
    ),
    "service_labels": lambda spark, d: labels.service_summary(
        service.service_summary(_service_lanes(spark, d))
    ),
    "carrier_service_labels": lambda spark, d: labels.order_shares(
        service.carrier_service(_service_lanes(spark, d)), "pct_carrier_orders", "orders"
    ),
    "route_service_labels": lambda spark, d: labels.route_service(
        service.route_service(_service_lanes(spark, d))
    ),
    "service_cost_labels": lambda spark, d: labels.service_costs(
        service.service_cost_efficiency(service.service_summary(_service_lanes(spark, d)))
    ),
    # warehouse summaries
    "storage_ranking": _on_costs(warehouse.storage_ranking),
    "storage_ranking_of_all": _on_costs(warehouse.storage_ranking_of_all),
    "storage_export": _on_costs(warehouse.storage_export),
    "cost_breakdown_chart": _breakdown(warehouse.cost_breakdown_chart),
    "cost_breakdown_chart_known": _breakdown(warehouse.cost_breakdown_chart),
    "cost_breakdown_chart_missing": lambda spark, d: warehouse.cost_breakdown_chart(
        _shipping(spark, d), _missing_costs(spark, d)
    ),
    "cost_breakdown_export": _breakdown(warehouse.cost_breakdown_export),
    "cost_breakdown_export_raw_keys": _breakdown(warehouse.cost_breakdown_export, map_keys=False),
    "unit_cost_quadrants_chart": _quadrants_chart,
    "unit_cost_quadrants_export": _on_costs(warehouse.unit_cost_quadrants),
    "unit_cost_quadrants_missing": lambda spark, d: warehouse.unit_cost_quadrants(_missing_costs(spark, d)),
    "efficiency_matrix_chart": _on_costs(warehouse.efficiency_matrix_chart),
    "efficiency_matrix_chart_missing": lambda spark, d: warehouse.efficiency_matrix_chart(
        _missing_costs(spark, d)
    ),
    "efficiency_matrix_export": _on_costs(warehouse.efficiency_matrix_export),
    "standardised_costs": _on_costs(warehouse.standardised_costs),
    # key figures
    "total_shipping_cost": _on_shipping(kpis.total_shipping_cost),
    "cost_per_kg": _on_shipping(kpis.cost_per_kg),
    "warehouse_utilisation": lambda spark, d: kpis.warehouse_utilisation(_capacity(spark, d)),
    "on_time_share": lambda spark, d: kpis.on_time_share(_orders(spark, d, ["order_id"])),
    "measured_on_time_share": lambda spark, d: kpis.measured_on_time_share(
        _orders(spark, d, ["ship_late_day_count"])
    ),
    "total_storage_cost": _on_costs(kpis.total_storage_cost),
    "mean_cost_per_unit": _on_costs(kpis.mean_cost_per_unit),
    "ground_share": _on_shipping(kpis.ground_share),
    "costliest_route": _on_shipping(kpis.costliest_route),
    "script_figures": lambda spark, d: kpis.script_figures(_shipping(spark, d), _costs(spark, d)),
    "overview_kpis": _overview_kpis(FilterSpec()),
    "overview_kpis_of_plant": _overview_kpis(PLANT_AND_CARRIER),
    "overview_kpis_without_rates": _overview_kpis(UNRATED_CARRIER),
    "cost_kpis": _cost_kpis(FilterSpec()),
    "cost_kpis_without_rates": _cost_kpis(UNRATED_CARRIER),
    # exports of a filter
    "filter_exports": _exports(FilterSpec()),
    "filter_exports_of_plant": _exports(PLANT_AND_CARRIER),
    "storage_export_of_carrier": _overview_storage,
    "clipped_costs": _clipped,
    # quality checks
    "check_required_columns_seeded": _required,
    "check_structure_seeded": _structure,
    "service_costing_by_level": _service_costing_by_level,
    "check_order_list": lambda spark, d: quality.check_order_list(_orders(spark, d)),
    "check_freight_rates": lambda spark, d: quality.check_freight_rates(tpch.freight_rates(spark, d)),
    "check_order_list_seeded": lambda spark, d: quality.check_order_list(_seeded_orders(spark, d)),
    "check_freight_rates_seeded": lambda spark, d: quality.check_freight_rates(_seeded_rates(spark, d)),
    "check_service_levels_seeded": lambda spark, d: quality.check_service_levels(_seeded_orders(spark, d)),
    "mart_checks": _check_mart(quality.check_mart),
    "check_shipping_metrics": _check_mart(quality.check_shipping_metrics),
    "check_duplicate_lanes": _check_mart(quality.check_duplicates, LANE_KEY),
    "check_weight_bands": _check_mart(quality.check_weight_bands),
    "check_service_levels": lambda spark, d: quality.check_service_levels(_orders(spark, d, RATING)),
    "check_plot_data": lambda spark, d: quality.check_plot_data(
        _costs(spark, d), ["storage_cost", "cost_per_unit", "cost_per_kg", "total_units"]
    ),
    "check_relationships": _relationships,
    "check_unrated_orders": lambda spark, d: quality.check_unrated_orders(
        _orders(spark, d, RATING), tpch.freight_rates(spark, d)
    ),
    "order_id_duplicates": lambda spark, d: quality.check_unique_order_ids(
        _orders(spark, d, ["order_id"])
    ),
    "warehouse_duplicates": lambda spark, d: quality.check_unique_warehouses(tpch.wh_costs(spark, d)),
}


def queries() -> dict[str, Query]:
    def whole(query: Query) -> Query:
        return lambda spark, d: rounded(query(spark, d))

    return {name: whole(query) for name, query in QUERIES.items()}
