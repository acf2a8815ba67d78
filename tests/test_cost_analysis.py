"""Worked examples of the cost analysis: filters, key figures, breakdown, quadrants, scores."""

import re
import warnings

import pytest
from pyspark.sql import functions as F

from lanecost.operators.filters import FilterSpec, filter_plants, filter_shipping
from lanecost.plans import kpis, quality, warehouse


def one(df):
    return df.first().asDict()


def plant(code):
    return FilterSpec(warehouse=code, map_keys=False)


def test_total_storage_cost(calculation):
    assert one(kpis.total_storage_cost(calculation.costs)) == {
        "total_storage_cost": 12000.0,
        "total_storage_cost_text": "$12,000",
    }
    one_plant = filter_plants(calculation.costs, plant("PLANT01"))
    assert one(kpis.total_storage_cost(one_plant))["total_storage_cost"] == 5000.0


def test_mean_cost_per_unit(calculation):
    assert one(kpis.mean_cost_per_unit(calculation.costs))["avg_cost_unit"] == 60.0
    one_plant = filter_plants(calculation.costs, plant("PLANT01"))
    assert one(kpis.mean_cost_per_unit(one_plant))["avg_cost_unit"] == 50.0


def test_ground_share(calculation):
    assert one(kpis.ground_share(calculation.shipping))["ground_pct_text"] == "33.3%"
    one_plant = filter_shipping(calculation.shipping, plant("PLANT01"))
    assert one(kpis.ground_share(one_plant))["ground_pct_text"] == "66.7%"


def test_costliest_route(calculation):
    top = one(kpis.costliest_route(calculation.shipping))
    assert top == {"top_route": "PLANT02 → DEST01", "total_cost": 3000.0}


def test_costliest_route_takes_the_first_name_on_equal_cost(spark, calculation):
    same = calculation.shipping.withColumn("total_shipping_cost", F.lit(1.0))
    assert one(kpis.costliest_route(same))["top_route"] == "PLANT01 → DEST01"


def test_scores(calculation):
    rows = {r["plant_code"]: r for r in warehouse.efficiency_matrix_export(calculation.costs).collect()}
    for score in ("storage_efficiency", "unit_cost_efficiency", "kg_cost_efficiency"):
        assert rows["PLANT01"][score] == 1.0
        assert rows["PLANT02"][score] == 0.0
    assert rows["PLANT01"]["volume_efficiency"] == rows["PLANT02"]["volume_efficiency"] == 0.5


def test_scores_of_a_single_plant_are_one_half(calculation):
    one_plant = filter_plants(calculation.costs, plant("PLANT01"))
    row = one(warehouse.efficiency_matrix_export(one_plant))
    assert row.pop("plant_code") == "PLANT01"
    assert set(row.values()) == {0.5}


def test_scores_in_long_form(calculation):
    rows = warehouse.efficiency_matrix_chart(calculation.costs).collect()
    assert {r["metric"] for r in rows} == {"Storage", "Unit Cost", "Kg Cost", "Volume"}
    classes = {(r["plant_code"], r["metric"]): r["performance"] for r in rows}
    assert classes["PLANT01", "Storage"] == "Excellent"
    assert classes["PLANT02", "Storage"] == "Needs Improvement"
    assert classes["PLANT01", "Volume"] == "Good"


def test_missing_cost_spoils_its_metric_in_the_chart_but_not_in_the_export(edge):
    chart = {(r["plant_code"], r["metric"]): r for r in warehouse.efficiency_matrix_chart(edge.costs).collect()}
    assert chart["PLANT01", "Storage"]["score"] is None
    assert chart["PLANT01", "Storage"]["performance"] == "Needs Improvement"
    wide = {r["plant_code"]: r for r in warehouse.efficiency_matrix_export(edge.costs).collect()}
    assert wide["PLANT01"]["storage_efficiency"] == 0.0
    assert wide["PLANT02"]["storage_efficiency"] is None
    assert wide["PLANT04"]["storage_efficiency"] == 1.0


def test_breakdown_export(calculation):
    df = warehouse.cost_breakdown_export(calculation.shipping, calculation.costs, map_keys=False)
    rows = {r["origin_port"]: r for r in df.collect()}
    first, second = rows["PLANT01"], rows["PLANT02"]
    assert (first["transport_cost"], first["storage_cost"], first["total_cost"]) == (3000, 5000, 8000)
    assert (first["pct_transport"], first["pct_storage"]) == (37.5, 62.5)
    assert (second["transport_cost"], second["storage_cost"], second["total_cost"]) == (3000, 7000, 10000)
    assert (round(second["pct_transport"], 9), round(second["pct_storage"], 9)) == (30, 70)


def test_breakdown_export_of_missing_and_negative_costs(edge):
    df = warehouse.cost_breakdown_export(edge.shipping, edge.costs, map_keys=False)
    rows = {r["origin_port"]: r for r in df.collect()}
    assert rows["PLANT02"]["transport_cost"] == 0.0
    assert rows["PLANT02"]["total_cost"] is None and rows["PLANT02"]["pct_storage"] is None
    assert rows["PLANT04"]["total_cost"] == -1100.0 and rows["PLANT04"]["pct_transport"] == 0.0


def test_breakdown_chart(calculation):
    df = warehouse.cost_breakdown_chart(calculation.shipping, calculation.costs)
    rows = {(r["plant_code"], r["cost_type"]): r for r in df.collect()}
    assert rows["PLANT01", "Transport Cost"]["amount"] == 3000
    assert rows["PLANT02", "Storage Cost"]["amount"] == 7000
    assert round(sum(r["pct_of_total"] for r in rows.values()), 9) == 100


def test_breakdown_chart_loses_all_shares_with_one_missing_cost(edge):
    rows = warehouse.cost_breakdown_chart(edge.shipping, edge.costs).collect()
    assert len(rows) == 8 and all(r["pct_of_total"] is None for r in rows)


def test_breakdown_counts_transport_once_per_cost_row(spark, calculation):
    costs = calculation.costs.withColumns({"year": F.lit(2013), "month": F.lit(5)})
    later = costs.withColumns({"month": F.lit(6), "storage_cost": F.lit(1.0)})
    df = warehouse.cost_breakdown_export(calculation.shipping, costs.union(later), map_keys=False)
    row = {r["origin_port"]: r for r in df.collect()}["PLANT01"]
    assert (row["transport_cost"], row["storage_cost"]) == (6000, 5000)


def test_quadrants(calculation):
    df = warehouse.unit_cost_quadrants(calculation.costs)
    assert {r["plant_code"]: r["quadrant"] for r in df.collect()} == {
        "PLANT01": "Optimal",
        "PLANT02": "High Cost",
    }


def test_quadrants_against_all_plants_or_against_the_shown_ones(calculation):
    shown = filter_plants(calculation.costs, plant("PLANT01"))
    assert one(warehouse.unit_cost_quadrants(shown, base=calculation.costs))["quadrant"] == "Optimal"
    assert one(warehouse.unit_cost_quadrants(shown))["quadrant"] == "High Cost"


def test_quadrants_with_a_missing_cost(edge):
    quadrants = {r["quadrant"] for r in warehouse.unit_cost_quadrants(edge.costs).collect()}
    assert quadrants == {"High KG Cost"}


@pytest.mark.parametrize(
    "warehouse_code, carrier, shipping_rows, cost_rows",
    [("PLANT01", "All", 2, 1), ("All", "CARRIER1", 2, 2), ("PLANT01", "CARRIER1", 1, 1), (None, None, 3, 2)],
)
def test_filters(filtering, warehouse_code, carrier, shipping_rows, cost_rows):
    spec = FilterSpec(warehouse_code, carrier, map_keys=False)
    assert filter_shipping(filtering.shipping, spec).count() == shipping_rows
    assert filter_plants(filtering.costs, spec, filtering.orders).count() == cost_rows
    assert filter_plants(filtering.capacity, spec, filtering.orders).count() == cost_rows


def test_plant_filter_maps_to_the_port(spark):
    ports = spark.createDataFrame([("PORT16", "C"), ("PORT09", "C")], "origin_port string, carrier string")
    assert filter_shipping(ports, FilterSpec("PLANT16")).count() == 1
    assert filter_shipping(ports, FilterSpec("PLANT16", map_keys=False)).count() == 0


def test_missing_and_zero_costs(edge):
    none_left = filter_plants(edge.costs, plant("PLANT02"))
    assert none_left.agg(F.coalesce(F.sum("storage_cost"), F.lit(0.0)).alias("v")).first()["v"] == 0
    assert one(kpis.total_storage_cost(none_left))["total_storage_cost_text"] == "No data"
    no_unit_cost = filter_plants(edge.costs, plant("PLANT03"))
    assert one(kpis.mean_cost_per_unit(no_unit_cost)) == {
        "avg_cost_unit": None,
        "avg_cost_unit_text": "No data",
    }
    assert one(kpis.ground_share(filter_shipping(edge.shipping, plant("PLANT03"))))["ground_pct"] is None


def test_unknown_choices_leave_nothing(edge):
    assert filter_plants(edge.costs, plant("PLANT99")).count() == 0
    assert filter_shipping(edge.shipping, FilterSpec(carrier="CARRIER99")).count() == 0


def test_key_figures_without_rows(edge):
    shipping = filter_shipping(edge.shipping, plant("PLANT99"))
    costs = filter_plants(edge.costs, plant("PLANT99"))
    row = one(kpis.cost_kpis(shipping, costs))
    texts = ("total_storage_cost_text", "avg_cost_unit_text", "ground_pct_text", "top_route")
    assert {row[t] for t in texts} == {"No data"}
    assert one(kpis.total_shipping_cost(shipping)) == {"total_cost": 0.0, "total_cost_text": "$0.00"}
    assert one(kpis.cost_per_kg(shipping))["avg_cost_kg_text"] == "No data"


def test_on_time_figure(spark):
    assert one(kpis.on_time_share(spark.range(10)))["otd_rate_text"] == "90%"
    assert one(kpis.on_time_share(spark.range(1000)))["otd_rate_text"] == "94.2%"
    assert one(kpis.on_time_share(spark.range(0)))["otd_rate_text"] == "No data"


def test_plot_data_checks(edge):
    columns = ["storage_cost", "cost_per_unit"]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert quality.plot_data_ok(edge.costs, columns, "Cost Analysis")
        assert not quality.plot_data_ok(edge.shipping, columns, "Test Plot")
    with pytest.warns(UserWarning, match="Negative values found"):
        quality.plot_data_ok(edge.costs.where("plant_code = 'PLANT04'"), columns, "Cost Analysis")
    with pytest.warns(UserWarning, match="Found NA values"):
        quality.plot_data_ok(edge.costs.where("plant_code = 'PLANT02'"), columns, "Test Plot")


def test_standardised_costs(calculation):
    rows = warehouse.standardised_costs(calculation.costs).collect()
    scores = {(r["plant_code"], r["metric"]): round(r["score"], 6) for r in rows}
    assert scores["PLANT01", "storage_efficiency"] == -0.707107
    assert scores["PLANT02", "kg_efficiency"] == 0.707107


def test_export_columns(calculation):
    breakdown = warehouse.cost_breakdown_export(calculation.shipping, calculation.costs)
    assert breakdown.columns == [
        "origin_port",
        "transport_cost",
        "storage_cost",
        "total_cost",
        "pct_transport",
        "pct_storage",
    ]
    quadrants = warehouse.unit_cost_quadrants(calculation.costs)
    assert {"plant_code", "cost_per_unit", "cost_per_kg", "total_units", "total_orders", "quadrant"} <= set(
        quadrants.columns
    )
    scores = warehouse.efficiency_matrix_export(calculation.costs)
    assert all(re.fullmatch("plant_code|.*_efficiency", c) for c in scores.columns)
