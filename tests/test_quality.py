"""One seeded bad row per rule."""

import warnings
from datetime import date

import pytest
from pyspark.sql import functions as F

from lanecost.operators.bands import by_band_order, normalize_weight_bands
from lanecost.operators.filters import filter_choices, observed
from lanecost.plans import quality, service
from lanecost.sources import schemas

GOOD_ORDER = {
    "order_id": 1,
    "order_date": date(2013, 5, 26),
    "origin_port": "PORT09",
    "carrier": "V44_1",
    "tpt": 1,
    "service_level": "DTD",
    "ship_ahead_day_count": 0,
    "ship_late_day_count": 0,
    "customer": "V55",
    "product_id": 17,
    "plant_code": "PLANT16",
    "destination_port": "PORT09",
    "unit_quantity": 8.0,
    "weight": 14.3,
}


def bad(results):
    return {(r["check"], r["column"]): r["n_bad"] for r in results.collect() if r["n_bad"]}


def orders(spark, **changes):
    rows = [GOOD_ORDER, {**GOOD_ORDER, "order_id": 2, **changes}]
    return spark.createDataFrame([tuple(r.values()) for r in rows], schemas.ORDER_LIST)


@pytest.mark.parametrize(
    "column, value",
    [
        ("order_id", -1),
        ("order_id", 0),
        ("order_date", None),
        ("weight", 0.0),
        ("weight", None),
        ("unit_quantity", -1.0),
        ("ship_ahead_day_count", -1),
        ("ship_late_day_count", None),
        ("service_level", "INVALID"),
        ("service_level", None),
    ],
)
def test_order_rules(spark, column, value):
    results = quality.check_order_list(orders(spark, **{column: value}))
    assert bad(results) == {("order_list", column): 1}
    with pytest.raises(quality.DataQualityError, match=column):
        quality.enforce(results)


def test_good_orders_pass(spark):
    assert quality.enforce(quality.check_order_list(orders(spark))) == []


RATE = ("PORT09", "PORT09", "V44_1", "DTD", "AIR", 0.0, 99.99, 2.0, 10.0)


@pytest.mark.parametrize(
    "position, column, value",
    [
        (7, "rate", 0.0),
        (8, "minimum_cost", -1.0),
        (6, "max_wgh_qty", 0.0),
        (4, "mode_dsc", "SEA"),
        (3, "svc_cd", None),
    ],
)
def test_rate_rules(spark, position, column, value):
    row = list(RATE)
    row[position] = value
    df = spark.createDataFrame([RATE, tuple(row)], schemas.FREIGHT_RATES)
    assert bad(quality.check_freight_rates(df)) == {("freight_rates", column): 1}


MART = "total_shipping_cost double, total_weight double, avg_cost_per_kg double"


@pytest.mark.parametrize(
    "row, want",
    [
        ((10.0, -1.0, 5.0), {("zero or negative weight", "total_weight"): 1}),
        (
            (-10.0, 2.0, 5.0),
            {("negative shipping cost", "total_shipping_cost"): 1, ("outliers", "total_shipping_cost"): 1},
        ),
        ((10.0, 2.0, 2000.0), {("outliers", "avg_cost_per_kg"): 1}),
        ((2e6, 2.0, 5.0), {("outliers", "total_shipping_cost"): 1}),
        ((None, 2.0, 5.0), {("missing values", "total_shipping_cost"): 1}),
        (
            (1.0, 0.0, None),
            {
                ("zero or negative weight", "total_weight"): 1,
                ("infinite cost per kg", "avg_cost_per_kg"): 1,
                ("missing values", "avg_cost_per_kg"): 1,
            },
        ),
    ],
)
def test_shipping_metric_rules(spark, row, want):
    df = spark.createDataFrame([(10.0, 2.0, 5.0), row], MART)
    assert bad(quality.check_shipping_metrics(df)) == want


def test_outlier_range_is_reported(spark):
    df = spark.createDataFrame([(2e6, 2.0, 5.0), (3e6, 2.0, 5.0)], MART)
    found = quality.check_shipping_metrics(df).where("check = 'outliers' AND n_bad > 0").first()
    assert found["detail"] == "2,000,000.00 to 3,000,000.00"


def test_duplicates(spark):
    df = spark.createDataFrame([("A", "x"), ("A", "x"), ("A", "y"), ("B", "x")], "k string, weight_band string")
    row = quality.check_duplicates(df, ["k"]).first()
    assert (row["n_bad"], row["column"]) == (2, "k, weight_band")
    assert quality.check_duplicates(df.drop("weight_band"), ["k"]).first()["n_bad"] == 3


def test_structure(spark):
    with pytest.raises(quality.DataQualityError, match="Required columns are not there: z"):
        quality.check_data_quality(spark.range(1), ["id", "z"])
    with pytest.raises(quality.DataQualityError, match="There is no row"):
        quality.check_data_quality(spark.range(0), ["id"])
    text = spark.createDataFrame([("1",)], "total_weight string")
    with pytest.raises(quality.DataQualityError, match="total_weight must be numeric"):
        quality.check_data_quality(text, ["total_weight"])


def test_service_levels(spark):
    df = spark.createDataFrame(
        [("DTD", "A", "B"), ("XXX", "A", "B"), (None, "A", None)],
        "service_level string, origin_port string, destination_port string",
    )
    assert bad(quality.check_service_levels(df)) == {
        ("invalid service level", "service_level"): 2,
        ("missing port", "origin_port, destination_port"): 1,
    }


def test_weight_bands(spark):
    df = spark.createDataFrame(
        [("0 - 99.99 kg",), (" 0 - 5000 kg",), ("1 - 2 kg",), (None,)], "weight_band string"
    )
    results = quality.check_weight_bands(df)
    assert bad(results) == {
        ("invalid weight band", "weight_band"): 1,
        ("missing weight band", "weight_band"): 1,
    }
    with pytest.raises(quality.DataQualityError, match="no weight band column"):
        quality.check_weight_bands(spark.range(1))


def test_bands_sort_in_their_fixed_order(spark):
    rows = [(b + " kg",) for b in reversed(schemas.WEIGHT_BANDS)] + [(None,)]
    df = normalize_weight_bands(spark.createDataFrame(rows, "weight_band string"))
    got = [r["weight_band"] for r in df.orderBy(by_band_order()).collect()]
    assert got == [*schemas.WEIGHT_BANDS, None]


def test_relationships(spark):
    seeded = orders(spark, plant_code="PLANT99", carrier="V44_9")
    rates = spark.createDataFrame([RATE, RATE], schemas.FREIGHT_RATES)
    costs = spark.createDataFrame([("PLANT16", 1.0, 1, 1), ("PLANT77", 1.0, 1, 1)], schemas.WH_COSTS)
    sizes = spark.createDataFrame([("PLANT16", 1.0, "", "", "")], schemas.WH_CAPACITIES)
    found = {r["relationship"]: tuple(r)[1:] for r in quality.check_relationships(seeded, rates, costs, sizes).collect()}
    assert found == {
        "orders to capacities": (2, 1, False),
        "orders to freight rates": (2, 1, True),
        "costs to capacities": (2, 1, False),
    }


def test_unique_ids_and_warehouses(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "order_id long")
    assert quality.check_unique_order_ids(df).first()["n_bad"] == 2
    costs = spark.createDataFrame([("P", 1.0, 1, 1), ("P", 1.0, 1, 2)], schemas.WH_COSTS)
    assert quality.check_unique_warehouses(costs).first()["n_bad"] == 2


def test_warnings_do_not_raise(spark):
    df = spark.createDataFrame([(None,)], "x double")
    results = quality.run(df, [quality.Rule("missing", "x", F.col("x").isNull(), quality.WARN)])
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert quality.enforce(results) == ["missing: 1 bad rows in x"]
    assert [str(w.message) for w in seen if w.category is UserWarning] == ["missing: 1 bad rows in x"]


def test_service_shares_with_an_unknown_level(spark):
    rows = [
        (1, "DTD", 10.0, "A", "P1", "P2", 30.0),
        (2, "CRF", 10.0, "A", "P1", "P2", None),
        (3, "DTP", 20.0, "A", "P1", "P2", 70.0),
    ]
    schema = (
        "order_id long, service_level string, weight double, carrier string, origin_port string, "
        "destination_port string, shipping_cost double"
    )
    known = service.analyze_service_levels(spark.createDataFrame(rows + rows[:1], schema))
    summary = {r["service_level"]: r for r in known["service_summary"].collect()}
    assert summary["DTD"]["pct_cost"] == 30.0 and summary["CRF"]["pct_cost"] == 0.0
    assert summary["CRF"]["avg_cost_per_kg"] is None and summary["CRF"]["total_cost"] == 0.0
    assert summary["DTP"]["pct_weight"] == 50.0 and summary["DTD"]["orders"] == 1
    unknown = service.analyze_service_levels(
        spark.createDataFrame([*rows, (4, None, 1.0, "A", "P1", "P2", 5.0)], schema), one_row_per_order=True
    )
    summary = {r["service_level"]: r for r in unknown["service_summary"].collect()}
    assert summary["DTD"]["pct_cost"] is None and summary[None]["pct_cost"] is None
    with pytest.raises(Exception, match="shipping_cost"):
        service.analyze_service_levels(spark.createDataFrame(rows, schema).drop("shipping_cost"))


def test_filter_choices(spark):
    df = spark.createDataFrame(
        [("P2", "C", None), ("P1", "C", "DTD")], "plant_code string, carrier string, service_level string"
    )
    got = [(r["filter"], r["choice"]) for r in filter_choices(df).collect()]
    assert got == [
        ("carrier", "All"),
        ("carrier", "C"),
        ("service_level", "All"),
        ("service_level", "DTD"),
        ("warehouse", "All"),
        ("warehouse", "P1"),
        ("warehouse", "P2"),
    ]


def test_observed_rows(spark):
    df, seen = observed(spark.range(7), "kept")
    df.where("id > 3").collect()
    assert seen.get["rows"] == 7
