"""Loading, name cleaning, exports and the check log."""

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lanecost.operators.filters import FilterSpec
from lanecost.plans import exports, marts, quality
from lanecost.sources import bundle, check_log, export, schemas, tables

ROW = (1, date(2013, 5, 26), "PORT09", "V44_1", 1, "DTD", 3, 0, "V55", 17, "PLANT16", "PORT09", 808.0, 14.3)


@pytest.fixture(scope="module")
def frames(spark):
    return {
        "OrderList": spark.createDataFrame([ROW], schemas.ORDER_LIST),
        "FreightRates": spark.createDataFrame(
            [("PORT09", "PORT09", "V44_1", "DTD", "AIR", 0.0, 99.99, 2.0, 10.0)], schemas.FREIGHT_RATES
        ),
        "WhCosts": spark.createDataFrame([("PLANT16", 5.0, 2013, 5)], schemas.WH_COSTS),
        "WhCapacities": spark.createDataFrame(
            [("PLANT16", 100.0, "EAST", "MAIN", "ACTIVE")], schemas.WH_CAPACITIES
        ),
    }


def test_names():
    assert tables.snake_all(["OrderList", "Order ID", "order-id", "TPT", "Weight (kg)", "% late", "2nd"]) == [
        "order_list",
        "order_id",
        "order_id_2",
        "tpt",
        "weight_kg",
        "percent_late",
        "x2nd",
    ]


def test_tables_from_frames_are_cleaned_and_cast(spark, frames):
    raw = frames["OrderList"].withColumnRenamed("order_id", "Order ID").withColumn("Tpt", F.lit("2"))
    raw = raw.drop("tpt").withColumn("tpt", F.lit("2"))
    loaded = tables.from_frames({**frames, "OrderList": raw})
    assert loaded.order_list.schema == schemas.ORDER_LIST
    assert loaded.order_list.first()["tpt"] == 2


def test_missing_table_and_column(frames):
    with pytest.raises(tables.LoadError, match="Missing required tables: wh_costs, wh_capacities"):
        tables.from_frames({k: frames[k] for k in ("OrderList", "FreightRates")})
    with pytest.raises(tables.LoadError, match="freight_rates lacks columns: rate"):
        tables.from_frames({**frames, "FreightRates": frames["FreightRates"].drop("rate")})


def test_missing_file(spark, tmp_path):
    with pytest.raises(tables.LoadError, match="Data file not found for order_list"):
        tables.from_path(spark, str(tmp_path))


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc"])
def test_files_round_trip(spark, frames, tmp_path, fmt):
    for name, df in frames.items():
        df.write.format(fmt).option("header", True).save(f"{tmp_path}/{tables.snake(name)}")
    loaded = tables.from_path(spark, str(tmp_path), fmt)
    for table, schema in schemas.SCHEMAS.items():
        df = loaded.as_dict()[table]
        assert df.schema == schema and df.count() == 1
    assert tuple(loaded.order_list.first()) == ROW


def test_tables_of_the_catalog(spark, frames):
    spark.sql("CREATE DATABASE IF NOT EXISTS lanecost_test")
    for name, df in frames.items():
        df.write.mode("overwrite").saveAsTable(f"lanecost_test.{tables.snake(name)}")
    try:
        assert tables.from_catalog(spark, "lanecost_test").wh_costs.first()["cost_unit"] == 5.0
        spark.sql("DROP TABLE lanecost_test.wh_costs")
        with pytest.raises(tables.LoadError, match="Missing required tables: wh_costs"):
            tables.from_catalog(spark, "lanecost_test")
    finally:
        spark.sql("DROP DATABASE lanecost_test CASCADE")


def test_marts_are_written_and_read_back(spark, frames, tmp_path):
    built = marts.build_marts(tables.from_frames(frames), unique_ids=True)
    bundle.publish(built, str(tmp_path))
    again = bundle.read(spark, str(tmp_path), built)
    for name, df in built.items():
        assert again[name].collect() == df.collect()
    assert again["shipping_costs"].first()["total_shipping_cost"] == 28.6
    assert again["warehouse_costs"].first()["storage_cost"] == 4040.0


def test_a_failed_run_leaves_the_bundle_before_it(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(tables.LoadError, match="no bundle"):
        bundle.current(spark, path)
    one, two = (spark.createDataFrame([(k, float(k))], "k int, v double") for k in (1, 2))
    first = bundle.publish({"a": one, "b": one}, path)
    broken = two.withColumn("v", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        bundle.publish({"a": two, "b": broken}, path)
    assert bundle.current(spark, path) == first
    assert {n: df.first()["k"] for n, df in bundle.read(spark, path).items()} == {"a": 1, "b": 1}
    with pytest.raises(tables.LoadError, match="lacks marts: c"):
        bundle.read(spark, path, ["c"])


def test_a_bundle_is_replaced_while_it_is_read(spark, tmp_path):
    path = str(tmp_path)
    bundle.publish({"a": spark.range(5).toDF("k")}, path)
    reading = bundle.read(spark, path)["a"]
    # the next bundle is made from the current one, and readers of the current one go on
    for n in (2, 3):
        published = bundle.publish({"a": bundle.read(spark, path)["a"].withColumn("k", F.col("k") + 10)}, path)
        assert published.number == n and published.marts["a"].n_rows == 5
    assert sorted(r["k"] for r in reading.collect()) == [0, 1, 2, 3, 4]
    assert sorted(r["k"] for r in bundle.read(spark, path)["a"].collect()) == [20, 21, 22, 23, 24]
    assert len(bundle.prune(spark, path, keep=2)) == 1
    assert [b.number for b in bundle.bundles(spark, path)] == [3, 2]
    old = bundle.bundles(spark, path)[1]
    assert sorted(r["k"] for r in bundle.read(spark, path, bundle=old)["a"].collect()) == [10, 11, 12, 13, 14]
    with pytest.raises(ValueError):
        bundle.prune(spark, path, keep=0)


def test_an_empty_mart_is_published(spark, tmp_path):
    done = bundle.publish({"a": spark.range(0)}, str(tmp_path))
    assert done.marts["a"].n_rows == 0 and bundle.read(spark, str(tmp_path))["a"].columns == ["id"]


def test_storage_cost_of_ten_units_at_five(spark):
    orders = spark.createDataFrame([("PLANT01", 100.0, 10.0)], "plant_code string, weight double, unit_quantity double")
    costs = spark.createDataFrame([("PLANT01", 5.0)], "wh string, cost_unit double")
    assert marts.warehouse_costs(orders, costs).first()["storage_cost"] == 50


def test_several_cost_rows_fan_out_unless_a_period_is_chosen(spark):
    orders = spark.createDataFrame([("P", 1.0, 10.0)], "plant_code string, weight double, unit_quantity double")
    costs = spark.createDataFrame([("P", 5.0, 2013, 5), ("P", 6.0, 2013, 6)], schemas.WH_COSTS)
    assert marts.warehouse_costs(orders, costs).count() == 2
    assert marts.warehouse_costs(orders, costs, period=(2013, 6)).first()["storage_cost"] == 60


def test_capacity_without_a_match_or_with_zero(spark):
    orders = spark.createDataFrame([("P",), ("P",), ("Q",), ("R",)], "plant_code string")
    sizes = spark.createDataFrame([("P", 4.0), ("Q", 0.0)], "plant_id string, daily_capacity double")
    rows = {r["plant_code"]: r["capacity_utilization"] for r in marts.warehouse_capacity(orders, sizes).collect()}
    assert rows == {"P": 0.5, "Q": None, "R": None}


def test_export_names():
    now = datetime(2024, 1, 5, 7, 8, 9)
    assert export.export_name("routes_data", now) == "routes_data_20240105.csv"
    name = export.export_name("cost_breakdown", now, with_time=True)
    assert re.fullmatch(r"cost_breakdown_\d{8}_\d{6}\.csv", name)


def test_guarded_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    export.export_csv(df, f"{tmp_path}/new/dir/out.csv")
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/new/dir/out.csv").collect())
    assert lines.count("k,v") >= 1 and "a,1.5" in lines and "b," in lines
    for refused, why in ((None, "no frame"), ([1], "not a frame"), (df.limit(0), "left nothing")):
        with pytest.raises(export.ExportError, match=f"Export failed: .*{why}"):
            export.export_csv(refused, f"{tmp_path}/refused.csv")


def test_plain_export_writes_missing_values_as_na(spark, tmp_path):
    df = spark.createDataFrame([("b", None)], "k string, v double")
    export.export_csv_plain(df, f"{tmp_path}/out.csv")
    assert "b,NA" in [r["value"] for r in spark.read.text(f"{tmp_path}/out.csv").collect()]


def test_export_validation_and_stamp(spark):
    df = spark.createDataFrame([("a", -2.0), ("b", None)], "k string, cost_x double")
    assert export.validate_export_data(df, ["k"]) is True
    assert export.validate_export_data(df, ["k", "z"]) == "Required columns are not there: z"
    assert export.validate_export_data(df.limit(0), ["k"]) == "There is no row to export"
    stamped = export.stamp_export(df, "warehouse=All")
    assert stamped.columns == ["k", "cost_x", "timestamp", "filters_applied"]
    assert [r["cost_x"] for r in export.clip_negative_costs(df).collect()] == [0.0, None]


def test_all_exports_of_a_filter_in_one_call(spark, frames, tmp_path):
    loaded = tables.from_frames(frames)
    bundle.publish(marts.build_marts(loaded, unique_ids=True), f"{tmp_path}/marts")
    read = bundle.read(spark, f"{tmp_path}/marts")
    now = datetime(2024, 1, 5, 7, 8, 9)
    spec = FilterSpec(warehouse="PLANT16", carrier="V44_1", map_keys=False)
    written, refused = exports.export_all(read, loaded.order_list, spec, f"{tmp_path}/out", now, stamp=True)
    # the mart has a port, the filter a plant, and they are compared as they stand: nothing to export about shipping
    assert set(refused) == {"routes_data", "transport_mode"}
    assert all(why.startswith("Export failed") for why in refused.values())
    assert sorted(p.rsplit("/", 1)[1] for p in written.values()) == [
        "cost_breakdown_20240105_070809.csv",
        "efficiency_matrix_20240105_070809.csv",
        "service_level_20240105.csv",
        "storage_costs_20240105.csv",
        "unit_cost_analysis_20240105_070809.csv",
    ]
    stored = spark.read.option("header", True).csv(written["storage_costs"]).first()
    assert (stored["plant_code"], stored["storage_cost"]) == ("PLANT16", "4040.0")
    assert stored["filters_applied"] == "warehouse=PLANT16; carrier=V44_1; service_level=All"


def test_check_log(spark, tmp_path):
    path = f"{tmp_path}/checks"
    df = spark.createDataFrame([(1.0,), (None,)], "weight double")
    weak = quality.run(df, [quality.Rule("missing", "weight", F.col("weight").isNull(), quality.WARN)])
    with pytest.warns(UserWarning, match="missing: 1 bad rows in weight"):
        check_log.log_checks(weak, path)
    hard = quality.run(df, [quality.Rule("null", "weight", F.col("weight").isNull())])
    with pytest.raises(quality.DataQualityError, match="null: 1 bad rows"):
        check_log.log_checks(hard, path)
    assert spark.read.parquet(path).count() == 2


def test_a_check_run_is_logged_once(spark, tmp_path):
    path = f"{tmp_path}/checks"
    df = spark.createDataFrame([(1.0,), (None,)], "weight double")
    rule = quality.Rule("missing", "weight", F.col("weight").isNull(), quality.WARN)
    for _ in range(2):
        with pytest.warns(UserWarning, match="missing: 1 bad rows"):
            check_log.log_checks(quality.run(df, [rule]), path, run_id="nightly", day=date(2024, 1, 5))
    with pytest.warns(UserWarning, match="missing"):
        check_log.log_checks(quality.run(df, [rule]), path, run_id="other", day=date(2024, 1, 5))
    logged = check_log.read_log(spark, path, first=date(2024, 1, 5), last=date(2024, 1, 5))
    assert sorted(r["run_id"] for r in logged.collect()) == ["nightly", "other"]
    # the repeated run finds nothing any more, so its earlier rows go
    assert check_log.log_checks(quality.run(df.limit(1), [rule]), path, run_id="nightly", day=date(2024, 1, 5)) == []
    assert [r["run_id"] for r in check_log.read_log(spark, path).collect()] == ["other"]
    assert check_log.read_log(spark, path, first=date(2024, 1, 6)).count() == 0
