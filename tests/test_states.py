"""Marts from states by day."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lanecost import tpch
from lanecost.plans import marts, states

SF = "/root/testdata/sf0.001"
FIRST = date(2024, 2, 27)


@pytest.fixture(scope="module")
def orders(spark):
    columns = ["order_id", "carrier", "origin_port", "destination_port", "service_level", "weight", "plant_code", "unit_quantity"]
    moved = F.date_add(F.lit(FIRST), (F.col("order_id") % 5).cast("int")).alias("order_date")
    return tpch.order_list(spark, SF, columns).select("*", moved).persist()


@pytest.fixture(scope="module")
def rates(spark):
    return tpch.freight_rates(spark, SF)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rounded(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_two_merged_states_equal_the_whole(spark, orders, rates):
    early = F.col("order_date") < F.lit(FIRST + timedelta(days=2))
    whole = states.shipping_state(orders, rates, unique_ids=True)
    parts = [states.shipping_state(orders.where(c), rates, unique_ids=True) for c in (early, ~early)]
    assert rows(states.merge(*parts)) == rows(whole)
    assert rows(states.shipping_costs(states.merge(*parts))) == rows(states.shipping_costs(whole))
    mart = marts.shipping_costs(orders, rates, unique_ids=True)
    assert rounded(states.shipping_costs(whole).select(mart.columns)) == rounded(mart)


def test_halves_of_one_day_add_up(spark, orders, rates):
    halves = [states.plant_state(orders.where(F.col("order_id") % 2 == k)) for k in (0, 1)]
    assert rows(states.merge(*halves)) == rows(states.plant_state(orders))
    assert rows(states.plant_state(orders.repartition(13))) == rows(states.plant_state(orders.repartition(2)))
    costs, sizes = tpch.wh_costs(spark, SF), tpch.wh_capacities(spark, SF)
    merged = states.merge(*halves)
    assert rounded(states.warehouse_costs(merged, costs)) == rounded(marts.warehouse_costs(orders, costs))
    assert rounded(states.warehouse_capacity(merged, sizes)) == rounded(marts.warehouse_capacity(orders, sizes))


def test_one_unknown_measure_makes_the_total_unknown(spark, orders):
    state = states.plant_state(orders.withColumn("weight", F.when(F.col("order_id") % 7 != 0, F.col("weight"))))
    got = states.warehouse_costs(state, tpch.wh_costs(spark, SF)).select("total_orders", "total_weight").collect()
    assert any(r["total_weight"] is None for r in got) and all(r["total_orders"] for r in got)


def test_days_are_stored_and_replaced(spark, orders, rates, tmp_path):
    path = str(tmp_path / "days")
    state = states.shipping_state(orders, rates, unique_ids=True)
    last = FIRST + timedelta(days=4)
    states.write_days(state, path, FIRST, last)
    for _ in range(2):  # a repeated run adds nothing
        day = FIRST + timedelta(days=3)
        states.write_days(states.shipping_state(orders.where(F.col("order_date") == day), rates, unique_ids=True), path, day)
    stored = states.read_days(spark, path)
    assert rows(states.shipping_costs(stored)) == rows(states.shipping_costs(state))
    # the order of a day is cancelled: its folder is emptied, the others stay
    states.write_days(state.limit(0), path, FIRST)
    left = states.read_days(spark, path)
    assert left.where(F.col("order_date") == F.lit(FIRST)).count() == 0
    assert left.count() == state.where(F.col("order_date") > F.lit(FIRST)).count()
    one = states.read_days(spark, path, last, last)
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_date" in text
    assert one.select("order_date").distinct().collect() == [(last,)]
